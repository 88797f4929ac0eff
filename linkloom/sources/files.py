"""Relations in files: CSV summaries, Parquet tables with keys, article sets, word lists, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import first_per_key

#: Relation -> (schema, key columns). A load keeps the first row of a key.
RELATIONS = {
    "page": ("page_id bigint, page_title string, page_type int", ["page_id"]),
    "redirect": ("rd_from bigint, rd_to bigint", ["rd_from", "rd_to"]),
    "pagelink": ("pl_from bigint, pl_to bigint", []),
    "categorylink": ("cl_parent bigint, cl_child bigint", ["cl_parent", "cl_child"]),
    "translation": ("tl_id bigint, tl_lang string, tl_text string", ["tl_id", "tl_lang"]),
    "disambiguation": ("da_from bigint, da_to bigint, da_index int, da_scope string", ["da_from", "da_to"]),
    "linkcount": ("lc_id bigint, lc_in bigint, lc_out bigint", ["lc_id"]),
    "content": ("co_id bigint, co_content string", ["co_id"]),
    "pagelink_in": ("li_id bigint, li_data string", ["li_id"]),
    "pagelink_out": ("lo_id bigint, lo_data string", ["lo_id"]),
    "equivalence": ("eq_cat bigint, eq_art bigint", ["eq_cat"]),
    "anchor": ("an_text string, an_to bigint, an_count bigint", ["an_text", "an_to"]),
    "anchor_occurance": ("ao_text string, ao_linkcount bigint, ao_occcount bigint", ["ao_text"]),
    "stats": ("st_articles bigint, st_categories bigint, st_redirects bigint, st_disambigs bigint", []),
    "generality": ("gn_id bigint, gn_depth int", ["gn_id"]),
    "definition": ("df_id bigint, df_firstsentence string, df_firstparagraph string", ["df_id"]),
}
#: Relations that a set may lack.
OPTIONAL = {"content", "anchor_occurance", "definition"}


def read_csv(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """A CSV summary by its fixed schema: quotes, backslash escapes, trimmed numbers; malformed lines drop out."""
    return spark.read.csv(path, schema=RELATIONS[relation][0], mode="DROPMALFORMED", quote='"', escape="\\", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def write_csv(df: DataFrame, path: str) -> None:
    """The same format."""
    df.write.mode("overwrite").csv(path, quote='"', escape="\\", quoteAll=False)


def load(df: DataFrame, relation: str, path: str, overwrite: bool = False) -> None:
    """A relation to Parquet, one row for each key (the smallest of its rows); an existing table stays unless overwritten."""
    keys = RELATIONS[relation][1]
    if keys:
        rest = [F.col(c) for c in df.columns if c not in keys]
        df = first_per_key(df, keys, rest or [F.lit(0)])
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written in full."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def check_complete(spark: SparkSession, folder: str) -> list[str]:
    """The optional relations that `folder` lacks; a missing mandatory one is an error."""
    missing = [r for r in RELATIONS if not exists(spark, f"{folder}/{r}")]
    must = [r for r in missing if r not in OPTIONAL and r not in ("pagelink", "stats")]
    if must:
        raise FileNotFoundError(f"{folder} lacks {', '.join(must)}")
    return missing


def progress(spark: SparkSession, folder: str) -> float:
    """The part of the relations that `folder` holds in full, for who watches a load."""
    return sum(exists(spark, f"{folder}/{r}") for r in RELATIONS) / len(RELATIONS)


def stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at `path`, made and written first unless it is complete: a resumable step."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_article_set(spark: SparkSession, path: str) -> DataFrame:
    """(page_id): the first column of a tab-separated file, distinct and ascending."""
    return spark.read.csv(path, sep="\t").select(F.col("_c0").try_cast("bigint").alias("page_id")).where("page_id is not null").distinct().orderBy("page_id")


def write_article_set(df: DataFrame, path: str) -> None:
    df.select("page_id").distinct().orderBy("page_id").write.mode("overwrite").csv(path, sep="\t")


def read_words(spark: SparkSession, path: str, fold: bool = False) -> DataFrame:
    """(word): one word per line, trimmed, in lower case if `fold`."""
    w = F.trim("value")
    return spark.read.text(path).select((F.lower(w) if fold else w).alias("word")).where("word <> ''").distinct()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def pack_in(adjacency: DataFrame) -> DataFrame:
    """(li_id, li_data): sources packed by colons."""
    return adjacency.select(F.col("page_id").alias("li_id"), F.array_join(F.col("sources").cast("array<string>"), ":").alias("li_data"))


def pack_out(adjacency: DataFrame) -> DataFrame:
    """(lo_id, lo_data): targets with their links in, packed by colons and semicolons."""
    return adjacency.select(F.col("page_id").alias("lo_id"), F.array_join(F.transform("targets", lambda x: F.concat_ws(":", x["target"].cast("string"), x["lc_in"].cast("string"))), ";").alias("lo_data"))


def unpack_out(packed: DataFrame) -> DataFrame:
    """The reverse of pack_out."""
    item = lambda x: F.struct(F.split(x, ":")[0].cast("bigint").alias("target"), F.split(x, ":")[1].cast("bigint").alias("lc_in"))
    return packed.select(F.col("lo_id").alias("page_id"), F.transform(F.filter(F.split("lo_data", ";"), lambda x: x != ""), item).alias("targets"))
