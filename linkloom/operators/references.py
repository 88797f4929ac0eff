"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import for_each_part, heavy_keys, with_part


@dataclass(frozen=True)
class Ref:
    """A table of references: its name, the columns of the referring id, the foreign key and the time."""

    tab: str
    df: DataFrame
    source: str
    target: str
    seen: str

    def rows(self) -> DataFrame:
        return self.df.select(
            F.lit(self.tab).alias("tab"),
            F.col(self.source).cast("bigint").alias("from_id"),
            F.col(self.target).cast("bigint").alias("to_id"),
            F.col(self.seen).alias("seen"),
        ).where("to_id is not null")


def month(col: str):
    """The month of a time as 'YYYY-MM'; null for null."""
    return F.substring(F.col(col).cast("string"), 1, 7)


def orphan_references(refs: list[Ref], parents: DataFrame, key: str, born: str, died: str) -> DataFrame:
    """Every reference row (tab, period, from_id, to_id, seen) without a parent that lives when it is made.

    A parent row lives from `born` (inclusive) to `died` (exclusive, null: for ever); one key may have several
    lives. The distinct non-null foreign keys, each with its first and last reference, are anti-joined against
    the lives that span all of them; what is left (missing keys, and keys with a gap somewhere) is small and is
    joined back to the references, of which those covered by one of the lives drop out.

    Null foreign keys refer to nothing and are left out. A reference without a time, and one whose parents have
    no birth time, counts as orphan, with a null period in the first case. Repeated rows are kept. Other columns are not read.
    Empty tables give no rows; without parents every reference is an orphan. The rows of a frequent key are
    split into parts, each of which meets a copy of the key's few parent rows.
    """
    rows = refs[0].rows()
    for r in refs[1:]:
        rows = rows.unionByName(r.rows())
    keys = cut(
        rows.groupBy("to_id").agg(
            F.min("seen").alias("first"), F.max("seen").alias("last"), F.count_if(F.col("seen").isNull()).alias("untimed"), F.count("*").alias("n")
        )
    )
    lives = parents.select(F.col(key).cast("bigint").alias("id"), F.col(born).alias("born"), F.col(died).alias("died")).where("id is not null and born is not null").distinct()
    spans = (F.col("to_id") == F.col("id")) & (F.col("untimed") == 0) & (F.col("born") <= F.col("first")) & (F.col("died").isNull() | (F.col("died") > F.col("last")))
    suspects = cut(keys.join(lives, spans, "left_anti").select("to_id", "n"))
    heavy = heavy_keys(suspects, "to_id", "n")
    left = with_part(rows, "to_id", heavy, [F.col("from_id"), F.col("seen")])
    left = left.join(for_each_part(suspects.select("to_id"), "to_id", heavy), ["to_id", "_part"], "left_semi")
    some = lives.withColumnRenamed("id", "to_id").join(suspects, "to_id", "left_semi")
    some = for_each_part(some, "to_id", heavy).select(F.col("to_id").alias("id"), F.col("_part").alias("_p"), "born", "died")
    alive = (F.col("to_id") == F.col("id")) & (F.col("_part") == F.col("_p")) & (F.col("born") <= F.col("seen")) & (F.col("died").isNull() | (F.col("seen") < F.col("died")))
    return left.join(some, alive, "left_anti").select("tab", month("seen").alias("period"), "from_id", "to_id", "seen")


def orphan_counts(refs: list[Ref], parents: DataFrame, key: str, born: str, died: str) -> DataFrame:
    """Per table and period: all references (`refs`), those that are orphans (`orphans`) and their distinct targets (`missing_keys`)."""
    rows = refs[0].rows()
    for r in refs[1:]:
        rows = rows.unionByName(r.rows())
    total = rows.groupBy("tab", month("seen").alias("period")).agg(F.count("*").alias("refs"))
    bad = orphan_references(refs, parents, key, born, died).groupBy("tab", "period", "to_id").agg(F.count("*").alias("n"))
    bad = bad.groupBy("tab", "period").agg(F.sum("n").alias("orphans"), F.count("*").alias("missing_keys"))
    b = bad.select(F.col("tab").alias("t"), F.col("period").alias("p"), "orphans", "missing_keys")
    return total.join(b, (F.col("tab") == F.col("t")) & F.col("period").eqNullSafe(F.col("p")), "left").select(
        "tab", "period", "refs", F.coalesce("orphans", F.lit(0)).alias("orphans"), F.coalesce("missing_keys", F.lit(0)).alias("missing_keys")
    )
