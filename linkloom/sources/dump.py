"""A MediaWiki XML dump to relations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markup import strip_templates
from ..functions.titles import clean_title, normalize_casing
from ..operators.graph import ARTICLE, CATEGORY, DISAMBIGUATION, REDIRECT, resolve_redirects
from ..session import cut

# What makes a page a disambiguation.
DISAMBIGUATION_MARKS = ("{{disambig}}", "{{disambig-cleanup}}", "{{geodis}}", "{{hndis}}", "{{numberdis}}", "[[category:disambiguation]]")
MAIN, CATEGORY_SPACE = 0, 14

_LINK = re.compile(r"\[\[\s*([^\[\]]+)\]\]")
_LANGUAGE = re.compile(r"[a-z]{2,3}(?:-[a-z]+)*:")
PAGE_SCHEMA = "id bigint, title string, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"


def find_dump(spark: SparkSession, folder: str) -> str:
    """The one file of a folder whose name ends in pages-articles.xml."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*pages-articles.xml*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} dumps in {folder}, one is needed")
    return found[0].getPath().toString()


def read_namespaces(spark: SparkSession, path: str) -> DataFrame:
    """(name, ns): the name spaces of a dump, in lower case; the main one has no name."""
    x = spark.read.format("xml").option("rowTag", "namespace").schema("_key int, _VALUE string").load(path)
    return x.select(F.lower(F.trim("_VALUE")).alias("name"), F.col("_key").alias("ns")).where("name is not null and name <> ''").distinct()


def read_pages(spark: SparkSession, path: str, namespaces: DataFrame) -> DataFrame:
    """(id, ns, title, text, redirect, page_type) of the pages in the main and category spaces.

    A title's prefix counts if it names a space, else the title is in the main one. A page is a redirect if the dump
    says so, a disambiguation if its text has one of the marks (main space), else an article or category.
    """
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE_SCHEMA).load(path)
    raw = raw.select("id", F.trim("title").alias("full"), F.col("revision.text._VALUE").alias("text"), F.col("redirect._title").alias("rd"), F.col("redirect").isNotNull().alias("is_rd")).where("id is not null and full is not null")
    n = F.broadcast(namespaces)  # a few dozen rows by the format of a dump
    head = F.lower(F.trim(F.substring_index("full", ":", 1)))
    p = raw.join(n, (head == n["name"]) & F.col("full").contains(":"), "left")
    title = F.when(F.col("ns").isNotNull(), F.trim(F.expr("substring(full, instr(full, ':') + 1)"))).otherwise(F.col("full"))
    low = F.lower(F.coalesce("text", F.lit("")))
    dis = F.lit(False)
    for m in DISAMBIGUATION_MARKS:
        dis = dis | low.contains(m)
    p = p.select("id", F.coalesce("ns", F.lit(MAIN)).alias("ns"), title.alias("title"), "text", "rd", "is_rd", dis.alias("dis")).where(F.col("ns").isin(MAIN, CATEGORY_SPACE))
    kind = F.when(F.col("is_rd"), REDIRECT).when(F.col("ns") == CATEGORY_SPACE, CATEGORY).when(F.col("dis"), DISAMBIGUATION).otherwise(ARTICLE)
    return p.select("id", "ns", "title", "text", F.col("rd").alias("redirect"), "dis", kind.alias("page_type"))


def title_key(col):
    """What titles are compared by."""
    return normalize_casing(clean_title(col))


def title_index(pages: DataFrame) -> DataFrame:
    """(ns, key, id): one page for each title; the last that is no redirect, else the first redirect."""
    w = Window.partitionBy("ns", "key").orderBy(F.col("is_rd"), F.when(F.col("is_rd"), F.col("id")).otherwise(-F.col("id")))
    p = pages.select("ns", title_key(F.col("title")).alias("key"), "id", (F.col("page_type") == REDIRECT).alias("is_rd"))
    return p.withColumn("r", F.row_number().over(w)).where("r = 1").select("ns", "key", "id")


def redirects(pages: DataFrame, index: DataFrame) -> DataFrame:
    """(rd_from, rd_to): redirects with a target in the dump."""
    r = pages.where("redirect is not null").select(F.col("id").alias("rd_from"), "ns", title_key(F.regexp_replace("redirect", r"^[^:]+:", "")).alias("k2"), title_key(F.col("redirect")).alias("k1"))
    i = index.select("ns", F.col("key"), F.col("id").alias("rd_to"))
    key = F.when(F.col("ns") == MAIN, F.col("k1")).otherwise(F.col("k2"))
    return r.withColumn("key", key).join(i, ["ns", "key"]).select("rd_from", "rd_to")


def links(pages: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(id, pos, ns, lang, key, anchor) of every link in the texts, templates left out; ns null and lang set for other languages."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"], strict=True):
                for pos, m in enumerate(_LINK.finditer(strip_templates(t))):
                    dest, bar, label = m[1].partition("|")
                    out.append((i, pos, dest.strip(), (label if bar else dest).strip()))
            yield pd.DataFrame(out, columns=["id", "pos", "dest", "anchor"])

    x = pages.where("text is not null").select("id", "text").mapInPandas(scan, "id bigint, pos int, dest string, anchor string")
    n = F.broadcast(namespaces)
    head = F.lower(F.trim(F.substring_index(F.ltrim("dest", F.lit(":")), ":", 1)))
    x = x.join(n, (head == n["name"]) & F.col("dest").contains(":"), "left")
    lang = F.when(F.col("ns").isNull() & F.col("dest").rlike(r"^[a-z][a-z-]+:"), F.substring_index("dest", ":", 1))
    rest = F.expr("substring(dest, instr(ltrim(':', dest), ':') + 1 + length(dest) - length(ltrim(':', dest)))")
    title = F.when(F.col("ns").isNotNull() | lang.isNotNull(), rest).otherwise(F.col("dest"))
    return x.select("id", "pos", F.when(lang.isNotNull(), F.lit(None).cast("int")).otherwise(F.coalesce("ns", F.lit(MAIN))).alias("ns"), lang.alias("lang"), title_key(title).alias("key"), F.trim(title).alias("title"), "anchor")


def resolved(l: DataFrame, index: DataFrame, rd: DataFrame) -> DataFrame:
    """`l` with `to`: the page that each link leads to in the end; links to nothing drop out."""
    x = l.join(index.select("ns", "key", F.col("id").alias("direct")), ["ns", "key"])
    r = resolve_redirects(rd).select(F.col("rd_from").alias("direct"), F.col("rd_to").alias("via"))
    return x.join(r, "direct", "left").withColumn("to", F.coalesce("via", "direct"))


def disambiguations(pages: DataFrame, index: DataFrame, rd: DataFrame) -> DataFrame:
    """(da_from, da_to, da_index, da_scope): the first link of each line before 'See also' and before the links to other languages, unless the page's title stands before it."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, title, t in zip(b["id"], b["title"], b["text"], strict=True):
                for n, line in enumerate(re.split(r"(?mi)^=+\s*see also", t)[0].split("\n")):
                    m = _LINK.search(line)
                    if m and _LANGUAGE.match(m[1]):
                        break
                    if not m or title.lower() in line[: m.start()].lower():
                        continue
                    scope = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", line).strip("*#:; '\t")
                    out.append((i, n, m[1].partition("|")[0].strip(), scope))
            yield pd.DataFrame(out, columns=["da_from", "n", "dest", "da_scope"])

    x = pages.where("dis and text is not null").select("id", "title", "text").mapInPandas(scan, "da_from bigint, n int, dest string, da_scope string")
    x = x.select("da_from", "n", "da_scope", F.lit(MAIN).alias("ns"), title_key(F.col("dest")).alias("key"))
    x = resolved(x, index, rd).groupBy("da_from", F.col("to").alias("da_to")).agg(F.min(F.struct("n", "da_scope")).alias("x"))
    k = F.row_number().over(Window.partitionBy("da_from").orderBy("x.n"))
    return x.select("da_from", "da_to", k.alias("da_index"), F.col("x.da_scope").alias("da_scope"))


def ingest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All relations of a dump: page, redirect, pagelink, categorylink, translation, disambiguation, equivalence, anchor, content."""
    ns = read_namespaces(spark, path)
    p = cut(read_pages(spark, path, ns))
    index = title_index(p)
    rd = redirects(p, index)
    l = links(p, ns)
    to = resolved(l.where("ns is not null"), index, rd)
    arts, cats = (index.where(F.col("ns") == k) for k in (MAIN, CATEGORY_SPACE))
    eq = cats.select("key", F.col("id").alias("eq_cat")).join(arts.select("key", F.col("id").alias("eq_art")), "key").select("eq_cat", "eq_art")
    return {
        "page": p.select(F.col("id").alias("page_id"), F.col("title").alias("page_title"), "page_type"),
        "redirect": rd,
        "pagelink": to.where(F.col("ns") == MAIN).select(F.col("id").alias("pl_from"), F.col("to").alias("pl_to")),
        "categorylink": to.where(F.col("ns") == CATEGORY_SPACE).select(F.col("to").alias("cl_parent"), F.col("id").alias("cl_child")).distinct(),
        "translation": l.where("lang is not null").groupBy(F.col("id").alias("tl_id"), F.col("lang").alias("tl_lang")).agg(F.min_by("title", "pos").alias("tl_text")),
        "disambiguation": disambiguations(p, index, rd),
        "equivalence": eq,
        "anchor": to.where((F.col("ns") == MAIN) & (F.col("anchor") != "")).groupBy(F.col("anchor").alias("an_text"), F.col("to").alias("an_to")).agg(F.count("*").alias("an_count")),
        "content": p.select(F.col("id").alias("co_id"), F.col("text").alias("co_content")),
    }
