"""Link texts and what they stand for: senses, commonness, link probability.

An anchor relation has (text, id, n): the link text, its destination and how often it occurs with it (0: a title never
used as a link text). Rows without a text or destination are left out, null counts are 0, repeated rows add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import ARTICLE, DISAMBIGUATION, REDIRECT
from .sieve import Sieve, make_sieve


def anchor_relation(df: DataFrame, text: str, to: str, n: str, process: Callable[[Column], Column] | None = None) -> DataFrame:
    """(text, id, n) summed by text and destination, the text put through a term processor; empty texts drop out."""
    t = process(F.col(text)) if process else F.col(text)
    a = df.select(t.alias("text"), F.col(to).alias("id"), F.coalesce(F.col(n), F.lit(0)).alias("n"))
    return a.where("text is not null and text <> '' and id is not null").groupBy("text", "id").agg(F.sum("n").cast("bigint").alias("n"))


def count_anchors(links: DataFrame, text: str, to: str) -> DataFrame:
    """(text, id, n) from link occurrences."""
    return links.select(F.col(text).alias("text"), F.col(to).alias("id")).where("text is not null and text <> '' and id is not null").groupBy("text", "id").agg(F.count("*").alias("n"))


def fill_titles(anchors: DataFrame, page: DataFrame, resolved: DataFrame) -> DataFrame:
    """`anchors` and, with count 0, the titles of articles and redirects that are not used as link text for their page."""
    titles = page.where(F.col("page_type") == ARTICLE).select(F.col("page_title").alias("text"), F.col("page_id").alias("id"))
    reds = page.where(F.col("page_type") == REDIRECT).select(F.col("page_title").alias("text"), F.col("page_id").alias("rd_from"))
    reds = reds.join(resolved.select("rd_from", F.col("rd_to").alias("id")), "rd_from").select("text", "id")
    extra = titles.unionByName(reds).where("text is not null and text <> ''").distinct().join(anchors.select("text", "id"), ["text", "id"], "left_anti")
    return anchors.unionByName(extra.withColumn("n", F.lit(0).cast("bigint")))


def anchor_summary(anchors: DataFrame) -> DataFrame:
    """(text, senses): the (n, id) of each text, most frequent first, then by id."""
    s = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("id").alias("id"))))
    return anchors.groupBy("text").agg(s.alias("s")).select("text", F.transform("s", lambda x: F.struct((-x["m"]).alias("n"), x["id"].alias("id"))).alias("senses"))


def senses(anchors: DataFrame) -> DataFrame:
    """(text, id, n, link_count, commonness, rank): each sense's share of its text's links; rank by n, then id. No links: commonness null."""
    w = Window.partitionBy("text")
    total = F.sum("n").over(w)
    return anchors.select("text", "id", "n", total.alias("link_count"), F.when(total > 0, F.round(F.col("n") / total, 6)).alias("commonness"), F.row_number().over(w.orderBy(F.desc("n"), "id")).alias("rank"))


def page_senses(ranked: DataFrame, page: DataFrame, *types: int) -> DataFrame:
    """The senses whose page is of the types (articles and disambiguations if none are named)."""
    return ranked.join(page.where(F.col("page_type").isin(*(types or (ARTICLE, DISAMBIGUATION)))).select(F.col("page_id").alias("id")), "id", "left_semi")


def likeliest_article(ranked: DataFrame, page: DataFrame) -> DataFrame:
    """(text, id, commonness): the first sense of each text that is an article."""
    best = page_senses(ranked, page, ARTICLE).groupBy("text").agg(F.min_by(F.struct("id", "commonness"), "rank").alias("x"))
    return best.select("text", "x.id", "x.commonness")


def texts_of(anchors: DataFrame) -> DataFrame:
    """(id, text, n, proportion, rank): the link texts of each page, most frequent first, then by text."""
    w = Window.partitionBy("id")
    total = F.sum("n").over(w)
    return anchors.select("id", "text", "n", F.when(total > 0, F.round(F.col("n") / total, 6)).alias("proportion"), F.row_number().over(w.orderBy(F.desc("n"), "text")).alias("rank"))


def frequent_senses(anchors: DataFrame, over: int) -> DataFrame:
    """The senses with more links than `over`, for a cache of likely ones."""
    return anchors.where(F.col("n") > over)


#: Most words of a link text that is looked for in documents.
MOST_WORDS = 11


def word_beginnings(key: str) -> list[str]:
    """The first word, the first two, ... of words parted by one space."""
    w = key.split(" ")
    return [" ".join(w[:i]) for i in range(1, len(w) + 1)]


def runs(text: str, most: int, known: Sieve) -> set[str]:
    """The distinct runs of up to `most` words within each line, words parted by white space, that the sieve lets through."""
    out: set[str] = set()
    for line in text.splitlines():
        w = line.split()
        for i, s in enumerate(w):
            for j in range(i + 1, min(len(w), i + most) + 1):
                if not known.begins(s):
                    break
                if known.whole(s):
                    out.add(s)
                if j < len(w):
                    s = f"{s} {w[j]}"
    return out


def document_occurrences(docs: DataFrame, text: str, anchors: DataFrame, process: Callable[[Column], Column] | None = None) -> DataFrame:
    """(text, occ_count): in how many documents each link text occurs as a run of words of one line.

    Runs as long as the longest link text (MOST_WORDS words at most, longer texts have 0) that a sieve of bounded size lets through are counted per
    batch, so that frequent ones cross the shuffle once a batch, and semi-joined with the link texts. Null texts hold nothing.
    """
    a = cut(anchors.select(F.array_join(F.split(F.trim("text"), r"\s+"), " ").alias("key"), "text").distinct())
    most = min(MOST_WORDS, a.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1)
    body = process(F.col(text)) if process else F.col(text)
    sent = make_sieve(a, "key", word_beginnings)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Sieve(sent.value)
        for b in batches:
            n: dict[str, int] = {}
            for t in b["t"]:
                for g in runs(t, most, known):
                    n[g] = n.get(g, 0) + 1
            if n:
                yield pd.DataFrame({"key": list(n), "c": list(n.values())})

    g = docs.select(body.alias("t")).where("t is not null").mapInPandas(count, "key string, c bigint").groupBy("key").agg(F.sum("c").alias("c"))
    return a.join(g, "key", "left").select("text", F.coalesce("c", F.lit(0)).alias("occ_count"))


def link_probability(anchors: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(text, link_count, occ_count, link_probability): links over documents, at most 1; 0 without documents."""
    n = anchors.groupBy("text").agg(F.sum("n").alias("link_count"))
    p = F.when(F.col("occ_count") > 0, F.round(F.least(F.lit(1.0), F.col("link_count") / F.col("occ_count")), 6)).otherwise(F.lit(0.0))
    return n.join(occurrences, "text").select("text", "link_count", "occ_count", p.alias("link_probability"))


def statistics(anchors: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(text, link_count, occ_count) of every link text; -1 documents where none have been counted for it."""
    n = anchors.groupBy("text").agg(F.sum("n").alias("link_count"))
    return n.join(occurrences.select("text", "occ_count"), "text", "left").select("text", "link_count", F.coalesce("occ_count", F.lit(-1).cast("bigint")).alias("occ_count"))


def merge_counts(parts: DataFrame) -> DataFrame:
    """(text, link_count, occ_count) summed over parts; only texts that have links."""
    s = parts.groupBy("text").agg(F.sum("link_count").alias("link_count"), F.sum("occ_count").alias("occ_count"))
    return s.where("link_count > 0")
