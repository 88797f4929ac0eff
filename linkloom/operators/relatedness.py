"""How much two pages, or two terms, have to do with each other, by their links."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import common_neighbours, in_edges, links_of, out_edges


def six(c: Column) -> Column:
    """Six digits, rounded as a binary number: a mean of two numbers of six digits often lies just between two."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def _unique(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null").distinct()


def by_incoming(pairs: DataFrame, links: DataFrame, articles: int) -> DataFrame:
    """(a, b, rel): 1 - (ln max - ln both) / (ln N - ln min) of the in-link sets; a <= b.

    No in-links on a side, or none in common: 0; measures over 1 (and N no larger than a set) count as 1 apart.
    Only the pairs asked for are joined with their links, the smaller set of each looked up in the larger.
    """
    e = in_edges(links).select(F.col("id").alias("me"), F.col("source").alias("x"))
    x = common_neighbours(_unique(pairs), e)
    up = F.ln(F.greatest("n_a", "n_b")) - F.ln("shared")
    down = F.lit(math.log(max(1, articles))) - F.ln(F.least("n_a", "n_b"))
    apart = F.when(down == 0, F.lit(1.0)).otherwise(up / down)
    rel = F.when(F.col("shared") == 0, 0.0).otherwise(1 - F.when(apart > 1, 1.0).otherwise(apart))
    return x.select("a", "b", F.round(rel, 6).alias("rel"))


def by_outgoing(pairs: DataFrame, links: DataFrame, articles: int) -> DataFrame:
    """(a, b, rel): the angle between the out-link vectors, each target weighted by ln(N / its links), as 1 (none) to 0 (right)."""
    p = _unique(pairs)
    w = out_edges(links).select("id", "target", F.ln(F.lit(float(max(1, articles))) / F.col("lc_in")).alias("w"))
    norm = w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    dot = p.join(w.select(F.col("id").alias("a"), "target", F.col("w").alias("wa")), "a").join(w.select(F.col("id").alias("b"), "target", F.col("w").alias("wb")), ["b", "target"])
    dot = dot.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("d"))
    x = p.join(norm.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a", "left").join(norm.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b", "left").join(dot, ["a", "b"], "left")
    size = F.sqrt("sa") * F.sqrt("sb")
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce("d", F.lit(0.0)) / size))
    half = math.pi / 2
    rel = F.when(F.col("sa").isNull() | F.col("sb").isNull(), 0.0).when(F.col("a") == F.col("b"), 1.0).when(size == 0, 0.0).otherwise((half - F.acos(cosine)) / half)
    return x.select("a", "b", F.round(rel, 6).alias("rel"))


def related(pairs: DataFrame, links: DataFrame, articles: int, mode: str = "in") -> DataFrame:
    """(a, b, rel) by links 'in', 'out', or the mean of 'both'."""
    if mode == "in":
        return by_incoming(pairs, links, articles)
    if mode == "out":
        return by_outgoing(pairs, links, articles)
    if mode != "both":
        raise ValueError(f"no such mode: {mode}")
    i, o = by_incoming(pairs, links, articles), by_outgoing(pairs, links, articles).withColumnRenamed("rel", "o")
    return i.join(o, ["a", "b"]).select("a", "b", six((F.col("rel") + F.col("o")) / 2).alias("rel"))


#: Senses that count between terms, how near to the best pair another must be, and what a combined phrase adds.
LEAST_SENSE, NEAR_BEST, PHRASE = 0.01, 0.40, 30


def by_terms(term_pairs: DataFrame, ranked: DataFrame, links: DataFrame, articles: int, mode: str = "in") -> DataFrame:
    """(t1, t2, id1, id2, rel): the chosen senses of two terms and how related the terms are.

    All pairs of senses with a commonness of LEAST_SENSE are scored, in the order of their mean commonness (most
    first, then as ranked): a pair NEAR_BEST better than the best so far starts anew, one not NEAR_BEST worse is kept. Of the kept
    pairs that of the highest mean commonness is chosen. If "t1 t2" is itself a link text, ln(its links) / 30 is
    added; the sum is at most 1. Terms without such senses give no row. The scan is a fold over one pair's sense
    pairs, at most (1 / LEAST_SENSE)^2.
    """
    s = ranked.where(F.col("commonness") >= LEAST_SENSE).select("text", "id", "commonness", "rank")
    tp = term_pairs.select("t1", "t2").distinct()
    x = tp.join(s.select(F.col("text").alias("t1"), F.col("id").alias("id1"), F.col("commonness").alias("c1"), F.col("rank").alias("r1")), "t1")
    x = x.join(s.select(F.col("text").alias("t2"), F.col("id").alias("id2"), F.col("commonness").alias("c2"), F.col("rank").alias("r2")), "t2")
    rel = related(x.select(F.col("id1").alias("a"), F.col("id2").alias("b")), links, articles, mode)
    x = x.withColumn("a", F.least("id1", "id2")).withColumn("b", F.greatest("id1", "id2")).join(rel, ["a", "b"])
    mean = ((F.col("c1") + F.col("c2")) / 2).alias("mean")
    rows = x.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct((-mean).alias("m"), "r1", "r2", "id1", "id2", "rel"))).alias("s"))
    start = F.struct(F.lit(0.0).alias("bench"), F.filter("s", lambda z: F.lit(False)).alias("kept"))

    def step(acc, p):
        better = p["rel"] > acc["bench"] + NEAR_BEST
        near = p["rel"] > acc["bench"] - NEAR_BEST
        return F.when(better, F.struct(p["rel"].alias("bench"), F.array(p).alias("kept"))).when(near, F.struct(acc["bench"].alias("bench"), F.concat(acc["kept"], F.array(p)).alias("kept"))).otherwise(acc)

    best = F.element_at(F.aggregate("s", start, step)["kept"], 1)
    rows = rows.withColumn("x", best).withColumn("phrase", F.concat_ws(" ", "t1", "t2"))
    phrase = ranked.groupBy(F.col("text").alias("phrase")).agg(F.max("link_count").alias("pn"))
    extra = F.when(F.col("pn") > 0, F.ln("pn") / PHRASE).otherwise(0.0)
    return rows.join(phrase, "phrase", "left").select("t1", "t2", "x.id1", "x.id2", F.round(F.least(F.lit(1.0), F.col("x.rel") + extra), 6).alias("rel"))


def in_context(candidates: DataFrame, context: DataFrame, links: DataFrame, articles: int) -> DataFrame:
    """(doc, text, id, weight): each candidate sense (doc, text, id, commonness) by its relatedness to the context (doc, id) and commonness.

    A text with one sense keeps its commonness as weight.
    """
    alone = F.count("*").over(Window.partitionBy("doc", "text")) == 1
    c = candidates.withColumn("alone", alone)
    p = c.where("not alone").select("doc", "id").distinct().join(context.select("doc", F.col("id").alias("cid")).distinct(), "doc")
    rel = related(p.select(F.col("id").alias("a"), F.col("cid").alias("b")), links, articles)
    p = p.withColumn("a", F.least("id", "cid")).withColumn("b", F.greatest("id", "cid")).join(rel, ["a", "b"]).groupBy("doc", "id").agg(F.sum("rel").alias("r"))
    return c.join(p, ["doc", "id"], "left").select("doc", "text", "id", F.round(F.coalesce("r", F.lit(0.0)) + F.col("commonness"), 6).alias("weight"))


def in_context_of_terms(candidates: DataFrame, terms: DataFrame, likeliest: DataFrame, links: DataFrame, articles: int) -> DataFrame:
    """As `in_context`, the context given by terms (doc, text), each standing for its likeliest article (text, id)."""
    return in_context(candidates, terms.join(likeliest.select("text", "id"), "text").select("doc", "id").distinct(), links, articles)


def out_in_links_of(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The links that start or end at one of `ids` (id), to relate a few pages without reading all pairs."""
    l = links_of(links)
    a = l.join(ids.select(F.col("id").alias("f")).distinct(), "f", "left_semi")
    return a.unionByName(l.join(ids.select(F.col("id").alias("t")).distinct(), "t", "left_semi")).distinct()
