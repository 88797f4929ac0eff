"""What a reader asks: search, compare, define, wikify. Each answer is a DataFrame of rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import titles as T
from ..operators import anchors as A
from ..operators import annotate as N
from ..operators import graph as G
from ..operators import relatedness as L
from ..session import cut

#: What each task takes, with defaults.
HELP = {
    "search": {"term": None, "id": None, "senses": 25, "links": 250},
    "compare": {"term1": None, "term2": None, "links": 250},
    "define": {"id": None, "form": "html", "whole": False},
    "wikify": {"text": None, "least": 0.5, "repeat": "first", "banned": "", "mode": "guess", "colour": None, "tooltips": False},
}


def as_json(answer: DataFrame) -> DataFrame:
    """(response): each row of an answer as a JSON object, nulls included."""
    return answer.select(F.to_json(F.struct(*answer.columns), {"ignoreNullFields": "false"}).alias("response"))


def respond(spark: SparkSession, task: str, ask: Callable[[], DataFrame]) -> DataFrame:
    """(task, error, response): the JSON rows of an answer, or one row with the error that asking met (the rows themselves are made when they are read)."""
    try:
        if task not in HELP:
            raise ValueError(f"no such task: {task}")
        return as_json(ask()).select(F.lit(task).alias("task"), F.lit(None).cast("string").alias("error"), "response")
    except Exception as e:  # noqa: BLE001 - any failure is the answer
        return spark.createDataFrame([(task, f"{type(e).__name__}: {e}".split("\n")[0], None)], "task string, error string, response string")


class Encyclopedia:
    """The relations that the services read: page, pagelink, redirect, categorylink, anchors (text, id, n), content (id, text)."""

    def __init__(self, page: DataFrame, pagelink: DataFrame, redirect: DataFrame, categorylink: DataFrame, anchors: DataFrame, content: DataFrame) -> None:
        self.page, self.pagelink, self.redirect, self.categorylink, self.anchors, self.content = page, pagelink, redirect, categorylink, anchors, content
        self.ranked = A.senses(anchors)

    def articles(self) -> int:
        return self.page.where(F.col("page_type") == G.ARTICLE).count()

    def definitions(self, form: str = "html", whole: bool = False) -> DataFrame:
        """(id, definition) of every page with a content."""
        return self.content.where("text is not null").select("id", M.udf(M.define, "string", form, whole)(F.col("text")).alias("definition"))

    def search_terms(self, terms: DataFrame, senses: int = 25) -> DataFrame:
        """(term, id, title, commonness, rank, definition): the articles each term may stand for; unknown terms give no row."""
        s = A.page_senses(self.ranked, self.page, G.ARTICLE).join(terms.select(F.col("term").alias("text")).distinct(), "text", "left_semi")
        s = s.where(F.col("rank") <= senses).join(self.page.select(F.col("page_id").alias("id"), F.col("page_title").alias("title")), "id")
        d = self.definitions("plain").groupBy("id").agg(F.min("definition").alias("definition"))
        return s.join(d, "id", "left").select(F.col("text").alias("term"), "id", "title", "commonness", "rank", "definition")

    def search_page(self, page_id: int, links: int = 250) -> DataFrame:
        """(part, id, title, value): all that is known of one page, by part; lists of links end at `links`, those of children at one more, which tells that there are more."""
        p = self.page
        me = p.where(F.col("page_id") == page_id)
        row = lambda df, part, i, t, v: df.select(F.lit(part).alias("part"), F.col(i).cast("bigint").alias("id"), F.col(t).alias("title"), F.col(v).cast("double").alias("value"))
        one = lambda df: df.withColumn("one", F.lit(1.0))
        texts = A.texts_of(self.anchors.where(F.col("id") == page_id)).where("n > 0")
        out = row(me.withColumn("t", F.col("page_type").cast("double")), "page", "page_id", "page_title", "t")
        out = out.unionByName(row(texts, "text", "id", "text", "proportion"))
        out = out.unionByName(row(one(G.redirects_of(p, self.redirect.where(F.col("rd_to") == page_id))), "redirect", "redirect_id", "redirect_title", "one"))
        out = out.unionByName(row(one(G.parents(p, self.categorylink.where(F.col("cl_child") == page_id))), "parent", "parent_id", "parent_title", "one"))
        kids = self.categorylink.where(F.col("cl_parent") == page_id)
        for part, kind in (("child category", G.CATEGORY), ("child article", G.ARTICLE)):
            out = out.unionByName(row(one(G.children(p, kids, kind).orderBy("child_id").limit(links + 1)), part, "child_id", "child_title", "one"))
        n = self.articles()
        for part, incoming, end in (("link in", True, "pl_to"), ("link out", False, "pl_from")):
            l = G.linked_pages(p, self.pagelink.where(F.col(end) == page_id), incoming).orderBy("other_id").limit(links)
            rel = L.related(l.select(F.lit(page_id).alias("a"), F.col("other_id").alias("b")), self.pagelink, n)
            r = l.join(rel.select(F.when(F.col("a") == page_id, F.col("b")).otherwise(F.col("a")).alias("other_id"), "rel"), "other_id", "left")
            out = out.unionByName(row(r, part, "other_id", "other_title", "rel"))
        return out

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(t1, t2, id1, id2, rel, ...): how related terms (t1, t2) are, by which senses, and the links these share."""
        r = L.by_terms(pairs, self.ranked, self.pagelink, self.articles())
        s = G.shared_links(r.select(F.col("id1").alias("a"), F.col("id2").alias("b")), self.pagelink)
        return r.join(s, (F.col("id1") == F.col("a")) & (F.col("id2") == F.col("b"))).drop("a", "b")

    def wikify(self, docs: DataFrame, probabilities: DataFrame, least: float = 0.2, repeat: str = "first", banned: DataFrame | None = None, score: N.Scorer = N.DEFAULT_SENSE,
               mode: str = "plain", render: N.Render = N.wiki_tag, weigh: N.Scorer | None = None) -> DataFrame:
        """(doc, tagged, score): documents (doc, text) with their topics of a weight of `least` put in as links, and how well the topics hang together.

        `mode`: 'plain', 'wiki' or 'html' source, or 'guess' for each text by its marks. Markup is blanked before terms are looked for, and
        tags are put into the source itself; what it links to already is not linked again, `repeat` 'region' follows its sections and tables.
        `banned` (id, title) topics are left out, `weigh` is a scorer of topics (`weight`) in the place of the simple index, such as a link detector.
        Null texts stay null.
        """
        d = docs.where("doc is not null").select("doc", "text")
        of = F.lit(mode) if mode != "guess" else T.source_mode(F.col("text"))

        @F.pandas_udf(M.PREPROCESSED)
        def read(s: pd.Series, m: pd.Series) -> pd.DataFrame:
            none = dict.fromkeys(("text", "context", "banned", "splits", "marks"))
            return pd.DataFrame([none if x is None else M.preprocess(x, k) for x, k in zip(s, m, strict=True)], columns=list(none))

        seen = cut(d.select("doc", read("text", of).alias("p")).select("doc", "p.*"))
        refs = cut(N.spot(seen, "doc", "text", probabilities, 0.0))
        cand, n = cut(N.candidates(refs, self.ranked, self.page)), self.articles()
        chosen = cut(N.disambiguate(N.sense_features(cand, N.context(cand, self.pagelink, n), self.pagelink, n), score))
        lengths = seen.where("text is not null").select("doc", F.length("text").alias("length"))
        t = N.relatedness_to_others(N.topics(refs, chosen, lengths), self.pagelink, n)
        t = cut(weigh(t) if weigh else N.index_weights(t))
        t = N.without_banned(t, seen.select("doc", F.explode("banned").alias("title")))
        if banned is not None:
            t = N.without_banned(t, banned)
        x = refs.join(chosen.select("doc", "term", "id", "title"), ["doc", "term"]).join(N.best_topics(t, least).select("doc", "id", "weight"), ["doc", "id"])
        regions = seen.select("doc", F.explode("marks").alias("m")).select("doc", "m.*")
        x = N.by_repeat(N.without_overlaps(x.select("doc", "start", "end", "id", "title", "weight")), repeat, regions)
        return N.tag(d, "doc", "text", x, render).join(N.document_scores(t), "doc", "left")
