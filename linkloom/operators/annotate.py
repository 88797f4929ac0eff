"""Documents annotated with topics: spotting, disambiguation in context, topic features, weights, tags.

The steps hand on DataFrames, so any of them can be replaced: a scorer is a function of a DataFrame that adds a column.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.titles import is_date_title
from .graph import ARTICLE, DISAMBIGUATION
from .relatedness import related, six
from .sieve import Sieve, make_sieve

#: Most words of a spotted term.
MOST_WORDS = 20
# What parts words, besides white space.
_BOUNDARY = re.compile(r"""[\s{}()"'.,;:_-]+""")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the stretches between boundaries."""
    out, i = [], 0
    for m in _BOUNDARY.finditer(text):
        if m.start() > i:
            out.append((i, m.start()))
        i = m.end()
    if i < len(text):
        out.append((i, len(text)))
    return out


def spot(docs: DataFrame, key: str, text: str, terms: DataFrame, least: float = 0.0) -> DataFrame:
    """(doc, start, end, term, link_probability) of every known term in the texts, in lower case, overlaps included.

    `terms` (text, link_probability) hold the terms in lower case; those below `least` are not looked for. Terms
    begin and end at boundaries and have at most MOST_WORDS words, or as many as the longest term. The stretches
    of each text that a sieve of bounded size lets through are matched by an equi-join, so the terms need fit no memory.
    A single letter after an apostrophe is no term. Positions count characters from 0, the end is exclusive.
    """
    t = terms.where((F.col("link_probability") >= least) & (F.col("text") != "")).select("text", "link_probability").distinct()
    most = t.agg(F.max(F.size(F.split("text", r"""[\s{}()"'.,;:_-]+""")))).first()[0] or 1
    most = min(MOST_WORDS, most)
    kind = docs.schema[key].dataType.simpleString()
    sent = make_sieve(t, "text", lambda x: [x[spans[0][0] : e] for spans in [word_spans(x)] if spans for _, e in spans] + [x])

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Sieve(sent.value)
        for b in batches:
            out = []
            for k, s in zip(b["k"], b["t"], strict=True):
                low = s.lower()
                if len(low) != len(s):  # a letter whose lower case is longer
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
                spans = word_spans(low)
                for i, (a, e) in enumerate(spans):
                    if e - a == 1 and a and low[a - 1] == "'":
                        continue
                    for _, e2 in spans[i : i + most]:
                        term = low[a:e2]
                        if not known.begins(term):
                            break
                        if known.whole(term):
                            out.append((k, a, e2, term))
            yield pd.DataFrame(out, columns=["doc", "start", "end", "term"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    grams = rows.mapInPandas(cut_up, f"doc {kind}, start int, end int, term string")
    return grams.join(t.withColumnRenamed("text", "term"), "term").select("doc", "start", "end", "term", "link_probability")


def candidates(refs: DataFrame, ranked: DataFrame, page: DataFrame, least: float = 0.02, disambiguations: bool = False) -> DataFrame:
    """(doc, term, link_probability, id, title, commonness, rank) of each term of a document, once."""
    types = [ARTICLE, DISAMBIGUATION] if disambiguations else [ARTICLE]
    s = ranked.where(F.col("commonness") >= least).select(F.col("text").alias("term"), "id", "commonness", "rank")
    s = s.join(page.where(F.col("page_type").isin(types)).select(F.col("page_id").alias("id"), F.col("page_title").alias("title")), "id")
    return refs.select("doc", "term", "link_probability").distinct().join(s, "term").select("doc", "term", "link_probability", "id", "title", "commonness", "rank")


def context(cand: DataFrame, links: DataFrame, articles: int, least: float = 0.02, size: int = 25) -> DataFrame:
    """(doc, id, weight): the context of each document from its unambiguous terms.

    A term is unambiguous if it has one sense, or its first is more common than 1 - `least`. Dates drop out, a
    sense counts once (with its likeliest link). Weight: (link probability + 2 * mean relatedness to the
    context, itself included) / 3. The best size + 1 are kept, by weight, then id.
    """
    n = F.count("*").over(Window.partitionBy("doc", "term"))
    c = cand.withColumn("n", n).where((F.col("n") == 1) | ((F.col("rank") == 1) & (F.col("commonness") > 1 - least)))
    return _best_context(c.withColumn("lp", F.col("link_probability")), links, articles, size)


def context_of_all(cand: DataFrame, links: DataFrame, articles: int, least: float = 0.02, size: int = 25) -> DataFrame:
    """(doc, id, weight): the context of each document from all senses of its terms with a commonness of `least`, for texts whose terms are all ambiguous.

    As `context`, with link probability times commonness in the place of the link probability.
    """
    return _best_context(cand.where(F.col("commonness") >= least).withColumn("lp", F.col("link_probability") * F.col("commonness")), links, articles, size)


def _best_context(c: DataFrame, links: DataFrame, articles: int, size: int) -> DataFrame:
    c = c.where(~F.coalesce(is_date_title(F.col("title")), F.lit(False))).groupBy("doc", "id").agg(F.max("lp").alias("lp"))
    x = c.select("doc", "id").join(c.select("doc", F.col("id").alias("id2")), "doc")
    x = x.withColumn("a", F.least("id", "id2")).withColumn("b", F.greatest("id", "id2"))
    rel = related(x.select("a", "b"), links, articles)
    mean = x.join(rel, ["a", "b"]).groupBy("doc", "id").agg(F.avg("rel").alias("r"))
    w = c.join(mean, ["doc", "id"]).select("doc", "id", F.round((F.col("lp") + 2 * F.col("r")) / 3, 6).alias("weight"))
    top = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("weight"), "id"))
    return w.withColumn("k", top).where(F.col("k") <= size + 1).drop("k")


def context_quality(ctx: DataFrame) -> DataFrame:
    """(doc, quality): the sum of the context's weights."""
    return ctx.groupBy("doc").agg(F.round(F.sum("weight"), 6).alias("quality"))


def sense_features(cand: DataFrame, ctx: DataFrame, links: DataFrame, articles: int) -> DataFrame:
    """The candidates with their relatedness to the context (weighted mean, 0 without) and the context's quality."""
    p = cand.select("doc", "id").distinct().join(ctx.select("doc", F.col("id").alias("cid"), "weight"), "doc")
    p = p.withColumn("a", F.least("id", "cid")).withColumn("b", F.greatest("id", "cid"))
    r = p.join(related(p.select("a", "b"), links, articles), ["a", "b"]).groupBy("doc", "id")
    r = r.agg(F.round(F.sum(F.col("rel") * F.col("weight")) / F.sum("weight"), 6).alias("relatedness"))
    out = cand.join(r, ["doc", "id"], "left").join(context_quality(ctx), "doc", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("relatedness", "quality")})


Scorer = Callable[[DataFrame], DataFrame]


def logistic(weights: dict[str, float], bias: float, to: str) -> Scorer:
    """A scorer of fixed weights: 1 / (1 + exp(-(bias + sum of weight * column)))."""

    def score(df: DataFrame) -> DataFrame:
        z = F.lit(bias)
        for c, w in weights.items():
            z = z + F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return df.withColumn(to, F.round(1 / (1 + F.exp(-z)), 6))

    return score


def forest(rows: DataFrame, features: list[str], label: str, to: str, trees: int = 10, share: float = 0.1, seed: int = 1) -> Scorer:
    """A scorer learnt from rows: bagged trees on small samples, classes weighted to balance. Missing features count as -1.

    Rows of one class teach that class for everything; without rows the score is null. `score.model` is the trained model, None in these two cases.
    """
    from pyspark.ml.classification import RandomForestClassifier

    n = rows.agg(F.count(label).alias("n"), F.sum(F.col(label).cast("int")).alias("k")).first()
    if not n["n"] or n["k"] in (0, n["n"]):
        always = None if not n["n"] else float(n["k"] > 0)

        def constant(df: DataFrame) -> DataFrame:
            return df.withColumn(to, F.lit(always).cast("double"))

        constant.model = None
        return constant
    train = _assembled(class_weights(rows, label).withColumn("_label", F.col(label).cast("double")), features)
    model = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", weightCol="class_weight", numTrees=trees, subsamplingRate=share, featureSubsetStrategy="all", minInstancesPerNode=2, maxDepth=10, seed=seed
    ).fit(train)
    return model_scorer(model, features, to)


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({f"_{f}": F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in features})
    return VectorAssembler(inputCols=[f"_{f}" for f in features], outputCol="_features").transform(filled).drop(*[f"_{f}" for f in features])


def model_scorer(model, features: list[str], to: str) -> Scorer:
    """The scorer of a trained model, such as one that was saved by `save_model`."""
    from pyspark.ml.functions import vector_to_array

    def score(df: DataFrame) -> DataFrame:
        x = model.transform(_assembled(df, features))
        return x.withColumn(to, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")

    score.model = model
    return score


def save_model(score: Scorer, path: str) -> None:
    """Writes a trained scorer's model, an earlier one of that path gives way."""
    if score.model is None:
        raise ValueError("nothing has been learnt")
    score.model.write().overwrite().save(path)


def load_model(path: str, features: list[str], to: str) -> Scorer:
    """The scorer of a saved model."""
    from pyspark.ml.classification import RandomForestClassificationModel

    return model_scorer(RandomForestClassificationModel.load(path), features, to)


def save_rows(rows: DataFrame, path: str) -> None:
    """Training rows to a table; `spark.read.parquet` gives them back."""
    rows.write.mode("overwrite").parquet(path)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """`rows` with class_weight: half over the share of the row's class, so that both classes weigh the same."""
    p = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if p is None or p in (0.0, 1.0):
        return rows.withColumn("class_weight", F.lit(1.0))
    return rows.withColumn("class_weight", F.when(F.col(label).cast("int") == 1, 0.5 / p).otherwise(0.5 / (1 - p)))


#: The scorer of senses that needs no training.
DEFAULT_SENSE = logistic({"commonness": 4.0, "relatedness": 6.0, "quality": 0.02}, -2.5, "confidence")


def disambiguate(features: DataFrame, score: Scorer = DEFAULT_SENSE, least: float = 0.5, strict: bool = True) -> DataFrame:
    """(doc, term, id, title, confidence): the senses of each term over `least`; the best (then smallest id) if strict."""
    s = score(features).where(F.col("confidence") > least).select("doc", "term", "id", "title", "link_probability", "confidence")
    if not strict:
        return s
    r = F.row_number().over(Window.partitionBy("doc", "term").orderBy(F.desc("confidence"), "id"))
    return s.withColumn("r", r).where("r = 1").drop("r")


def topics(refs: DataFrame, chosen: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per document and topic: occurrences, link probability and confidence (mean and most), first, last, spread.

    `lengths` (doc, length) bring positions to 0..1.
    """
    x = refs.join(chosen.drop("link_probability"), ["doc", "term"]).join(lengths, "doc")
    at = F.col("start") / F.greatest("length", F.lit(1))
    g = x.groupBy("doc", "id", "title").agg(
        F.count("*").alias("occurrences"), six(F.avg("link_probability")).alias("mean_link_probability"), F.max("link_probability").alias("most_link_probability"),
        six(F.avg("confidence")).alias("mean_confidence"), F.max("confidence").alias("most_confidence"), F.round(F.min(at), 6).alias("first"), F.round(F.max(at), 6).alias("last"),
    )
    return g.withColumn("spread", F.round(F.col("last") - F.col("first"), 6))


def banned_topics(spark: SparkSession, listed: str) -> DataFrame:
    """(id, title) from a list of ids and titles parted by semicolons; one of the two is null."""
    items = [x.strip() for x in (listed or "").split(";") if x.strip()]
    return spark.createDataFrame([(int(x), None) if x.isdigit() else (None, x) for x in items], "id bigint, title string")


def without_banned(t: DataFrame, banned: DataFrame) -> DataFrame:
    """Topics that are not in `banned`, which has ids, titles (compared without case) or both, and perhaps documents. Nulls in it ban nothing."""
    doc = ["doc"] if "doc" in banned.columns else []
    if "id" in banned.columns:
        t = t.join(banned.select(*doc, "id").where("id is not null").distinct(), [*doc, "id"], "left_anti")
    if "title" in banned.columns:
        names = banned.where("title is not null").select(*doc, F.lower("title").alias("_title")).distinct()
        t = t.withColumn("_title", F.lower("title")).join(names, [*doc, "_title"], "left_anti").drop("_title")
    return t


def relatedness_to_others(t: DataFrame, links: DataFrame, articles: int) -> DataFrame:
    """`t` with `others`: the mean relatedness to the document's other topics, null for a lone topic."""
    x = t.select("doc", "id").join(t.select("doc", F.col("id").alias("o")), "doc").where("id <> o")
    x = x.withColumn("a", F.least("id", "o")).withColumn("b", F.greatest("id", "o"))
    m = x.join(related(x.select("a", "b"), links, articles), ["a", "b"]).groupBy("doc", "id").agg(six(F.avg("rel")).alias("others"))
    return t.join(m, ["doc", "id"], "left")


def index_weights(t: DataFrame) -> DataFrame:
    """`t` with `weight`: (2 * relatedness to others + occurrences by the document's most + spread) / 5."""
    most = F.max("occurrences").over(Window.partitionBy("doc"))
    w = (2 * F.coalesce("others", F.lit(0.0)) + F.col("occurrences") / most + F.col("spread")) / 5
    return t.withColumn("weight", F.round(w, 6))


#: Features of the link detector.
LINK_FEATURES = ["occurrences", "most_confidence", "mean_confidence", "others", "most_link_probability", "mean_link_probability", "generality", "first", "last", "spread"]


def with_generality(t: DataFrame, generality: DataFrame) -> DataFrame:
    """`t` with the generality of its topics, from (page_id, generality); null for topics no root category reaches."""
    return t.join(generality.select(F.col("page_id").alias("id"), "generality"), "id", "left")


def link_detector(rows: DataFrame, **how: object) -> Scorer:
    """A scorer that weighs topics by how likely a page would link to them, learnt from `link_training` rows with LINK_FEATURES."""
    return forest(rows, LINK_FEATURES, "linked", "weight", **how)


def own_links(about: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, id): what the pages that documents are about (doc, page_id) link to, and the pages themselves: what a link detector should find."""
    a = about.where("page_id is not null").select("doc", "page_id").distinct()
    out = a.join(links.where("pl_from is not null and pl_to is not null").select(F.col("pl_from").alias("page_id"), F.col("pl_to").alias("id")).distinct(), "page_id")
    return out.select("doc", "id").unionByName(a.select("doc", F.col("page_id").alias("id"))).distinct()


def best_topics(t: DataFrame, least: float) -> DataFrame:
    """Topics of at least a weight."""
    return t.where(F.col("weight") >= least)


def document_scores(t: DataFrame) -> DataFrame:
    """(doc, score): the sum of the topics' relatedness to the others."""
    return t.groupBy("doc").agg(F.round(F.sum(F.coalesce("others", F.lit(0.0))), 6).alias("score"))


def sense_training(cand: DataFrame, truth: DataFrame) -> DataFrame:
    """The candidates of ambiguous terms, `valid` if the sense is the true one; truth (doc, term, id)."""
    n = F.count("*").over(Window.partitionBy("doc", "term"))
    c = cand.withColumn("n", n).where("n > 1").drop("n")
    t = truth.select("doc", "term", F.col("id").alias("true_id")).distinct()
    return c.join(t, ["doc", "term"]).withColumn("valid", (F.col("id") == F.col("true_id")).cast("int")).drop("true_id")


def link_training(t: DataFrame, truth: DataFrame) -> DataFrame:
    """The topics, `linked` if the document links to them or is about them; truth (doc, id)."""
    x = truth.select("doc", "id", F.lit(1).alias("linked")).distinct()
    return t.join(x, ["doc", "id"], "left").withColumn("linked", F.coalesce("linked", F.lit(0)))


def evaluate(found: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """One row: found, correct, wanted, precision, recall, f over all documents together."""
    f, t = found.select(*on).distinct(), truth.select(*on).distinct()
    n = f.agg(F.count("*").alias("found")).withColumn("k", F.lit(1))
    c = f.join(t, on, "left_semi").agg(F.count("*").alias("correct")).withColumn("k", F.lit(1))
    w = t.agg(F.count("*").alias("wanted")).withColumn("k", F.lit(1))
    x = n.join(c, "k").join(w, "k")
    p, r = F.col("correct") / F.nullif("found", F.lit(0)), F.col("correct") / F.nullif("wanted", F.lit(0))
    x = x.withColumn("p", F.coalesce(p, F.lit(0.0))).withColumn("r", F.coalesce(r, F.lit(0.0)))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return x.select("found", "correct", "wanted", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f"))


def without_overlaps(refs: DataFrame) -> DataFrame:
    """The references of each document that stay if each, in order of start, longest first, then id, drops the later ones it overlaps.

    `refs` have (doc, start, end, id). A fold over one document's references.
    """
    others = [c for c in refs.columns if c not in ("doc", "start", "end", "id")]
    item = F.struct(F.col("start"), (-F.col("end")).alias("m"), F.col("id"), F.col("end"), *[F.col(c) for c in others])
    g = refs.groupBy("doc").agg(F.sort_array(F.collect_list(item)).alias("s"))
    start = F.struct(F.lit(-1).alias("upto"), F.filter("s", lambda x: F.lit(False)).alias("kept"))
    fold = F.aggregate("s", start, lambda a, x: F.when(x["start"] >= a["upto"], F.struct(x["end"].alias("upto"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a))
    return g.select("doc", F.explode(fold["kept"]).alias("x")).select("doc", "x.start", "x.end", "x.id", *[f"x.{c}" for c in others])


def region_bounds(marks: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """(at, region): the region that holds from each mark on; region 0 holds before the first.

    Marks (at, 'open' | 'close' | 'split'), in any order, one a place. An opened region is put on a stack, a split begins a new one in its place, a
    closed one gives way to that around it, with all that was seen there, or to a new one if there is none.
    """
    out, stack, new, here = [], [], 1, 0
    for at, kind in sorted(dict(reversed(marks)).items()):
        if kind == "close" and stack:
            here = stack.pop()
        else:
            if kind == "open":
                stack.append(here)
            here, new = new, new + 1
        out.append((at, here))
    return out


def by_repeat(refs: DataFrame, mode: str = "all", regions: DataFrame | None = None) -> DataFrame:
    """References kept by 'all', 'first' (of a topic in a document) or 'region' (of a topic in a region).

    `regions` (doc, start[, kind]): the marks of `region_bounds`, splits if no kind is given; text before the first is a region too.
    """
    if mode == "all":
        return refs
    if mode == "first":
        keys = ["doc", "id"]
    elif mode == "region":

        @F.pandas_udf("array<struct<at: int, region: int>>")
        def bounds(marks: pd.Series) -> pd.Series:
            return marks.map(lambda m: [{"at": a, "region": r} for a, r in region_bounds([(x["start"], x["kind"]) for x in m])])

        kind = F.col("kind") if "kind" in regions.columns else F.lit("split")
        m = regions.select("doc", F.struct(F.col("start").cast("int").alias("start"), kind.alias("kind")).alias("m")).groupBy("doc").agg(F.collect_list("m").alias("m"))
        refs = refs.join(m.select("doc", bounds("m").alias("bounds")), "doc", "left")
        passed = F.filter("bounds", lambda x: x["at"] < F.col("start"))
        refs = refs.withColumn("region", F.coalesce(F.try_element_at(passed, F.lit(-1))["region"], F.lit(0))).drop("bounds")
        keys = ["doc", "id", "region"]
    else:
        raise ValueError(f"no such mode: {mode}")
    r = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end"))
    return refs.withColumn("r", r).where("r = 1").drop("r", "region")


#: What renders a reference: its text, the topic's title and weight, and the number of the reference in its document.
Render = Callable[[str, str, float, int], str]


def wiki_tag(text: str, title: str, weight: float = 0.0, n: int = 0) -> str:
    """[[title|text]], or [[text]] if they differ in case at most or there is no title."""
    return f"[[{text}]]" if text.lower() == (title or text).lower() else f"[[{title}|{text}]]"


def html_tag(text: str, title: str, weight: float = 0.0, n: int = 0) -> str:
    """A link that names the topic."""
    return f'<a href="{html.escape((title or "").replace(" ", "_"))}">{text}</a>'


def tooltip_tag(text: str, title: str, weight: float = 0.0, n: int = 0) -> str:
    """A numbered link that shows the topic's title and weight when it is pointed at."""
    return f'<a id="topic{n}" href="{html.escape((title or "").replace(" ", "_"))}" title="{html.escape(title or "")} ({weight:.2f})">{text}</a>'


def colour(base: tuple[int, int, int], full: tuple[int, int, int], weight: float) -> str:
    """The colour between two by a weight of 0 to 1."""
    return f"rgb({','.join(str(round(b + (f - b) * min(1.0, max(0.0, weight)))) for b, f in zip(base, full, strict=True))})"


def coloured(render: Render, full: tuple[int, int, int], base: tuple[int, int, int] | None = None) -> Render:
    """`render` in the colour `full`, or, with a `base`, nearer to it the less the topic weighs."""
    return lambda text, title, weight=0.0, n=0: f'<span style="color:{colour(base or full, full, weight)}">{render(text, title, weight, n)}</span>'


def tag(docs: DataFrame, key: str, text: str, refs: DataFrame, render: Render = wiki_tag) -> DataFrame:
    """(doc, tagged): each text with its references (doc, start, end, title[, weight]; no overlaps) put in; texts without any as they are."""
    weight = F.col("weight") if "weight" in refs.columns else F.lit(0.0)
    marks = refs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end", "title", weight.alias("weight")))).alias("marks"))
    kind = docs.schema[key].dataType.simpleString()

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, m in zip(b["t"], b["marks"], strict=True):
                parts, i = [], 0
                for n, x in enumerate(m if m is not None else (), 1):
                    parts += [s[i : x["start"]], render(s[x["start"] : x["end"]], x["title"], x["weight"], n)]
                    i = x["end"]
                out.append("".join(parts) + s[i:] if s is not None else None)
            yield pd.DataFrame({"doc": b["doc"], "tagged": out})

    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).where("doc is not null")
    return rows.join(marks, "doc", "left").select("doc", "t", "marks").mapInPandas(put, f"doc {kind}, tagged string")
