"""Mixing sources to target weights along a training run."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .encode import TOKENIZERS, encode_texts

#: Texts in one bucket of the running sums, about.
TEXTS_A_BUCKET = 20_000


def source_key(col: Column) -> Column:
    """One name for spellings that differ in case, outer blanks, or hyphen, blank and underscore; null for nothing."""
    s = F.regexp_replace(F.lower(F.trim(col)), r"[-_\s]+", "_")
    return F.when(s != "", s)


def cumulative(knots: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, weights and integrals from 0 of a schedule that is linear between its knots."""
    t = np.array([k[0] for k in knots], float)
    w = np.array([k[1] for k in knots], float)
    return t, w, np.concatenate(([0.0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))))


def invert(knots: list[tuple[float, float]], demand: np.ndarray) -> np.ndarray:
    """The time at which the integral of the schedule reaches each `demand`."""
    t, w, total = cumulative(knots)
    j = np.clip(np.searchsorted(total, demand, side="right") - 1, 0, len(t) - 2)
    c, a = demand - total[j], (w[j + 1] - w[j]) / (t[j + 1] - t[j]) / 2
    # a x^2 + w x = c, in the form that is stable for a near 0
    root = w[j] + np.sqrt(np.maximum(0, w[j] ** 2 + 4 * a * c))
    x = np.where(root > 0, 2 * c / np.where(root > 0, root, 1), 0)
    return np.clip(t[j] + x, 0, 1)


class Mixture:
    """Texts of several sources, combined so that each source gets its weight of the total size.

    `texts` (doc_id, source, n_tokens): the distinct texts of each source, under the smallest id that has them;
    `plan`: source -> (wanted, available tokens, most repeats, tokens to take); `total`: tokens of the mixture.

    Spellings of a source are one (`source_key`). Texts without tokens (null, empty) and sources that have no
    target take no part; a text that a source holds under several ids counts once, so that none is used
    oftener than its cap. A target without a text can't be met: its share is 0 and the others keep their
    proportions. Targets of one source are added, the largest cap holds; null weights and caps count as 0.
    Unless `total` is given, it is the largest size at which every source with texts gets its weight within its cap;
    with a larger one, sources that are used up stay below their weight. So one short text bounds the whole mixture
    if it is all that a source has (column `used` of `shares` tells how much of each source is taken); only a source without any is skipped.
    A source with a schedule has its integral as weight. Without texts or targets the mixture is empty.

    Within a source texts are taken in the order of a seeded hash, whole passes first. Running sums go
    over buckets of that hash: sums per bucket, sums over buckets, then within each bucket, so that
    a source of any size is spread over the tasks.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, target_source: str, weight: str, cap: str,
                 total: float | None = None, schedules: dict[str, list[tuple[float, float]]] | None = None, seed: int = 7,
                 tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> None:
        goal = targets.select(source_key(F.col(target_source)).alias("source"), F.col(weight).alias("w"), F.col(cap).alias("r")).distinct()
        goal = goal.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("w"), F.max(F.coalesce("r", F.lit(0))).alias("r"))
        goals = {r["source"]: (float(r["w"]), int(r["r"])) for r in goal.collect()}  # the configuration, not data
        rows = docs.select(F.struct(F.col(key).cast("bigint").alias("doc_id"), source_key(F.col(source)).alias("source"), F.sha2(F.col(text), 256).alias("h")).alias("k"), F.col(text).alias("t"))
        rows = rows.where(F.col("k.source").isin(*goals) if goals else F.lit(False)).where("t is not null and t <> ''")
        sized = encode_texts(rows, "k", "t", tokenizer, folder, counts_only=True).select("k.*", "n_tokens").where("n_tokens > 0")
        self.texts = cut(sized.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")).drop("h"))
        have = {r["source"]: (r["n"], r["c"]) for r in self.texts.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c")).collect()}
        self.seed, self._wanted_total, self._goals, self._have = seed, total, goals, have
        self.schedules = schedules or {}
        self.buckets = max(1, math.ceil(max((c for _, c in have.values()), default=0) / TEXTS_A_BUCKET))

    @property
    def schedules(self) -> dict[str, list[tuple[float, float]]]:
        """source -> knots of its weight over time; those set replace the constant weights of the targets, and total and plan follow."""
        return self._schedules

    @schedules.setter
    def schedules(self, given: dict[str, list[tuple[float, float]]]) -> None:
        goals, have = self._goals, self._have
        self._schedules = {s: given.get(s) or [(0.0, w), (1.0, w)] for s, (w, _) in goals.items()}
        weight = {s: float(cumulative(knots)[2][-1]) for s, knots in self._schedules.items()}
        usable = {s: (weight[s], r) for s, (_, r) in goals.items() if s in have and weight[s] > 0 and r > 0}
        total = self._wanted_total
        if total is None:
            total = min((have[s][0] * r / w for s, (w, r) in usable.items()), default=0.0)
        self.total = float(total)
        self.plan = {s: (weight[s], have.get(s, (0, 0))[0], r, min(weight[s] * self.total, have[s][0] * r) if s in usable else 0.0) for s, (_, r) in goals.items()}

    def _table(self) -> DataFrame:
        rows = [(s, float(q), int(r), int(a)) for s, (_, a, r, q) in self.plan.items() if q > 0]
        return self.texts.sparkSession.createDataFrame(rows, "source string, quota double, cap int, available bigint")

    def draws(self) -> DataFrame:
        """(position, source, doc_id, copy, n_tokens), in the order of position.

        A source's tokens are demanded over time by the integral of its weight schedule; a copy's position is
        the time at which its demand reaches the middle of the copy. Positions lie in 0..1; copies count from 1.
        """
        h = F.xxhash64(F.lit(self.seed), F.col("doc_id"))
        t = self.texts.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(self.buckets)))
        per = t.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
        over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(over), F.lit(0)).alias("before"))
        inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        t = t.withColumn("upto", F.sum("n_tokens").over(inside)).join(per, ["source", "bucket"])
        t = t.join(F.broadcast(self._table()), "source")  # one row for each target
        middle = F.col("before") + F.col("upto") - F.col("n_tokens") / 2
        # copy c (from 0) has its middle at c * available + middle; it is in while that is within the quota
        copies = F.least(F.floor((F.col("quota") - middle) / F.col("available")).cast("int") + 1, F.col("cap"))
        t = t.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        demand = (F.col("copy") - 1) * F.col("available") + middle
        plan, schedules = self.plan, self.schedules

        @F.pandas_udf("double")
        def place(source: pd.Series, at: pd.Series) -> pd.Series:
            out = np.zeros(len(at))
            for s in source.unique():
                here = (source == s).to_numpy()
                knots = schedules[s]
                whole = cumulative(knots)[2][-1]
                out[here] = invert(knots, at[here].to_numpy() / plan[s][3] * whole)
            return pd.Series(out)

        out = t.select(place("source", demand).alias("position"), "source", "doc_id", "copy", "n_tokens")
        return out.orderBy("position", "source", "doc_id", "copy")

    def shares(self) -> DataFrame:
        """(source, wanted, reached, tokens, available, texts, draws, used) of every target; used: the part of the available tokens that is drawn at all."""
        once = F.sum(F.when(F.col("copy") == 1, F.col("n_tokens"))).alias("once")
        got = self.draws().groupBy("source").agg(once, F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts"), F.count("*").alias("draws"))
        rows = [(s, float(w), int(a)) for s, (w, a, _, _) in self.plan.items()]
        goal = self.texts.sparkSession.createDataFrame(rows, "source string, wanted double, available bigint")
        all_tokens = got.agg(F.sum("tokens").alias("all"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        total = all_tokens.first()["all"] or 0
        reached = F.round(F.coalesce("tokens", F.lit(0)) / F.lit(max(1, total)), 6).alias("reached")
        used = F.round(F.coalesce("once", F.lit(0)) / F.greatest("available", F.lit(1)), 6).alias("used")
        return goal.join(got, "source", "left").select("source", "wanted", reached, zero("tokens"), "available", zero("texts"), zero("draws"), used)


def ramp(weights: dict[str, float], first: set[str]) -> dict[str, list[tuple[float, float]]]:
    """Schedules of the same integrals: sources in `first` fall from 1.5 to 0.5 times their weight, the others rise."""
    return {s: [(0.0, w * (1.5 if s in first else 0.5)), (1.0, w * (0.5 if s in first else 1.5))] for s, w in weights.items()}
