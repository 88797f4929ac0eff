"""Subject areas of texts: labelling functions aggregated by a latent model that learns their accuracies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import for_each_part, heavy_keys, with_part
from ..session import cut
from .mixture import source_key

#: Most labelled documents that the lexicon is fitted on, in the order of a hash.
LABELLED = 200_000
#: A term must occur in so many labelled documents.
SUPPORT = 4
#: Most terms of a subject, those with most evidence first: with ten subjects the lexicon takes at most some 20 MB in a task.
TERMS_A_SUBJECT = 20_000

_TAGS = re.compile(r"<[^<>]{1,200}>")
# a word, the end of a sentence, the end of a section (a line of prose)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;](?=\s)|[\r\n]")
_ENDS = {".": -2, "!": -2, "?": -2, ";": -2, "\r": -3, "\n": -3}


def tokens(text: str) -> list[str]:
    """The words of a text in lower case, with the ends of its sentences and lines."""
    return _TOKEN.findall((_TAGS.sub(" ", text) if "<" in text else text).lower())


def terms(toks: list[str]) -> set[str]:
    """The words between ends, and their pairs and triples."""
    out: set[str] = set()
    a = b = None
    for w in toks:
        if w in _ENDS:
            a = b = None
            continue
        out.add(w)
        if b is not None:
            out.add(f"{b} {w}")
            if a is not None:
                out.add(f"{a} {b} {w}")
        a, b = b, w
    return out


def fit_lexicon(labelled: DataFrame, subjects: list[str], most: int = TERMS_A_SUBJECT) -> tuple[list[str], np.ndarray]:
    """Terms and their log odds for each subject, from documents (text, labels); only telling terms are kept, at most `most` for the subject they tell most of.

    The odds are of a cautious share (one standard error below the share seen), so rare terms weigh less. Counts, odds and
    choice are made in Spark; only the chosen terms come to the driver.
    """
    k, at = len(subjects), {s: i for i, s in enumerate(subjects)}
    cols = [f"c{i}" for i in range(k)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat: list[str] = []
            sizes, votes = [], np.zeros((len(b), k))
            for j, (text, labels) in enumerate(zip(b["text"], b["labels"], strict=True)):
                for s in labels:
                    votes[j, at[s]] += 1 / len(labels)
                t = terms(tokens(text))
                flat.extend(t)
                flat.append("")
                sizes.append(len(t) + 1)
            codes, names = pd.factorize(np.array(flat, dtype=object))
            of = np.repeat(np.arange(len(b)), sizes)
            yield pd.DataFrame({"term": names, **{c: np.bincount(codes, votes[of, i], len(names)) for i, c in enumerate(cols)}})

    c = labelled.mapInPandas(count, "term string, " + ", ".join(f"{x} double" for x in cols)).groupBy("term").agg(*[F.sum(x).alias(x) for x in cols])
    all_ = sum(F.col(x) for x in cols)
    c = cut(c.where((F.col("term") == "") | ((all_ >= SUPPORT) & (F.greatest(*cols, F.lit(0.0)) >= 0.4 * all_))))
    base = c.where("term = ''").first()
    if base is None or not sum(base[x] for x in cols):
        return [], np.zeros((0, k), np.float32)
    base = np.array([base[x] for x in cols]) + 0.5
    prior = base / base.sum()

    def odds(x: str, p: float) -> Column:
        share = (F.col(x) + p) / (all_ + 1)
        cautious = F.greatest(F.lit(0.01), F.least(F.lit(0.99), share - F.sqrt(share * (1 - share) / (all_ + 1))))
        return F.greatest(F.lit(-3.0), F.least(F.lit(4.0), F.ln(cautious / (1 - cautious)) - float(np.log(p / (1 - p)))))

    c = c.where("term <> ''").select("term", all_.alias("n"), F.array(*[odds(x, float(p)) for x, p in zip(cols, prior, strict=True)]).alias("odds"))
    best = F.array_max("odds")
    c = c.withColumn("best", best).where("best > 1").withColumn("of", F.array_position("odds", F.col("best")))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc(F.col("n") * F.col("best")), "term"))
    rows = c.withColumn("r", rank).where(F.col("r") <= most).select("term", F.transform("odds", lambda x: F.round(x, 3)).alias("odds")).toPandas()
    return rows["term"].tolist(), np.array(rows["odds"].tolist(), np.float32).reshape(-1, k)


class Lexicon:
    """Terms as numbers, so that a batch of texts is looked up in arrays: words, then pairs and triples of their numbers."""

    def __init__(self, terms: list[str], odds: np.ndarray) -> None:
        split = [t.split(" ") for t in terms]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in split for w in t}))}
        self.v, self.odds, self.k = len(self.vocabulary), odds, odds.shape[1]
        self.known: list[tuple[np.ndarray, np.ndarray]] = []
        for n in (1, 2, 3):
            which = np.array([i for i, t in enumerate(split) if len(t) == n], np.int64)
            codes = np.array([self._code([self.vocabulary[w] for w in split[i]]) for i in which], np.int64)
            order = np.argsort(codes)
            self.known.append((codes[order], which[order]))

    def _code(self, ids: list[int]) -> int:
        x = 0
        for i in ids:
            x = x * self.v + i
        return x

    def read(self, texts: list[str]) -> pd.DataFrame:
        """(text, i, c, n, sec, m): sentences and sections of each text by subject (c, sec), and how many have one at all (n, m).

        A sentence speaks of the subject whose terms weigh most in it, each term counting once, if they weigh enough and
        more than those of any other.
        """
        get, flat = {**self.vocabulary, **_ENDS}.get, []
        for t in texts:
            flat.extend(map(get, tokens(t), repeat(-1)))
            flat.append(-4)
        ids = np.array(flat, np.int64)
        text, section, sentence = (np.cumsum(ids <= x) for x in (-4, -3, -2))
        at, term = [], []
        code, fits = ids, ids >= 0
        for n, (codes, which) in enumerate(self.known):
            if n:
                code, fits = code[:-1] * self.v + ids[n:], fits[:-1] & (ids[n:] >= 0)
            here = np.flatnonzero(fits)
            if len(codes) and len(here):
                j = np.minimum(np.searchsorted(codes, code[here]), len(codes) - 1)
                hit = codes[j] == code[here]
                at.append(here[hit])
                term.append(which[j[hit]])
        cols = ["text", "i", "c", "n", "sec", "m"]
        at, term = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, term))
        if not len(at):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})
        _, one = np.unique(sentence[at] * len(self.odds) + term, return_index=True)  # in the order of sentences
        at, term = at[one], term[one]
        starts = np.flatnonzero(np.append(True, sentence[at[1:]] != sentence[at[:-1]]))
        v = np.add.reduceat(self.odds[term], starts, axis=0)
        top = v.argmax(axis=1)
        best = v[np.arange(len(v)), top]
        v[np.arange(len(v)), top] = -9.0
        sure = (best > 1.2) & (best - v.max(axis=1) > 0.7)
        at, top = at[starts[sure]], top[sure]
        x = pd.DataFrame({"text": text[at], "section": section[at], "i": top})
        out = x.groupby(["text", "i"]).agg(c=("i", "size"), sec=("section", "nunique")).reset_index()
        of = x.groupby("text").agg(n=("i", "size"), m=("section", "nunique"))
        return out.join(of, on="text")[cols]


#: Texts that are looked up together.
TEXTS_AT_ONCE = 1_000
#: Levels of the labelling functions: lexicon and section (4 counts x 6 shares x 3, which say the same sentences twice, so together), address, source; and of the
#: readers' labels (none, another subject, this one).
LEVELS = (72, 4, 3, 3)
#: How much each counts beside the first; the weaker functions depend on it.
WEIGHTS = (1.0, 0.3, 0.3, 1.0)


def learn(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The posterior of 'is about the subject' for each pattern of votes (one column a function).

    A latent class model: given the class the functions vote independently; how often each gives each vote in
    either class, its accuracy, is learnt by expectation maximisation from the counts of the patterns, those of the readers, who err,
    too; where no reader has looked, theirs abstains. It starts from what readers say of texts with the same vote of the first function,
    or, where few have been read, with the same share of sentences. The posterior returned is that of the functions alone, without the readers.
    """
    first, share = pattern[:, 0], pattern[:, 0] // 3 % 6
    said, read = count * (pattern[:, 3] == 2), count * (pattern[:, 3] > 0)
    rate = (np.bincount(share, said, 6) + 0.5) / (np.bincount(share, read, 6) + 1)
    post = (np.bincount(first, said, LEVELS[0])[first] + 2 * rate[share]) / (np.bincount(first, read, LEVELS[0])[first] + 2)

    def likelihood(post: np.ndarray, readers: bool) -> np.ndarray:
        like = np.zeros((len(post), 2))
        for y in (0, 1):
            p = count * (post if y else 1 - post)
            like[:, y] = np.log((p.sum() + 1) / (count.sum() + 2))
            for j, levels in enumerate(LEVELS):
                seen = np.bincount(pattern[:, j], weights=p, minlength=levels) + 0.5
                if j == 3:
                    seen[0] = 0
                    if readers:
                        like[:, y] += WEIGHTS[j] * np.log(np.append(1.0, seen[1:] / seen[1:].sum()))[pattern[:, j]]
                else:
                    like[:, y] += WEIGHTS[j] * np.log(seen / seen.sum())[pattern[:, j]]
        return 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))

    for _ in range(rounds):
        new = likelihood(post, True)
        change = np.abs(new - post).max(initial=0)
        post = new
        if change < 1e-6:
            break
    return likelihood(post, False)


def assign_subjects(docs: DataFrame, key: str, text: str, page: str, source: str, labels: DataFrame, label_key: str, label: str,
                    subjects: DataFrame, subject: str, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, subject, posterior, share): the one or two subjects that a text is mainly about.

    Four labelling functions look at each text and subject that its sentences speak of. Lexicon: how many sentences, and which share of
    those on any subject, speak the subject's words, which come from labelled documents of all languages.
    Section: whether it comes up in several sections. Address: what the other texts about the same page are about. Source: whether the
    source favours it. Their votes are counted by pattern in Spark (some thousands at most, whatever the
    number of texts), the latent model is learnt from the counts and the readers' labels, and each text gets the subjects of a posterior
    of one half or more, two at most (by posterior, share, then name).

    Labels in other spellings (case, outer blanks) are read, others and null ones are not; repeated ones count once. Null and
    blank texts and texts on no subject give no row, neither do texts of a null id. Without labels there is no lexicon and no row.
    Texts are read whole. A page or source of many rows is split before its join.
    """
    names = sorted(r[0] for r in subjects.select(F.lower(F.trim(F.col(subject)))).distinct().collect() if r[0])
    empty = docs.sparkSession.createDataFrame([], "doc_id bigint, subject string, posterior double, share double")
    if not names:
        return empty
    label_of = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    lab = labels.select(F.col(label_key).cast("bigint").alias("doc_id"), F.lower(F.trim(F.col(label))).alias("s")).where(F.col("s").isin(*names)).distinct()
    lab = lab.groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("labels")).orderBy(F.xxhash64("doc_id")).limit(labelled)
    base = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(page).cast("bigint").alias("page"), source_key(F.col(source)).alias("source"))
    base = base.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    lab = cut(lab)
    words, odds = fit_lexicon(base.join(lab, "doc_id").select("text", "labels"), names)
    if not words:
        return empty
    sent = docs.sparkSession.sparkContext.broadcast((words, odds))  # TERMS_A_SUBJECT terms of each subject at most

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(*sent.value)
        for b in batches:
            for j in range(0, len(b), TEXTS_AT_ONCE):
                part = b.iloc[j : j + TEXTS_AT_ONCE].reset_index(drop=True)
                got = lexicon.read(part["text"].tolist())
                yield part.drop(columns="text").astype({"page": "Int64"}).join(got.set_index("text"), how="inner")

    votes = cut(base.mapInPandas(vote, "doc_id bigint, page bigint, source string, i int, c int, n int, sec int, m int"))
    share = F.col("c") / F.col("n")
    lex = F.least("c", F.lit(4)) - 1
    lex = lex * 6 + sum(F.when(share >= x, 1).otherwise(0) for x in (0.12, 0.2, 0.27, 0.35, 0.6))
    sec = F.when(F.col("sec") >= 2, 2).when(F.col("m") < 3, 1).otherwise(0)
    # address: the page's other texts
    pages = votes.where("page is not null").groupBy("page", "i").agg(F.sum(share).alias("of_page"), F.count("*").alias("rows"))
    whole = pages.groupBy("page").agg(F.sum("of_page").alias("page_all"), F.sum("rows").alias("rows"))
    heavy = heavy_keys(whole, "page", "rows")
    v = with_part(votes, "page", heavy, [F.col("doc_id")])
    side = pages.select("page", "i", "of_page").join(whole.select("page", "page_all"), "page")
    v = v.join(for_each_part(side, "page", heavy), ["page", "_part", "i"], "left")
    others = F.col("page_all") - 1
    there = (F.col("of_page") - share) / others
    addr = F.when(F.col("page").isNull() | (others < 0.5), 0).when(there < 0.1, 1).when(there < 0.4, 2).otherwise(3)
    # source: lift of the subject in the source; sources by subjects are a small table
    by_source = votes.groupBy("source", "i").agg(F.sum(share).alias("x"))
    lift = by_source.withColumn("of_source", F.sum("x").over(Window.partitionBy("source"))).withColumn("of_subject", F.sum("x").over(Window.partitionBy("i")))
    overall = by_source.agg(F.sum("x")).first()[0] or 1.0
    lift = lift.select(F.col("source").alias("s2"), F.col("i").alias("i2"), (F.col("x") * F.lit(overall) / (F.col("of_source") * F.col("of_subject"))).alias("lift"))
    v = v.join(lift, F.col("source").eqNullSafe(F.col("s2")) & (F.col("i") == F.col("i2")), "left")
    src = F.when(F.coalesce("lift", F.lit(1.0)) < 0.8, 0).when(F.coalesce("lift", F.lit(1.0)) < 1.25, 1).otherwise(2)
    v = cut(v.select("doc_id", "i", share.alias("share"), (lex * 3 + sec).cast("int").alias("l0"), addr.cast("int").alias("l1"), src.cast("int").alias("l2")))
    said = F.when(F.col("labels").isNull(), 0).when(F.array_contains("labels", label_of), 2).otherwise(1)
    seen = v.join(lab, "doc_id", "left").groupBy("l0", "l1", "l2", said.alias("l3")).agg(F.count("*").alias("n")).toPandas()
    if not len(seen):
        return empty
    seen["posterior"] = learn(seen[["l0", "l1", "l2", "l3"]].to_numpy().astype(int), seen["n"].to_numpy().astype(float))
    seen = seen.drop(columns=["n", "l3"]).drop_duplicates(["l0", "l1", "l2"])
    table = docs.sparkSession.createDataFrame(seen.astype({f"l{j}": int for j in range(3)}), "l0 int, l1 int, l2 int, posterior double")
    v = v.join(F.broadcast(table), ["l0", "l1", "l2"])  # at most 72 * 4 * 3 rows
    v = v.where("posterior >= 0.5").select("doc_id", label_of.alias("subject"), "posterior", "share")
    rank = Window.partitionBy("doc_id").orderBy(F.desc("posterior"), F.desc("share"), "subject")
    return v.withColumn("r", F.row_number().over(rank)).where("r <= 2").drop("r")
