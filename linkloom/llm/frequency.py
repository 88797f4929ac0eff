"""Occurrences and records of every value, word and n-gram of a collection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop

#: Tokens in one suffix array; a longer record has one of its own.
TOKENS_AT_ONCE = 500_000

_LETTERS = regex.compile(r"\p{L}+")


def words(s: str) -> list[str]:
    """The maximal runs of letters, of any alphabet, in lower case."""
    return [w.lower() for w in _LETTERS.findall(s)]


def whole(s: str) -> list[str]:
    """The value itself as the only token."""
    return [s]


def folded(col: Column) -> Column:
    """Lower case, runs of spaces, tabs and no-break spaces made one space, ends trimmed; null for nothing."""
    s = F.trim(F.regexp_replace(F.lower(col), "[ \t ]+", " "))
    return F.when(s != "", s)


def suffix_array(tokens: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and how many tokens each has in common with the one before it; a suffix ends with its record, at `end`.

    Prefix doubling: suffixes sorted by their first h tokens are sorted by 2 h by the ranks of their halves, those only that have an equal, until no two that can still
    be told apart are equal; equal ones keep the order of their places. The ranks of every h are kept, so the common prefix of
    two neighbours is put together from the longest blocks down, for all at once.
    """
    n = len(tokens)
    left = end - np.arange(n)
    order, h = np.argsort(tokens, kind="stable"), 1
    new = np.append(True, tokens[order[1:]] != tokens[order[:-1]])
    rank = np.empty(n, np.int32)  # of a group of equals: the place of its first in the order
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    ranks = [rank]
    while True:
        at = np.flatnonzero(~new | ~np.append(new[1:], True))  # those that have an equal
        which = order[at]
        goes_on = left[which] > h
        if not goes_on.any():
            break
        half = np.zeros(len(at), np.int64)  # 0: the record ends within the first h tokens
        half[goes_on] = rank[which[goes_on] + h].astype(np.int64) + 1
        key = rank[which].astype(np.int64) * (n + 1) + half
        by = np.argsort(key, kind="stable")
        order[at], key = which[by], key[by]
        fresh = np.append(True, key[1:] != key[:-1])
        new[at] = fresh
        rank = rank.copy()
        rank[order[at]] = at[fresh][np.cumsum(fresh) - 1]
        ranks.append(rank)
        h *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for j in range(len(ranks) - 1, -1, -1):
        h, have = 1 << j, common[1:]
        fits = (left[a] >= have + h) & (left[b] >= have + h)
        x, y = np.where(fits, a + have, 0), np.where(fits, b + have, 0)
        common[1:] += h * (fits & (ranks[j][x] == ranks[j][y]))
    return order, common


class _Least:
    """The least of any stretch of an array, by a table of the minima of all stretches of 2^j."""

    def __init__(self, x: np.ndarray) -> None:
        self.rows = [x.astype(np.int32)]
        while 2 << (len(self.rows) - 1) <= len(x):
            r, h = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(r[:-h], r[h:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of a..b, both included."""
        j = np.frexp(b - a + 1)[1] - 1
        out = np.zeros(len(a), np.int32)
        for k in np.unique(j):
            at = j == k
            out[at] = np.minimum(self.rows[k][a[at]], self.rows[k][b[at] - (1 << k) + 1])
        return out


def suffix_counts(tokens: np.ndarray, record: np.ndarray, weight: np.ndarray, most: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1, 2, ... (up to `most`, or all): (n, first position, occurrences, records) of each n-gram that lies within a record.

    `tokens` are the records' token numbers one after another, `record` the record of each, not descending.
    One suffix array with its common prefixes serves every n. Suffixes that share n tokens stand side by side, an interval of common
    prefix >= n: its length (or weight) is the n-gram's occurrences. Each suffix and the last one of the same record before it are a
    duplicate in every interval that holds both, that is for every n up to the least common prefix between them; an interval's records are its
    length less its duplicates.
    """
    if not len(tokens):
        return
    sizes = np.bincount(record)
    end = np.cumsum(sizes)[record]
    order, common = suffix_array(tokens, end)
    left = (end - np.arange(len(tokens)))[order]
    by = np.argsort(record[order], kind="stable")
    twin = np.flatnonzero(record[order][by[1:]] == record[order][by[:-1]])
    first, second = by[twin], by[twin + 1]
    shared = _Least(common).of(first + 1, second) if len(twin) else np.zeros(0, np.int32)
    for n in range(1, int(sizes.max() if most is None else min(most, sizes.max())) + 1):
        fits = left >= n
        at = np.flatnonzero(fits)
        if not len(at):
            return
        new = common[at] < n  # a suffix too short for n never stands between two that share n tokens
        starts = np.flatnonzero(new)
        interval = np.cumsum(new) - 1
        place = np.zeros(len(order), np.int64)
        place[at] = interval
        again = second[shared >= n]
        twice = np.bincount(place[again], minlength=len(starts))
        yield n, order[at[starts]], np.add.reduceat(weight[order[at]], starts), np.diff(np.append(starts, len(at))) - twice


def term_counts(df: DataFrame, field: str, tokenize: Callable[[str], list[str]], most: int | None = 1, weight: str | None = None) -> DataFrame:
    """(n, term, occurrences, records) of every n-gram of up to `most` tokens (None: of any number) in `field`, over all rows.

    A row is a record; rows that should count once must be distinct before. Null and empty fields have no terms.
    Tokens of a term are joined by a space. With `weight` a term occurs so often per row (null: 0). An empty
    table has no terms. Every input split builds suffix arrays with their common prefixes over its own records (of TOKENS_AT_ONCE tokens,
    long records whole) and reads every n from them; as no record lies in two of them, occurrences and records of the parts add up; the sums start before the shuffle,
    so frequent terms send one row a part.
    """
    src = df.select(F.col(field).cast("string").alias("f"), (F.coalesce(F.col(weight).cast("bigint"), F.lit(0)) if weight else F.lit(1)).cast("bigint").alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat: list[str] = []
        ends: list[int] = []
        weights: list[int] = []

        def flush() -> Iterator[pd.DataFrame]:
            if flat:
                codes, names = pd.factorize(np.array(flat, dtype=object))
                sizes = np.diff(np.concatenate(([0], ends)))
                rec = np.repeat(np.arange(len(sizes)), sizes)
                for n, first, occ, recs in suffix_counts(codes, rec, np.repeat(np.array(weights, np.int64), sizes), most):
                    term = names[codes[first]]
                    for j in range(1, n):
                        term = term + " " + names[codes[first + j]]
                    yield pd.DataFrame({"n": np.int32(n), "term": term, "occurrences": occ, "records": recs})
            flat.clear()
            ends.clear()
            weights.clear()

        for b in batches:
            for f, w in zip(b["f"], b["w"], strict=True):
                flat.extend(tokenize(f))
                ends.append(len(flat))
                weights.append(w)
                if len(flat) >= TOKENS_AT_ONCE:
                    yield from flush()
        yield from flush()

    part = src.where("f is not null and f <> ''").mapInPandas(run, "n int, term string, occurrences bigint, records bigint")
    return part.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, which tells their order."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _fingerprints(base: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the n tokens at each place, by doubling: a gram is its first and last block of 2^k tokens and its length."""
    out, h, size = np.zeros(len(at), np.uint64), base, 1
    top = int(n.max()) if len(n) else 0
    while size <= top:
        here = (n >= size) & (n < 2 * size)
        out[here] = _mix(_mix(h[at[here]], h[at[here] + n[here] - size]), n[here].astype(np.uint64))
        if 2 * size <= top:
            h = _mix(h[:-size], h[size:])
        size *= 2
    return out


def _next_doubled(known: np.ndarray, n: int, end: np.ndarray) -> np.ndarray:
    """(position, n) of the grams of n tokens, a power of two, that fit their record and whose halves repeat."""
    if n == 1:
        at = np.arange(len(end))
    else:
        half = np.zeros(len(end) + 1, bool)
        half[known[known[:, 1] == n // 2, 0]] = True
        at = np.flatnonzero(half[:-1])
        at = at[at + n <= end[at]]
        at = at[half[at + n // 2]]
    return np.column_stack((at, np.full(len(at), n)))


def _next_halved(known: np.ndarray, gap: int, end: np.ndarray) -> np.ndarray:
    """(position, n) in the middle of each gap of that many tokens between two lengths of different counts; `known` is sorted."""
    at, n, occ = known[:, 0], known[:, 1], known[:, 2]
    last = np.append(at[1:] != at[:-1], True)[: len(at)]
    inner = np.zeros(len(at), bool)
    inner[:-1] = ~last[:-1] & (occ[1:] != occ[:-1]) & (n[1:] - n[:-1] == gap)
    ask = inner | (last & (n >= gap))
    at, n = at[ask], n[ask] + gap // 2
    fits = at + n <= end[at]
    return np.column_stack((at[fits], n[fits]))


def _merged(state: pd.DataFrame) -> np.ndarray:
    """What is known of a block after its last questions, sorted: position, n, occurrences, records, whether its first place.

    Of lengths of one count at a place the inner ones say nothing more and go.
    """
    known = np.frombuffer(state["known"].iat[0], np.int64).reshape(-1, 5)
    if state["t_k"].iat[0] is not None:
        ask = np.frombuffer(state["ask"].iat[0], np.int64).reshape(-1, 4)
        k, occ, recs, mine = (np.asarray(state[f"t_{c}"].iat[0]).astype(np.int64) for c in ("k", "occ", "recs", "mine"))
        told = np.zeros((int(ask[:, 2].max()) + 1, 3), np.int64)
        told[k] = np.column_stack((occ, recs, mine))
        of = told[ask[:, 2]]
        new = np.column_stack((ask[:, 0], ask[:, 1], of[:, 0], of[:, 1], of[:, 2] * ask[:, 3]))
        known = np.vstack((known, new[of[:, 0] > 0]))
        known = known[np.lexsort((known[:, 1], known[:, 0]))]
        like = (known[1:, 0] == known[:-1, 0]) & (known[1:, 2] == known[:-1, 2])
        known = known[~(np.append(False, like) & np.append(like, False))[: len(known)]]
    return known


#: Tokens in one block of `repeats`; a longer record is one of its own.
TOKENS_IN_BLOCK = 50_000


def repeats(df: DataFrame, keys: list[str], field: str, tokenize: Callable[[str], list[str]], least: int = 2) -> DataFrame:
    """(keys, at, n_from, n_to, occurrences, records) of all n-grams, of any n, with more than `least` occurrences, as intervals.

    An interval stands for one n-gram of each n in n_from..n_to: the n tokens from token `at` (from 0) of the record
    with these keys. They have the same places, so the same occurrences and records; each repeated n-gram lies in just one
    interval, so there are no more than twice as many as tokens, however long the repeats are (`spelled` gives the n-grams of one n).
    A row is a record; null and empty fields have no tokens, an empty table no intervals. A record must fit a task.

    These are the common-prefix intervals of the suffixes of all splits together. Lengths are doubled until nothing repeats; then each gap
    between two lengths of different counts is halved until it is closed. Counts never rise with n, so where the ends of
    a gap agree its inside does, and all places of a gram meet the same gaps, so every count is over the whole table.
    n-grams are told apart by fingerprints of 128 bits. Blocks of records count their own first and send each n-gram once a round.
    """
    docs = cut(df.where(F.col(field).isNotNull()).select(F.monotonically_increasing_id().alias("rec"), *keys, F.col(field).cast("string").alias("f")))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recs: list[int] = []
        toks: list[list[str]] = []

        def flush() -> Iterator[pd.DataFrame]:
            if any(toks):
                codes, names = pd.factorize(np.array([w for x in toks for w in x], dtype=object))
                d = [pd.util.hash_array(names, hash_key=k, categorize=False).tobytes() for k in ("linkloom-grams-1", "linkloom-grams-2")]
                sizes = np.array([len(x) for x in toks], np.int64)
                yield pd.DataFrame({"block": [recs[0]], "recs": [np.array(recs, np.int64).tobytes()], "sizes": [sizes.tobytes()], "codes": [codes.astype(np.int32).tobytes()], "d1": d[:1], "d2": d[1:]})
            recs.clear()
            toks.clear()

        n = 0
        for b in batches:
            for r, f in zip(b["rec"], b["f"], strict=True):
                recs.append(r)
                toks.append(tokenize(f))
                n += len(toks[-1])
                if n >= TOKENS_IN_BLOCK:
                    yield from flush()
                    n = 0
        yield from flush()

    told_ddl = {"t_k": "int", "t_occ": "bigint", "t_recs": "bigint", "t_mine": "boolean"}
    base = "block bigint, recs binary, sizes binary, codes binary, d1 binary, d2 binary"

    def step(doubled: bool, size: int) -> Callable:
        def run(state: pd.DataFrame) -> pd.DataFrame:
            s = state.iloc[0]
            sizes, codes = np.frombuffer(s["sizes"], np.int64), np.frombuffer(s["codes"], np.int32)
            end, rec = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(sizes)), sizes)
            known = _merged(state)
            ask = (_next_doubled if doubled else _next_halved)(known, size, end)
            h1, h2 = (_fingerprints(np.frombuffer(s[d], np.uint64)[codes], ask[:, 0], ask[:, 1]).view(np.int64) for d in ("d1", "d2"))
            by = np.lexsort((ask[:, 0], h2, h1))
            ask, h1, h2 = ask[by], h1[by], h2[by]
            new = np.ones(len(ask), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            fresh = new.copy()
            fresh[1:] |= rec[ask[1:, 0]] != rec[ask[:-1, 0]]
            k, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            recs = np.add.reduceat(fresh.astype(np.int64), starts) if len(starts) else starts
            out = {c: [s[c]] for c in ("block", "recs", "sizes", "codes", "d1", "d2")}
            out |= {"known": [known.tobytes()], "ask": [np.column_stack((ask, k, new)).astype(np.int64).tobytes()]}
            out |= {"h1": [h1[starts]], "h2": [h2[starts]], "occ": [np.diff(np.append(starts, len(ask)))], "n_recs": [recs]}
            return pd.DataFrame(out)

        return run

    def intervals(state: pd.DataFrame) -> pd.DataFrame:
        recs, sizes = (np.frombuffer(state[c].iat[0], np.int64) for c in ("recs", "sizes"))
        known = _merged(state)
        start, rec = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        at, occ = known[:, 0], known[:, 2]
        ends = known[np.append((at[1:] != at[:-1]) | (occ[1:] != occ[:-1]), True)[: len(at)]]
        low = np.ones(len(ends), np.int64)
        low[1:] += np.where(ends[1:, 0] == ends[:-1, 0], ends[:-1, 1], 0)
        e, low = ends[ends[:, 4] == 1], low[ends[:, 4] == 1]
        r = rec[e[:, 0]]
        out = {"rec": recs[r], "at": (e[:, 0] - start[r]).astype(np.int32), "n_from": low.astype(np.int32), "n_to": e[:, 1].astype(np.int32)}
        return pd.DataFrame(out | {"occurrences": e[:, 2], "records": e[:, 3]})

    blocks = cut(docs.select("rec", "f").mapInPandas(block, base))
    state = blocks.select("*", F.lit(b"").alias("known"), F.lit(b"").alias("ask"), *[F.lit(None).cast(f"array<{x}>").alias(c) for c, x in told_ddl.items()])
    old: list[DataFrame] = [blocks]
    doubled, size, top = True, 1, 0
    while doubled or size > 1:
        asked = cut(state.groupBy("block").applyInPandas(step(doubled, size), f"{base}, known binary, ask binary, h1 array<bigint>, h2 array<bigint>, occ array<bigint>, n_recs array<bigint>"))
        a = asked.select("block", F.posexplode(F.arrays_zip("h1", "h2", "occ", "n_recs")).alias("k", "a")).select("block", "k", "a.*")
        counts = a.groupBy("h1", "h2").agg(F.sum("occ").alias("t_occ"), F.sum("n_recs").alias("t_recs"), F.min("block").alias("first")).where(F.col("t_occ") > least)
        told = a.join(counts, ["h1", "h2"]).select("block", F.col("k").alias("t_k"), "t_occ", "t_recs", (F.col("first") == F.col("block")).alias("t_mine"))
        told = cut(told.groupBy("block").agg(*[F.collect_list(c).alias(c) for c in told_ddl]))
        drop(*old)
        old = [asked, told]
        state = asked.drop("h1", "h2", "occ", "n_recs").join(told, "block", "left")
        if doubled and told.isEmpty():
            doubled, size = False, top
        elif doubled:
            top, size = size, size * 2
        else:
            size //= 2
    out = state.groupBy("block").applyInPandas(intervals, "rec bigint, at int, n_from int, n_to int, occurrences bigint, records bigint")
    return out.join(docs.select("rec", *keys), "rec").select(*keys, "at", "n_from", "n_to", "occurrences", "records")


def spelled(intervals: DataFrame, df: DataFrame, keys: list[str], field: str, tokenize: Callable[[str], list[str]], n: int) -> DataFrame:
    """(term, occurrences, records) of the n-grams of n tokens that `repeats` of `df` found; `keys` must tell the records of `df` by their text."""
    here = intervals.where((F.col("n_from") <= n) & (F.col("n_to") >= n)).groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in ("at", "occurrences", "records")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, at, occ, recs in zip(b["f"], b["at"], b["occurrences"], b["records"], strict=True):
                w = tokenize(f)
                yield pd.DataFrame({"term": [" ".join(w[i : i + n]) for i in at], "occurrences": occ, "records": recs})

    texts = df.select(*keys, F.col(field).alias("f")).dropDuplicates(keys)
    if keys:
        on = [here[k].eqNullSafe(texts[k]) for k in keys]
        texts = here.join(texts, on).select(F.col("f"), here["at"], here["occurrences"], here["records"])
    return texts.mapInPandas(run, "term string, occurrences bigint, records bigint")


def marks(terms: DataFrame, total: int, rare: int, common: float) -> DataFrame:
    """(term, mark): 'rare' for at most `rare` occurrences, 'common' for at least `common` of `total` records; a term may have both."""
    both = F.array_compact(F.array(F.when(F.col("occurrences") <= rare, F.lit("rare")), F.when(F.col("records") >= common * total, F.lit("common"))))
    return terms.select("term", F.explode(both).alias("mark"))
