"""Several values packed in one field: dictionary-guided segmentation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that part values, besides white space.
DELIMITERS = ":;,|/：；，｜"

_QUOTED = r'"(?:[^"\\]|\\.|"")*"'


def _cutter(delimiters: str) -> re.Pattern:
    """A quoted value that ends before a delimiter or the end, a plain piece, or a run of delimiters and white space."""
    d = re.escape(delimiters)
    return re.compile(rf'(?P<q>{_QUOTED})(?=\s*(?:[{d}]|\s|$))|(?P<p>[^\s{d}]+)', re.S)


def _unquote(s: str) -> str:
    return re.sub(r'""|\\"', '"', s[1:-1]).strip()


def pieces(data: str, cutter: re.Pattern) -> list[tuple[int, int, bool]]:
    """(start, end, quoted) of every raw piece."""
    return [(m.start(), m.end(), m.lastgroup == "q") for m in cutter.finditer(data)]


def spans(data: str, parts: list[tuple[int, int, bool]], sizes: list[int]) -> set[str]:
    """The plain pieces, and the stretches of as many as one of `sizes` with a letter anywhere: what could be a known value."""
    out: set[str] = set()
    n = len(parts)
    letters, quotes = [0], [0]
    for a, b, q in parts:
        letters.append(letters[-1] + any(c.isalpha() for c in data[a:b]))
        quotes.append(quotes[-1] + q)
    for i, (a, b, q) in enumerate(parts):
        if q:
            continue
        out.add(data[a:b])
        for k in sizes:
            if k > 1 and i + k <= n and quotes[i + k] == quotes[i] and letters[i + k] > letters[i]:
                out.add(data[a : parts[i + k - 1][1]])
    return out


#: What a piece costs in a cover: in one known value together with others, known by itself or quoted, or unknown.
TOGETHER, KNOWN, UNKNOWN = 0.5, 0.75, 1.0


def segment(data: str, parts: list[tuple[int, int, bool]], known: ahocorasick.Automaton | None) -> tuple[list[str], int, int]:
    """The values in order by the cheapest cover, how many of them are known, and how many of those have several pieces.

    The automaton finds every known value in the field; those that run from the start of a plain piece to the end of one can
    be taken whole. Each value costs something, known ones less, so a longer known value beats its parts. Of covers of one
    cost that with the longer first value is taken.
    """
    n = len(parts)
    jumps: dict[int, list[int]] = {}
    if known is not None:
        start = {p[0]: i for i, p in enumerate(parts) if not p[2]}
        end = {p[1]: i for i, p in enumerate(parts) if not p[2]}
        quotes = [0]
        for p in parts:
            quotes.append(quotes[-1] + p[2])
        for last, size in known.iter(data):
            i, j = start.get(last + 1 - size), end.get(last + 1)
            if i is not None and j is not None and j >= i and quotes[j + 1] == quotes[i]:
                jumps.setdefault(i, []).append(j + 1)
    cost, step, sure = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        cost[i], step[i] = cost[i + 1] + (KNOWN if parts[i][2] else UNKNOWN), i + 1
        for j in sorted(jumps.get(i, ())):
            c = cost[j] + (KNOWN if j == i + 1 else TOGETHER)
            if c <= cost[i]:
                cost[i], step[i], sure[i] = c, j, True
    out, i, n_known, n_together = [], 0, 0, 0
    while i < n:
        a, b, q = parts[i][0], parts[step[i] - 1][1], parts[i][2]
        if v := _unquote(data[a:b]) if q else data[a:b]:
            out.append(v)
            n_known += sure[i]
            n_together += step[i] > i + 1
        i = step[i]
    return out, n_known, n_together


def unpack(df: DataFrame, key: str, data: str, dictionary: DataFrame, value: str, delimiters: str = DELIMITERS) -> DataFrame:
    """(key, pos, val): every value packed in `data`, pos counting from 1; distinct rows.

    Values are parted by any of `delimiters` or by white space, mixed at will, or stand in double quotes in
    which quotes are doubled or escaped by a backslash; a quote that does not close before a delimiter is an
    ordinary character. `dictionary`.`value` holds the known whole values. Those that occur in a field, as a piece or as a stretch of
    pieces with a letter somewhere (a stretch of numbers is several values), are fetched by an equi-join on the
    stretch, so neither the dictionary nor its frequent words gather anywhere; an automaton per batch finds them in the fields,
    and dynamic programming picks the cheapest cover of each field, so that delimiters inside a known value stay. Enclosing quotes and blanks at the ends are
    dropped; empty slots and values take no position. Null, empty and valueless fields give no rows, a null
    key is kept, repeated rows count once, long fields are handled whole.
    """
    covered = cover(df, key, data, dictionary, value, delimiters)
    return covered.select(key, F.posexplode("vals").alias("p", "val")).select(key, (F.col("p") + 1).cast("int").alias("pos"), "val").distinct()


def cover(df: DataFrame, key: str, data: str, dictionary: DataFrame, value: str, delimiters: str = DELIMITERS) -> DataFrame:
    """(key, vals, known, together): the values of each distinct field as `unpack` gives them, how many are known, and how many of those have several pieces."""
    cutter = _cutter(delimiters)
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(data).cast("string").alias("d")).where("d is not null and trim(d) <> ''").distinct()
    words = dictionary.select(F.trim(F.col(value)).alias("span")).where("span <> ''").distinct()
    sizes = words.select(F.size(F.split("span", f"[\\s{re.escape(delimiters)}]+")).alias("n")).distinct()
    sizes = sorted(r["n"] for r in sizes.collect())  # lengths, not values

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(h, s) for h, d in zip(b["h"], b["d"], strict=True) for s in spans(d, pieces(d, cutter), sizes)]
            yield pd.DataFrame(out, columns=["h", "span"])

    hashed = rows.withColumn("h", F.xxhash64("d"))
    cand = hashed.select("h", "d").mapInPandas(candidates, "h bigint, span string")
    known = cand.join(words, "span", "left_semi").groupBy("h").agg(F.collect_set("span").alias("known"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            auto = None
            found = {s for k in b["known"] if k is not None for s in k}
            if found:
                auto = ahocorasick.Automaton()
                for s in found:
                    auto.add_word(s, len(s))
                auto.make_automaton()
            got = [segment(d, pieces(d, cutter), auto if k is not None else None) for d, k in zip(b["d"], b["known"], strict=True)]
            yield pd.DataFrame({"k": b["k"], "vals": [x[0] for x in got], "known": [x[1] for x in got], "together": [x[2] for x in got]})

    # one page may come twice with one text: rows are distinct before, the result after
    out = hashed.join(known, "h", "left").select("k", "d", "known").mapInPandas(cut_up, "k bigint, vals array<string>, known int, together int")
    return out.withColumnRenamed("k", key)
