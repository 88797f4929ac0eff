"""All pairs of similar sets, by pigeonhole partitioning of the token universe."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, drop

#: Tokens in at least this part of all (record, token) rows tell little; there are at most 1 / HOT of them.
HOT = 1 / 2000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def most_apart(t: float, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Most tokens in which sets of sizes a and b differ if they overlap (Jaccard) by t."""
    return np.floor((1 - t) / (1 + t) * (np.asarray(a) + np.asarray(b)) + 1e-9).astype(np.int64)


def bounds(t: float, least: int, most: int) -> np.ndarray:
    """Lower ends of size groups so wide that the partners of a set lie in its own or the next lower one."""
    out = [max(1, least)]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] / t)))
    return np.array(out, np.int64)


def segments(t: float, low: np.ndarray) -> np.ndarray:
    """How many segments the universe has for the sets of each size group."""
    top = low[1:] - 1
    h = most_apart(t, top, np.floor(top / t))
    return np.maximum(2, np.ceil(0.55 * (h + 1))).astype(np.int64)


def signatures(ids: np.ndarray, ends: np.ndarray, tokens: np.ndarray, t: float, low: np.ndarray, hot: np.ndarray, again: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Signatures of a batch of sets: sig, id, size, sketch, find (as what it looks up), hold (as what it is looked up).

    A set is looked up in its own size group, split into that group's segments, by the whole of each segment
    (hold 1) and by each segment less one token (hold 2). It looks for smaller or equal sets in its own and
    the next lower group. If two sets differ in at most H tokens, then of any choice of segments with allowed
    differences d, where the sum of (d + 1) is over H, one segment differs by no more than its d. Each set
    makes its choice (d 0 or 1, or left out) so that what it looks up is as telling as possible: units of
    quality 'tokens that are not hot' and that less one are taken from the best on. d 0: find 1; d 1: the
    whole finds wholes and deletions (find 2), a deletion finds wholes (find 3). Sums of hashes stand for segments, so
    a deletion is a subtraction.

    `again` (sig, roles as in x) makes the signatures of a second split of the universe, by another hash, for sets that met under
    one signature too many share: they hold and find there what they did before, under that signature only.
    """
    sizes = np.diff(ends)
    count = segments(t, low)
    group = np.searchsorted(low, sizes, side="right") - 1
    owner = np.repeat(np.arange(len(ids)), sizes)
    h = _mix(tokens.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    cold = ~np.isin(tokens, hot)
    bit = np.uint64(1) << (h >> np.uint64(40)) % np.uint64(40)
    sketch = np.zeros(len(ids), np.uint64)
    np.bitwise_xor.at(sketch, owner, bit)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("sig", "id", "size", "sketch", "find", "hold")}
    if again is None:
        outer, finds, holds = np.zeros(len(ids), np.uint64), np.ones(len(ids), bool), np.ones(len(ids), bool)
    else:
        outer, finds, holds = _mix(again[0].view(np.uint64)), (again[1] >> 2) & 3 > 0, again[1] & 3 > 0
        h = _mix(h ^ np.uint64(0xA0761D6478BD642F))

    def put(sig: np.ndarray, who: np.ndarray, find: np.ndarray, hold: int) -> None:
        out["sig"].append(sig)
        out["id"].append(ids[who])
        out["size"].append(sizes[who])
        out["sketch"].append(sketch[who])
        out["find"].append(find)
        out["hold"].append(np.full(len(sig), hold))

    for lower in (0, 1):
        g = group - lower
        here = g >= 0
        if lower:
            here &= low[np.maximum(group, 1)] - 1 >= np.ceil(t * sizes - 1e-9)
        if again is not None:  # what holds did so in its own group
            here &= ~holds if lower else holds
        tok = here[owner]
        own, ht = owner[tok], h[tok]
        m = np.where(here, count[np.maximum(g, 0)], 0)
        base = np.concatenate(([0], np.cumsum(m)))
        total = int(base[-1])
        if not total:
            continue
        seg = ((ht >> np.uint64(13)) % m[own].astype(np.uint64)).astype(np.int64)
        where = base[own] + seg
        whole = np.zeros(total, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(whole, where, ht)
        n = np.bincount(where, minlength=total)
        n_cold = np.bincount(where[cold[tok]], minlength=total)
        set_of = np.repeat(np.arange(len(ids)), m)
        with np.errstate(over="ignore"):
            salt = _mix((np.arange(total) - base[set_of]).astype(np.uint64) + (g[set_of].astype(np.uint64) << np.uint64(32))) + outer[set_of]
        partner = np.minimum(sizes, low[np.maximum(g, 0) + 1] - 1)
        need = np.where(finds, most_apart(t, sizes, partner) + 1, 0)
        quality = n_cold + 0.05 * np.minimum(n, 10)
        units = np.concatenate((quality, quality - 1))
        of = np.concatenate((set_of, set_of))
        second = np.repeat([0, 1], total)
        order = np.lexsort((second, -units, of))
        place = np.arange(2 * total) - np.repeat(np.concatenate(([0], np.cumsum(2 * m)))[:-1], 2 * m)
        chosen = np.zeros(2 * total, bool)
        chosen[order] = place < need[of[order]]
        d = chosen[:total].astype(np.int64) + chosen[total:]  # 0: left out, else allowed difference + 1
        with np.errstate(over="ignore"):
            sig_whole = _mix(whole + salt)
            sig_less = _mix(whole[where] - ht + salt[where])
        find_less = np.where(d[where] == 2, 3, 0)
        if lower:
            k = d > 0
            put(sig_whole[k], set_of[k], d[k], 0)
            k = find_less > 0
            put(sig_less[k], own[k], find_less[k], 0)
        else:
            put(sig_whole, set_of, d, 1)
            put(sig_less, own, find_less, 2)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def token_sets(df: DataFrame, record: str, token: str, least: int = 1) -> DataFrame:
    """(id, toks): the distinct non-null tokens of each record, ascending; records with fewer than `least` are left out.

    Repeated rows are dropped where they are read and again where they meet, so a set is as large as its record's distinct tokens.
    """
    tok = F.col(token) if df.schema[token].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(F.col(token))
    t = df.select(F.col(record).cast("bigint").alias("id"), tok.cast("bigint").alias("tok")).where("id is not null and tok is not null")
    return t.groupBy("id").agg(F.sort_array(F.collect_set("tok")).alias("toks")).where(F.size("toks") >= least)


#: Pairs of one signature for each token of its sets from which on they are told apart by a second split of the universe, which makes about a row a token.
CROWDED = 8
#: Sets that look one signature up in a chunk, where the second split does not tell them apart.
FINDERS_A_CHUNK = 500


class SimilarSets:
    """Records whose sets of tokens overlap (Jaccard) by at least `threshold`, within one table or between it and `other` (a table, its record and token columns).

    Null records and tokens are left out, repeated rows count once, records of fewer than `least` distinct
    tokens take no part; tokens that are no integers are compared by a 64-bit hash. Empty tables give no rows,
    other columns are not read. Records with one and the same set form a class; only its representative (the
    smallest id) goes through the join, so copies cost nothing there.

    Some signatures tell nothing: a segment without tokens, or with frequent ones only, is shared by a part of all sets. Sets that
    meet under a signature of over CROWDED pairs a token are split by another hash, and the same pigeonhole rule is applied within the signature,
    so nothing is lost and the pairs stay in proportion to the sets; what is crowded even then meets in chunks.

    `reps` (id, toks), `members` (id, rep), `links` (a, b): pairs of representatives, a < b. Between two tables ids are doubled, those of
    `other` plus one (they must have 62 bits at most).
    """

    def __init__(self, df: DataFrame, record: str, token: str, threshold: float, least: int = 1, other: tuple[DataFrame, str, str] | None = None) -> None:
        t = threshold
        rows = df.select(F.col(record).cast("bigint").alias("r"), F.col(token).alias("k"))
        self.two = other is not None
        if other:
            rows = rows.withColumn("r", F.col("r") * 2).unionByName(other[0].select((F.col(other[1]).cast("bigint") * 2 + 1).alias("r"), F.col(other[2]).alias("k")))
        keyed = cut(token_sets(rows, "r", "k", least).withColumn("same", F.unhex(F.md5(F.array_join("toks", ",")))))
        first = keyed.groupBy("same").agg(F.min("id").alias("rep"))
        self.members = cut(keyed.select("id", "same").join(first, "same").select("id", "rep"))
        self.reps = cut(keyed.join(self.members.where("id = rep").select("id"), "id", "left_semi").select("id", "toks"))
        drop(keyed)
        size = self.reps.agg(F.max(F.size("toks"))).first()[0] or 1
        known = rows.where("r is not null and k is not null")
        n_rows = known.count()
        is_int = rows.schema["k"].dataType.simpleString() != "string"
        hot = known.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, HOT * n_rows)).select((F.col("k") if is_int else F.xxhash64("k")).cast("bigint").alias("k")).collect()
        hot_ids = np.array(sorted(r["k"] for r in hot), np.int64)
        low = bounds(t, least, size)

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                # about a million tokens at once
                step = max(1, int(b.num_rows * 1_000_000 / max(1, len(b.column("toks").flatten()))))
                for i in range(0, b.num_rows, step):
                    part = b.slice(i, step)
                    toks = part.column("toks")
                    ends = np.concatenate(([0], np.cumsum(toks.value_lengths().to_numpy())))
                    again = (part.column("sig").to_numpy(), part.column("x").to_numpy()) if "x" in b.schema.names else None
                    s = signatures(part.column("id").to_numpy(), ends, toks.flatten().to_numpy(), t, low, hot_ids, again)
                    # 40 bits of sketch, 20 of size, 2 + 2 of roles
                    packed = (s["sketch"].astype(np.int64) << 24) | (np.minimum(s["size"], (1 << 20) - 1) << 4) | (s["find"] << 2) | s["hold"]
                    yield pa.RecordBatch.from_arrays([pa.array(s["sig"].view(np.int64)), pa.array(s["id"]), pa.array(packed)], names=["sig", "id", "x"])

        finds, holds = F.expr("(x >> 2) & 3") > 0, F.expr("x & 3") > 0

        def signed(df: DataFrame) -> DataFrame:
            """The signatures with how many sets find (n_f) and hold (n_h) each, and whether that makes too many pairs: one shuffle."""
            w = Window.partitionBy("sig")
            n_f, n_h, tokens = (F.sum(c.cast("bigint")).over(w) for c in (finds, holds, F.expr("(x >> 4) & 1048575")))
            out = df.mapInArrow(sign, "sig bigint, id bigint, x bigint").where(finds | holds).withColumns({"n_f": n_f, "n_h": n_h, "tokens": tokens})
            return out.where("n_f > 0 and n_h > 0").withColumn("crowded", F.col("n_f") * F.col("n_h") > CROWDED * F.col("tokens"))

        def meet(df: DataFrame, few: Column, *on: str) -> DataFrame:
            """(p, px, q, qx): who finds whom. A list of one side, the finders where `few` says so, is set beside each row of the other, where the shuffle has put them, so there is no join."""
            w, me = Window.partitionBy(*on), F.struct("id", "x")
            listed = F.collect_list(F.when(F.when(few, finds).otherwise(holds), me)).over(w)
            out = df.withColumn("o", listed).where(F.when(few, holds).otherwise(finds)).select("id", "x", few.alias("few"), F.explode("o").alias("o"))
            side = lambda c, here, there: F.when(F.col("few"), F.col(there)).otherwise(F.col(here)).alias(c)
            return out.select(side("p", "id", "o.id"), side("px", "x", "o.x"), side("q", "o.id", "id"), side("qx", "o.x", "x"))

        once = signed(self.reps)
        few = F.col("n_f") <= F.col("n_h")
        twice = signed(once.where("crowded").select("sig", "id", "x").join(self.reps, "id"))
        # what is crowded even then: the finders in chunks, the others once for each
        chunks = F.ceil(F.col("n_f") / FINDERS_A_CHUNK)
        mine = F.when(finds & ~holds, F.array(F.pmod(F.xxhash64("id"), chunks))).otherwise(F.sequence(F.lit(0).cast("bigint"), chunks - 1))
        thrice = twice.where("crowded").select("sig", "id", "x", chunks.alias("chunks"), F.explode(mine).alias("chunk"))
        own = F.pmod(F.xxhash64("id"), F.col("chunks")) == F.col("chunk")
        thrice = thrice.withColumn("x", F.when(own, F.col("x")).otherwise(F.expr("x & -13"))).repartition("sig", "chunk")
        pairs = meet(once.where("not crowded"), few, "sig").unionByName(meet(twice.where("not crowded"), few, "sig"))
        pairs = pairs.unionByName(meet(thrice, F.lit(True), "sig", "chunk"))
        sa, sb = F.expr("(px >> 4) & 1048575"), F.expr("(qx >> 4) & 1048575")
        apart = F.floor(F.lit((1 - t) / (1 + t)) * (sa + sb) + 1e-9)
        # sizes beyond 20 bits are cut to the same number: such pairs pass to the exact check
        huge = sa == (1 << 20) - 1
        near = (
            ((F.expr("qx & 3") == 1) | ((F.expr("(px >> 2) & 3") == 2) & (F.expr("qx & 3") == 2)))
            & ((sa > sb) | ((sa == sb) & ((F.col("p") > F.col("q")) | (huge & (F.col("p") != F.col("q"))))))
            & (huge | (sb >= F.lit(t) * sa - 1e-9))
            & (huge | (F.bit_count(F.expr("((px >> 24) ^ (qx >> 24)) & 1099511627775")) <= apart))
        )
        self.met_pairs = pairs
        cand = pairs.where(near).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        ra = self.reps.select(F.col("id").alias("a"), F.col("toks").alias("ta"))
        rb = self.reps.select(F.col("id").alias("b"), F.col("toks").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb"))
        exact = cand.join(ra, "a").join(rb, "b").where(both / (F.size("ta") + F.size("tb") - both) >= t)
        self.links = exact.select("a", "b")

    def pairs(self) -> DataFrame:
        """(a, b): every similar pair of records, copies expanded; a < b within one table, a of the first and b of the other between two."""
        m = self.members
        ma = m.select(F.col("rep").alias("a"), F.col("id").alias("x"))
        mb = m.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        across = self.links.join(ma, "a").join(mb, "b")
        within = ma.join(mb, ma["a"] == mb["b"]).where("x < y")
        both = across.select("x", "y").unionByName(within.select("x", "y"))
        if self.two:
            left, right = F.pmod("x", F.lit(2)), F.pmod("y", F.lit(2))
            both = both.where(left != right).select(F.when(left == 0, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(left == 0, F.col("y")).otherwise(F.col("x")).alias("y"))
            return both.select(F.expr("x >> 1").alias("a"), F.expr("y >> 1").alias("b"))
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def classes(self) -> DataFrame:
        """(id, class, copies, links): each record's class, how many have its very set, and how many other classes are similar."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        n = self.members.groupBy("rep").agg(F.count("*").alias("copies"))
        per = n.join(ends, "rep", "left")
        return self.members.join(per, "rep").select("id", F.col("rep").alias("class"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
