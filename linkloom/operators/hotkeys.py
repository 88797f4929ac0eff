"""Per-key results by dense accumulator arrays, free of the imbalance of frequent keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct keys that one block of accumulators holds on average, at most.
KEYS_A_BLOCK = 65_536
#: Array pieces that are summed at once.
FAN_IN = 64
#: Rows of an input split that are encoded together.
ROWS_AT_ONCE = 1 << 20

_UFUNC = {"count": np.add, "sum": np.add, "min": np.minimum, "max": np.maximum}


def _scatter(codes: np.ndarray, values: np.ndarray | None, op: str, size: int) -> np.ndarray:
    """One accumulator array over the codes 0..size-1."""
    if op == "count":
        return np.bincount(codes, minlength=size)
    start = {"sum": 0, "min": np.iinfo(np.int64).max, "max": np.iinfo(np.int64).min}[op]
    acc = np.full(size, start, dtype=np.int64)
    _UFUNC[op].at(acc, codes, values)
    return acc


def _encode(keys: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes and the dictionary that they index."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    d = keys.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def _hash(keys: pa.Array) -> np.ndarray:
    """The same number for equal keys in every process."""
    if pa.types.is_integer(keys.type):
        with np.errstate(over="ignore"):
            x = keys.to_numpy(zero_copy_only=False).astype(np.uint64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))
    return pd.util.hash_array(keys.cast(pa.string()).to_numpy(zero_copy_only=False), categorize=False)


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def dense_accumulate(df: DataFrame, key: str, measures: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(key, one column per measure) for every non-null key.

    `measures`: name -> (op, column); op is count (all rows, column None), sum, min or max of an integer column.
    Keys may be integers or strings. Null keys are left out; null values do not count for sum, min and max, of
    which a key with nulls only has null. An empty table gives no rows. Only the named columns are read.

    Each input split encodes its keys by a dictionary and adds its rows up in arrays over the codes (numpy
    bincount and scatter-reduce), so that a split sends a key once however often it occurs. The arrays travel in
    blocks of keys and are summed by a tree in which a task takes at most FAN_IN pieces of one block; a block's
    dictionary is the union of its pieces'. There are as many blocks as the distinct keys ask for (a sketch counts them), and as
    many levels as the splits ask for. Work thus depends on the rows of a split and on the number of
    keys, not on how the rows are spread over the keys.
    """
    kind = df.schema[key].dataType.simpleString()
    kind = "string" if kind == "string" else "bigint"
    names = list(measures)
    cols = [F.col(key).cast(kind).alias("k")] + [F.col(c).cast("bigint").alias(f"v{i}") for i, (_, c) in enumerate(measures.values()) if c]
    src = df.select(*cols).where("k is not null")
    seen = src.select("k", F.spark_partition_id().alias("p")).agg(F.approx_count_distinct("k").alias("keys"), F.max("p").alias("last")).first()
    blocks = max(1, math.ceil(seen["keys"] / KEYS_A_BLOCK))
    # the plan may make other splits of a shuffled source next time, but no more than the shuffle has
    splits = max((seen["last"] or 0) + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ops = [op for op, _ in measures.values()]
    has = [c is not None for _, c in measures.values()]
    # a measure over values has a second array that counts them, for nulls
    arrays = []
    for i, op in enumerate(ops):
        arrays.append((op if op != "count" else "sum", i))
        if has[i]:
            arrays.append(("sum", i))
    schema = f"block int, part int, n int, keys array<{kind}>, " + ", ".join(f"a{j} array<bigint>" for j in range(len(arrays)))

    def first(batch: pa.Table) -> tuple[pa.Array, list[np.ndarray]]:
        codes, words = _encode(batch.column("k"))
        out: list[np.ndarray] = []
        for i, op in enumerate(ops):
            if not has[i]:
                out.append(_scatter(codes, None, "count", len(words)))
                continue
            v = batch.column(f"v{i}").combine_chunks()
            ok = v.is_valid().to_numpy(zero_copy_only=False)
            vals = v.fill_null(0).to_numpy(zero_copy_only=False)
            out.append(_scatter(codes[ok], vals[ok], op, len(words)))
            out.append(np.bincount(codes[ok], minlength=len(words)))
        return words, out

    def merge(pieces: list[tuple[pa.Array, list[np.ndarray]]]) -> tuple[pa.Array, list[np.ndarray]]:
        if len(pieces) == 1:
            return pieces[0]
        codes, words = _encode(pa.chunked_array([p[0] for p in pieces]))
        return words, [_scatter(codes, np.concatenate([p[1][j] for p in pieces]), op, len(words)) for j, (op, _) in enumerate(arrays)]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done: list = []
        wait: list[pa.RecordBatch] = []
        n = 0

        def flush() -> None:
            nonlocal n, wait
            if wait:
                done.append(first(pa.Table.from_batches(wait)))
                wait, n = [], 0
            if len(done) > 8:
                done[:] = [merge(done)]

        for b in batches:
            wait.append(b)
            n += b.num_rows
            if n >= ROWS_AT_ONCE:
                flush()
        flush()
        if not done:
            return
        words, acc = merge(done)
        block = (_hash(words) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        ids, starts = np.unique(block[order], return_index=True)
        bounds = np.append(starts, len(order)).astype(np.int32)
        part = TaskContext.get().partitionId()
        take = pa.array(order)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int32()), pa.array(np.full(len(ids), part), pa.int32()), pa.array(np.diff(bounds), pa.int32()), _lists(words.take(take), bounds)]
            + [_lists(pa.array(a[order].astype(np.int64)), bounds) for a in acc],
            names=["block", "part", "n", "keys", *[f"a{j}" for j in range(len(arrays))]],
        )

    def add(group: pa.Table) -> pa.Table:
        codes, d = _encode(pc.list_flatten(group.column("keys")))
        acc = [_scatter(codes, pc.list_flatten(group.column(f"a{j}")).to_numpy(), op, len(d)) for j, (op, _) in enumerate(arrays)]
        ends = np.array([0, len(d)], np.int32)
        return pa.Table.from_arrays(
            [pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int32()), pa.array([len(d)], pa.int32()), _lists(d, ends)]
            + [_lists(pa.array(a.astype(np.int64)), ends) for a in acc],
            names=["block", "part", "n", "keys", *[f"a{j}" for j in range(len(arrays))]],
        )

    out = src.mapInArrow(split, schema)
    while splits > 1:
        out = out.groupBy("block", F.floor(F.col("part") / FAN_IN).alias("_g")).applyInArrow(add, schema)
        splits = math.ceil(splits / FAN_IN)
    zipped = out.select(F.explode(F.arrays_zip("keys", *[f"a{j}" for j in range(len(arrays))])).alias("z"))
    picked, j = [F.col("z.keys").alias(key)], 0
    for i, name in enumerate(names):
        if has[i]:
            picked.append(F.when(F.col(f"z.a{j + 1}") > 0, F.col(f"z.a{j}")).alias(name))
            j += 2
        else:
            picked.append(F.col(f"z.a{j}").alias(name))
            j += 1
    return zipped.select(*picked)


def frequent_keys(df: DataFrame, key: str, share: float, least: int) -> DataFrame:
    """(key_id, n, total) of the keys with at least `share` of the rows that have a key, and at least `least` rows.

    Repeated rows count each time; rows without a key count neither way; ties at the bound are in.
    """
    total = df.where(F.col(key).isNotNull()).count()
    n = dense_accumulate(df, key, {"n": ("count", None)})
    return n.where((F.col("n") >= share * total) & (F.col("n") >= least)).select(F.col(key).alias("key_id"), "n", F.lit(total).cast("bigint").alias("total"))


def target_profiles(links: DataFrame, source: str, target: str, redirects: DataFrame, r_from: str, r_to: str) -> DataFrame:
    """For every target of a link or a redirect: links, distinct sources, redirects (rows each, repeats counted).

    (target, links, sources, redirects). Null targets are left out; a null source counts as a link, not as a source.
    """
    all_links = dense_accumulate(links.select(F.col(target).alias("target")), "target", {"links": ("count", None)})
    pairs = links.select(F.col(target).alias("target"), F.col(source).alias("s")).where("target is not null and s is not null").distinct()
    sources = dense_accumulate(pairs.select("target"), "target", {"sources": ("count", None)})
    reds = dense_accumulate(redirects.select(F.col(r_to).alias("target")), "target", {"redirects": ("count", None)})
    return (
        all_links.join(sources, "target", "left").join(reds, "target", "full")
        .select("target", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("links", "sources", "redirects")])
    )
