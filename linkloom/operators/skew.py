"""Joins on keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is heavy and split into parts of about this many.
ROWS_A_PART = 200_000
#: Heavy keys that are broadcast (a key and a number each); more of them are joined by the plan's own choice, whose parts adaptive execution splits.
MOST_BROADCAST = 200_000


def heavy_keys(counts: DataFrame, key: str, count: str, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """(key, parts) of the keys of more rows than one part has, as a side of checked size.

    `counts` has one row per key, from an aggregation over all rows.
    """
    h = counts.where(F.col(key).isNotNull() & (F.col(count) > rows_a_part)).select(F.col(key), F.ceil(F.col(count) / rows_a_part).cast("int").alias("_parts"))
    return F.broadcast(h) if h.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else h


def with_part(df: DataFrame, key: str, heavy: DataFrame, spread: list[Column]) -> DataFrame:
    """`df` and `_part`: 0 for light keys, else a part chosen by the hash of `spread`."""
    h = heavy.withColumnRenamed(key, "_heavy")
    return (
        df.join(h, df[key] == h["_heavy"], "left")
        .withColumn("_part", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")))
        .drop("_heavy", "_parts")
    )


def for_each_part(df: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """`df` once for each part of its key, with `_part`."""
    h = heavy.withColumnRenamed(key, "_heavy")
    return (
        df.join(h, df[key] == h["_heavy"], "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_heavy", "_parts")
    )
