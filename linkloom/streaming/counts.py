"""Link and link-text counts that grow with the loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_links(links: DataFrame, seen: str, target: str, late: str = "60 days", window: str = "30 days") -> DataFrame:
    """(start, target, links) of a stream of links by time of sighting; rows later than `late` behind the newest drop out.

    That bounds what a running stream keeps; where rows come months late, `follow_windows` counts them all. `seen` must be a timestamp; a stream of timestamps without a zone is cast first. Links without a target or time are left out.
    """
    x = links.select(F.col(seen).cast("timestamp").alias("at"), F.col(target).alias("target")).where("at is not null and target is not null")
    g = x.withWatermark("at", late).groupBy(F.window("at", window), "target").agg(F.count("*").alias("links"))
    return g.select(F.col("window.start").alias("start"), "target", "links")


def window_rows(links: DataFrame, seen: str, target: str, window: str = "30 days") -> DataFrame:
    """(start, target, links) of each link by itself, to be summed; links without a target or time are left out."""
    x = links.select(F.col(seen).cast("timestamp").alias("at"), F.col(target).alias("target")).where("at is not null and target is not null")
    return x.select(F.window("at", window)["start"].alias("start"), "target", F.lit(1).cast("bigint").alias("links"))


def follow_windows(stream: DataFrame, path: str, checkpoint: str, seen: str, target: str, window: str = "30 days") -> StreamingQuery:
    """Counts a stream of links by window and target, however late they come: each batch adds its sums, `totals` adds the batches up."""
    return follow(window_rows(stream, seen, target, window), path, checkpoint, ["start", "target"], ["links"])


def merge_counts_into(path: str, keys: list[str], counts: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: sums of `counts` by `keys` under `path`, one table per batch.

    Each batch adds the sums of its rows as a part of its own, named by its number, so a batch that is run again
    replaces its part and counts once. `totals` adds the parts up.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge


def totals(spark, path: str, keys: list[str], counts: list[str]) -> DataFrame:
    """The sums over all batches."""
    return spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def follow(stream: DataFrame, path: str, checkpoint: str, keys: list[str], counts: list[str]) -> StreamingQuery:
    """Starts the merging of a stream; it takes what is there, then ends."""
    return stream.writeStream.foreachBatch(merge_counts_into(path, keys, counts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
