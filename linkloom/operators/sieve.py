"""A sieve of bounded size for known terms in texts: it lets through every known term and hardly anything else."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bits of a sieve, as a power of two (15 at least, a page): 16 MB, whatever the number of terms. More terms let more through, never less.
MOST_BITS = 27
#: Bits for each entry, where there are fewer.
BITS_AN_ENTRY = 16
_PAGE = 32_768


class Sieve:
    """A bloom filter of terms and of their beginnings, which tells a scan when to stop."""

    def __init__(self, data: bytes) -> None:
        self.data, self.mask = data, len(data) * 8 - 1

    def _has(self, s: str) -> bool:
        h = xxhash.xxh64_intdigest(s)
        p, q = h & self.mask, (h >> 32) & self.mask
        return bool(self.data[p >> 3] >> (p & 7) & 1 and self.data[q >> 3] >> (q & 7) & 1)

    def begins(self, s: str) -> bool:
        """Whether a known term may begin with s."""
        return self._has(s)

    def whole(self, s: str) -> bool:
        """Whether s may be a known term."""
        return self._has("\0" + s)


def make_sieve(terms: DataFrame, col: str, beginnings: Callable[[str], Iterable[str]]):
    """The broadcast sieve of the terms in `col`; `beginnings` gives a term's beginnings, itself included, as a scan meets them.

    Bits are set in Spark, page by page; what comes to the driver is at most 2^MOST_BITS bits. Null terms are left out.
    """
    spark = terms.sparkSession

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for t in b["t"]:
                out.update(beginnings(t))
                out.add("\0" + t)
            yield pd.DataFrame({"h": [xxhash.xxh64_intdigest(s) - (1 << 63) for s in out]})

    h = terms.select(F.col(col).alias("t")).where("t is not null").distinct().mapInPandas(entries, "h bigint")
    n = h.agg(F.approx_count_distinct("h")).first()[0]
    bits = min(MOST_BITS, max(16, (n * BITS_AN_ENTRY).bit_length()))
    mask = (1 << bits) - 1
    # the hash is shifted by 2^63 to fit a signed number; the low 63 bits are as they were
    at = h.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftright(F.col("h"), 32).bitwiseAND(mask))).alias("p"))
    pages = at.groupBy((F.col("p") / _PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("p") % _PAGE).alias("bits")).collect()
    data = bytearray(1 << (bits - 3))
    for r in pages:
        data[r["page"] * _PAGE // 8 : (r["page"] + 1) * _PAGE // 8] = r["bits"]
    return spark.sparkContext.broadcast(bytes(data))
