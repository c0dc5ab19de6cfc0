"""A Bloom filter as a table of 64-bit words (D9, D10): built, merged and probed by aggregates and joins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sized(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for ``n`` members at a share ``p`` of false positives."""
    m = max(64, math.ceil(-max(1, n) * math.log(p) / math.log(2) ** 2))
    return m, max(1, round(m / max(1, n) * math.log(2)))


@dataclass(frozen=True)
class Bloom:
    """``words`` (word, bits) of ``m`` bits with ``k`` hashes a member; a word without a bit has no row."""

    words: DataFrame
    m: int
    k: int

    @classmethod
    def of(cls, rows: DataFrame, column: str, n: int, p: float) -> Bloom:
        m, k = sized(n, p)
        return cls(_words(rows.select(_places(F.col(column), m, k))), m, k)

    def merged(self, other: Bloom) -> Bloom:
        """The filter of both sets; both must have the same size."""
        if (self.m, self.k) != (other.m, other.k):
            raise ValueError("filters of different sizes")
        return Bloom(self.words.union(other.words).groupBy("word").agg(F.bit_or("bits").alias("bits")), self.m, self.k)

    def held(self, rows: DataFrame, column: str) -> DataFrame:
        """Column and ``maybe`` of each distinct value: false is certain."""
        asked = rows.select(column).distinct().select(column, _places(F.col(column), self.m, self.k))
        found = asked.select(column, F.floor(F.col("place") / 64).alias("word"), _bit().alias("bit")).join(self.words, "word", "left")
        return found.groupBy(column).agg(F.bool_and(F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).alias("maybe"))

    def fill(self) -> DataFrame:
        """One row: set bits, their share, the share of false positives to expect from it, and bytes."""
        n = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
        return self.words.agg(n.alias("set_bits"), (n / self.m).alias("fill"), F.pow(n / self.m, F.lit(self.k)).alias("expected_false_share"), F.lit(8 * -(-self.m // 64)).alias("bytes"))


def _places(value: Column, m: int, k: int) -> Column:
    """The ``k`` places of a value, from two hashes."""
    one, two = F.pmod(F.xxhash64(value), F.lit(m)), F.pmod(F.xxhash64(value, F.lit(7)), F.lit(m))
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(one + i * two, F.lit(m)))).alias("place")


def _bit() -> Column:
    return F.expr("shiftleft(1L, CAST(place % 64 AS INT))")


def _words(places: DataFrame) -> DataFrame:
    return places.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(_bit()).alias("bits"))
