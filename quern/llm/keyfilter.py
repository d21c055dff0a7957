"""A prefilter of fixed size that keeps rows back in their scan where no join partner can need them.

Keys are 64-bit hashes. Of each the lowest 24 bits name one of 2^24 places, kept as 2^18 words of 64 bits, which are
broadcast (3 MB whatever the data). It is a prefilter only: an exact join always follows, and with more keys than
it can tell apart more rows are shuffled, none is lost. Built-in expressions alone, and no key reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm._io import written

BITS = 24


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(63).cast("int"))


def _word(key: Column) -> Column:
    return F.shiftrightunsigned(key, 6).bitwiseAND((1 << (BITS - 6)) - 1)


class Prefilter:
    """Which rows may have a key among those of a one-column table: maybe() are those that may, never() the others."""

    def __init__(self, keys: DataFrame):
        key = F.col(keys.columns[0])
        words = keys.where(key.isNotNull()).groupBy(_word(key).alias("__word")).agg(F.bit_or(_bit(key)).alias("__bits"))
        self.words = written(words, "prefilter")

    def _join(self, df: DataFrame, key: Column, how: str) -> DataFrame:
        hit = (_word(key) == F.col("__word")) & (_bit(key).bitwiseAND(F.col("__bits")) != 0)
        return df.join(F.broadcast(self.words), hit, how)

    def maybe(self, df: DataFrame, key: Column) -> DataFrame:
        return self._join(df, key, "left_semi")

    def never(self, df: DataFrame, key: Column) -> DataFrame:
        return self._join(df, key, "left_anti")
