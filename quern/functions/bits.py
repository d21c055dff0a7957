"""Bit strings as text of 0 and 1, and enums as ordered labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.semantics import _c


def _zip(a, b, f) -> Column:
    a, b = _c(a), _c(b)
    bits = F.zip_with(F.split(a, ""), F.split(b, ""), f)
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("bit strings differ in size")).cast("string")).otherwise(F.array_join(bits, ""))


def bit_and(a, b) -> Column:
    return _zip(a, b, lambda x, y: F.when((x == "1") & (y == "1"), "1").when(x == "", "").otherwise("0"))


def bit_or(a, b) -> Column:
    return _zip(a, b, lambda x, y: F.when((x == "1") | (y == "1"), "1").when(x == "", "").otherwise("0"))


def bit_xor(a, b) -> Column:
    return _zip(a, b, lambda x, y: F.when(x == "", "").when(x == y, "0").otherwise("1"))


def bit_not(a) -> Column:
    return F.translate(_c(a), "01", "10")


def shift_left(a, n: int) -> Column:
    a = _c(a)
    return F.substr(F.concat(a, F.repeat(F.lit("0"), F.lit(n))), F.lit(n + 1), F.length(a))


def shift_right(a, n: int) -> Column:
    a = _c(a)
    return F.substr(F.concat(F.repeat(F.lit("0"), F.lit(n)), a), F.lit(1), F.length(a))


def from_int(n, width: int) -> Column:
    return F.lpad(F.right(F.bin(_c(n)), F.lit(width)), width, "0")


def to_int(a) -> Column:
    return F.conv(_c(a), 2, 10).cast("long")


def bit_substring(a, start: int, length: int | None = None) -> Column:
    return F.substring(_c(a), start, 1 << 30 if length is None else length)


def bit_position(part: str, a) -> Column:
    """1-based place of the first occurrence, 0 without one."""
    return F.locate(part, _c(a))


def bit_overlay(a, new: str, start: int, length: int | None = None) -> Column:
    return F.overlay(_c(a), F.lit(new), start, -1 if length is None else length)


def bit_length(a) -> Column:
    return F.length(_c(a))


def bit_cat(a, b) -> Column:
    return F.concat(_c(a), _c(b))


class Enum:
    """Labels whose order is that of their declaration."""

    def __init__(self, *labels: str):
        self.labels = labels

    def ordinal(self, x) -> Column:
        """Sort and compare by this; an unknown label is an error."""
        x = _c(x)
        at = F.array_position(F.array(*map(F.lit, self.labels)), x)
        return F.when(at == 0, F.raise_error(F.concat(F.lit("invalid label: "), x)).cast("long")).otherwise(at)

    def first(self) -> Column:
        return F.lit(self.labels[0])

    def last(self) -> Column:
        return F.lit(self.labels[-1])

    def range(self, low: str | None = None, high: str | None = None) -> Column:
        i, j = self.labels.index(low) if low else 0, self.labels.index(high) + 1 if high else len(self.labels)
        return F.array(*map(F.lit, self.labels[i:j]))
