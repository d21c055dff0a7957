"""Range clauses of a conjunctive predicate, one interval for each column."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

INF = math.inf
FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}

RANGE_TYPE = T.ArrayType(T.StructType().add("col", "string").add("lo", "double").add("lo_inc", "boolean").add("hi", "double").add("hi_inc", "boolean"))


@dataclass(frozen=True)
class Range:
    col: str
    lo: float = -INF
    lo_inc: bool = False
    hi: float = INF
    hi_inc: bool = False

    def tightened(self, other: Range) -> Range | None:
        """The intersection; None where it is empty."""
        lo, lo_inc = max((self.lo, not self.lo_inc), (other.lo, not other.lo_inc))
        hi, hi_inc = min((self.hi, self.hi_inc), (other.hi, other.hi_inc))
        out = Range(self.col, lo, not lo_inc, hi, hi_inc)
        return None if lo > hi or (lo == hi and not (out.lo_inc and hi_inc)) else out

    def column(self) -> Column:
        c = F.col(self.col)
        parts = []
        if self.lo > -INF:
            parts.append(c >= self.lo if self.lo_inc else c > self.lo)
        if self.hi < INF:
            parts.append(c <= self.hi if self.hi_inc else c < self.hi)
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def one(left, op: str, right) -> Range | None:
    """The range of `column op constant` or `constant op column`; None for anything else."""
    if isinstance(right, str) and isinstance(left, int | float) and not isinstance(left, bool):
        left, op, right = right, FLIP.get(op, ""), left
    if not isinstance(left, str) or not isinstance(right, int | float) or isinstance(right, bool) or op not in FLIP or math.isnan(right):
        return None
    v = float(right)
    return {"<": Range(left, hi=v), "<=": Range(left, hi=v, hi_inc=True), ">": Range(left, lo=v), ">=": Range(left, lo=v, lo_inc=True), "=": Range(left, v, True, v, True)}[op]


def extract(clauses: list[tuple], strict: bool = True) -> tuple[list[Range] | None, list[tuple]]:
    """(ranges by column, clauses left over). strict (feedback): any other clause or a contradiction rejects all."""
    found: dict[str, Range] = {}
    rest = []
    for c in clauses:
        r = one(*c) if len(c) == 3 else None
        if r is None:
            if strict:
                return None, []
            rest.append(c)
            continue
        both = found.get(r.col, Range(r.col)).tightened(r)
        if both is None:
            return None, rest
        found[r.col] = both
    return sorted(found.values(), key=lambda r: r.col), rest


def predicate(ranges: list[Range]) -> Column:
    return reduce(lambda a, b: a & b, (r.column() for r in ranges), F.lit(True))


def columns_bitmap(columns: list[str], all_columns: list[str]) -> int:
    """Bit n for the n-th column of the table, from 1."""
    return sum(1 << (all_columns.index(c) + 1) for c in columns)


def encode(ranges: list[Range]) -> list[dict]:
    return [{"col": r.col, "lo": float(r.lo), "lo_inc": r.lo_inc, "hi": float(r.hi), "hi_inc": r.hi_inc} for r in ranges]


def decode(rows) -> list[Range]:
    return [Range(r["col"], r["lo"], r["lo_inc"], r["hi"], r["hi_inc"]) for r in rows]
