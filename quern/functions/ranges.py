"""Range types: structs (lo, hi, lo_inc, hi_inc, empty); a null bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.semantics import _c, bound


def _l(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def make(lo, hi, bounds: str = "[)", discrete: bool = False) -> Column:
    """A range; discrete ones take the canonical form [lo, hi). Bounds in the wrong order are an error."""
    lo, hi = _l(lo), _l(hi)
    lo_inc, hi_inc = F.lit(bounds[0] == "["), F.lit(bounds[1] == "]")
    if discrete:
        lo = lo if bounds[0] == "[" else lo + 1
        hi = hi if bounds[1] == ")" else hi + 1
        lo_inc, hi_inc = F.lit(True), F.lit(False)
    lo_inc, hi_inc = lo_inc & lo.isNotNull(), hi_inc & hi.isNotNull()
    bad = F.coalesce(lo > hi, F.lit(False))
    lo = F.when(bad, F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound"))).otherwise(lo) if not discrete else lo
    empty = F.coalesce((lo > hi) | ((lo == hi) & ~(lo_inc & hi_inc)), F.lit(False))
    return F.struct(F.when(~empty, lo).alias("lo"), F.when(~empty, hi).alias("hi"), (lo_inc & ~empty).alias("lo_inc"), (hi_inc & ~empty).alias("hi_inc"), empty.alias("empty"))


def is_empty(r) -> Column:
    return _c(r)["empty"]


def lower_inf(r) -> Column:
    return _c(r)["lo"].isNull() & ~_c(r)["empty"]


def upper_inf(r) -> Column:
    return _c(r)["hi"].isNull() & ~_c(r)["empty"]


@bound
def contains_elem(r, x) -> Column:
    r, x = _c(r), _l(x)
    low = r["lo"].isNull() | (r["lo"] < x) | ((r["lo"] == x) & r["lo_inc"])
    high = r["hi"].isNull() | (r["hi"] > x) | ((r["hi"] == x) & r["hi_inc"])
    return ~r["empty"] & low & high


def _low_le(a: Column, b: Column) -> Column:
    """a's lower bound is at or below b's."""
    return a["lo"].isNull() | (b["lo"].isNotNull() & ((a["lo"] < b["lo"]) | ((a["lo"] == b["lo"]) & (a["lo_inc"] | ~b["lo_inc"]))))


def _high_ge(a: Column, b: Column) -> Column:
    return a["hi"].isNull() | (b["hi"].isNotNull() & ((a["hi"] > b["hi"]) | ((a["hi"] == b["hi"]) & (a["hi_inc"] | ~b["hi_inc"]))))


@bound
def contains(a, b) -> Column:
    a, b = _c(a), _c(b)
    return b["empty"] | (~a["empty"] & _low_le(a, b) & _high_ge(a, b))


@bound
def left_of(a, b) -> Column:
    """a << b: every point of a is under every point of b."""
    a, b = _c(a), _c(b)
    return F.coalesce(~a["empty"] & ~b["empty"] & ((a["hi"] < b["lo"]) | ((a["hi"] == b["lo"]) & ~(a["hi_inc"] & b["lo_inc"]))), F.lit(False))


def right_of(a, b) -> Column:
    return left_of(b, a)


@bound
def overlaps(a, b) -> Column:
    a, b = _c(a), _c(b)
    return ~a["empty"] & ~b["empty"] & ~left_of(a, b) & ~left_of(b, a)


@bound
def not_right_of(a, b) -> Column:
    """a &< b: a doesn't reach beyond b."""
    return ~_c(a)["empty"] & ~_c(b)["empty"] & _high_ge(_c(b), _c(a))


@bound
def not_left_of(a, b) -> Column:
    return ~_c(a)["empty"] & ~_c(b)["empty"] & _low_le(_c(b), _c(a))


@bound
def adjacent(a, b) -> Column:
    a, b = _c(a), _c(b)
    meet = lambda x, y: F.coalesce((x["hi"] == y["lo"]) & (x["hi_inc"] != y["lo_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (meet(a, b) | meet(b, a))


def _of(lo: Column, hi: Column, lo_inc: Column, hi_inc: Column, empty: Column) -> Column:
    return F.struct(F.when(~empty, lo).alias("lo"), F.when(~empty, hi).alias("hi"), (lo_inc & ~empty).alias("lo_inc"), (hi_inc & ~empty).alias("hi_inc"), empty.alias("empty"))


@bound
def intersect(a, b) -> Column:
    a, b = _c(a), _c(b)
    al, ah = _low_le(a, b), _high_ge(a, b)
    pick = lambda c, x, y, f: F.when(c, x[f]).otherwise(y[f])
    return _of(pick(al, b, a, "lo"), pick(ah, b, a, "hi"), pick(al, b, a, "lo_inc"), pick(ah, b, a, "hi_inc"), ~overlaps(a, b))


@bound
def union(a, b) -> Column:
    """An error where the result isn't contiguous."""
    a, b = _c(a), _c(b)
    al, ah = _low_le(a, b), _high_ge(a, b)
    pick = lambda c, f: F.when(b["empty"], a[f]).when(a["empty"], b[f]).when(c, a[f]).otherwise(b[f])
    apart = ~a["empty"] & ~b["empty"] & ~overlaps(a, b) & ~adjacent(a, b)
    none = F.when(apart, F.raise_error(F.lit("result of range union would not be contiguous")).cast("boolean")).otherwise(a["empty"] & b["empty"])
    return _of(pick(al, "lo"), pick(ah, "hi"), pick(al, "lo_inc"), pick(ah, "hi_inc"), none)


@bound
def difference(a, b) -> Column:
    """a without b; an error where b lies inside a."""
    a, b = _c(a), _c(b)
    starts, ends = _low_le(b, a), _high_ge(b, a)
    hit = overlaps(a, b)
    inside = hit & ~starts & ~ends
    empty = F.when(inside, F.raise_error(F.lit("result of range difference would not be contiguous")).cast("boolean")).otherwise(a["empty"] | (hit & starts & ends))
    low_cut, high_cut = hit & starts, hit & ~starts & ends
    return _of(F.when(low_cut, b["hi"]).otherwise(a["lo"]), F.when(high_cut, b["lo"]).otherwise(a["hi"]), F.when(low_cut, ~b["hi_inc"]).otherwise(a["lo_inc"]), F.when(high_cut, ~b["lo_inc"]).otherwise(a["hi_inc"]), empty)


@bound
def to_text(r) -> Column:
    r = _c(r)
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.when(r["empty"], "empty").otherwise(F.concat(F.when(r["lo_inc"], "[").otherwise("("), s(r["lo"]), F.lit(","), s(r["hi"]), F.when(r["hi_inc"], "]").otherwise(")")))
