"""Where the engine's SQL semantics differ from Spark's defaults, encoded once."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(x, f) -> Column:
    """f(x) with x evaluated once, however often f uses it; a long expression isn't copied into the plan again and again."""
    return F.transform(F.array(_c(x)), f)[0]


def bound(f):
    """f with every argument that is a long column expression bound by let()."""
    from functools import wraps

    @wraps(f)
    def g(*args, **kw):
        args = list(args)
        for i, a in enumerate(args):
            if isinstance(a, Column) and len(repr(a)) > 160:
                before, after = args[:i], args[i + 1 :]
                return let(a, lambda v: g(*before, v, *after, **kw))  # noqa: B023  used at once
        return f(*args, **kw)

    return g


def asc(x) -> Column:
    """Ascending order, nulls last."""
    return _c(x).asc_nulls_last()


def desc(x) -> Column:
    """Descending order, nulls first."""
    return _c(x).desc_nulls_first()


def int_div(a, b) -> Column:
    """Whole-number division, truncated toward zero; division by zero is an error."""
    q = _c(a).cast("decimal(20,0)") / _c(b).cast("decimal(20,0)")
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def concat(*xs) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *(_c(x).cast("string") for x in xs))


def log10(x) -> Column:
    return F.log10(_c(x))


def days_between(a, b) -> Column:
    """a - b for dates, in whole days."""
    return F.datediff(_c(a), _c(b))


def dow(x) -> Column:
    """Day of week, Sunday = 0."""
    return F.dayofweek(_c(x)) - 1


def round_double(x) -> Column:
    """Rounding of doubles to the nearest whole number, halves to even."""
    return F.rint(_c(x))


def sum_exact(x) -> Column:
    """Sum of whole numbers that cannot overflow."""
    return F.sum(_c(x).cast("decimal(38,0)"))


def avg_exact(x, scale: int = 6) -> Column:
    """Average of whole numbers as a decimal."""
    return (F.sum(_c(x).cast("decimal(38,0)")) / F.count(_c(x)).cast("decimal(20,0)")).cast(f"decimal(38,{scale})")


def array_agg(x, *order) -> Column:
    """All values, nulls too, in a given order."""
    if order:
        packed = F.sort_array(F.collect_list(F.struct(*(_c(o).alias(f"o{i}") for i, o in enumerate(order)), _c(x).alias("v"))))
    else:
        packed = F.collect_list(F.struct(_c(x).alias("v")))
    return F.transform(packed, lambda s: s["v"])


def subscript(arr, i) -> Column:
    """1-based element, null outside the bounds."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.when((i >= 1) & (i <= F.size(_c(arr))), F.try_element_at(_c(arr), i.cast("int")))


def not_in(x, values) -> Column:
    """x NOT IN (...) in three-valued logic."""
    return ~_c(x).isin(values)
