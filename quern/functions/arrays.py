"""Array functions with 1-based subscripts and null-keeping semantics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.semantics import _c


def _l(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def array_length(a) -> Column:
    """Null for an empty array."""
    return F.when(F.size(_c(a)) > 0, F.size(_c(a)))


def array_dims(a) -> Column:
    return F.when(F.size(_c(a)) > 0, F.concat(F.lit("[1:"), F.size(_c(a)).cast("string"), F.lit("]")))


def array_slice(a, low: int, high: int) -> Column:
    """Elements low to high; bounds beyond the array are cut to it."""
    low = max(low, 1)
    return F.slice(_c(a), low, max(high - low + 1, 0))


def array_remove(a, x) -> Column:
    """Without the elements that aren't distinct from x, null too."""
    return F.filter(_c(a), lambda e: ~e.eqNullSafe(_l(x)))


def array_replace(a, old, new) -> Column:
    return F.transform(_c(a), lambda e: F.when(e.eqNullSafe(_l(old)), _l(new)).otherwise(e))


def array_fill(x, *dims: int) -> Column:
    out = _l(x)
    for n in reversed(dims):
        out = F.array_repeat(out, n)
    return out


def array_to_string(a, sep: str, null: str | None = None) -> Column:
    a = F.transform(_c(a), lambda e: e.cast("string"))
    return F.array_join(a, sep, null) if null is not None else F.array_join(a, sep)


def string_to_array(s, sep: str | None, null: str | None = None) -> Column:
    """A null separator splits into characters; elements equal to null become nulls."""
    import re

    s = _c(s)
    out = F.filter(F.split(s, ""), lambda e: e != "") if sep is None else F.split(s, re.escape(sep)) if sep else F.array(s)
    out = F.when(s == "", F.array().cast("array<string>")).otherwise(out)
    return out if null is None else F.transform(out, lambda e: F.nullif(e, F.lit(null)))


def contains(a, b) -> Column:
    """a @> b: every element of b is in a; a null in b never is."""
    return F.forall(_c(b), lambda x: F.coalesce(F.exists(_c(a), lambda y: F.coalesce(x == y, F.lit(False))), F.lit(False)))


def overlaps(a, b) -> Column:
    return F.exists(_c(a), lambda x: F.exists(_c(b), lambda y: F.coalesce(x == y, F.lit(False))))


def any_equal(x, a) -> Column:
    """x = ANY(a) in three-valued logic."""
    return F.exists(_c(a), lambda e: e == _c(x))


def all_equal(x, a) -> Column:
    return F.forall(_c(a), lambda e: e == _c(x))


def subscripts(a, reverse: bool = False) -> Column:
    n = F.size(_c(a))
    ups = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.reverse(ups) if reverse else ups


def array_cat(a, b) -> Column:
    """A null array counts as none."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def array_ndims(a, levels: int = 1) -> Column:
    """Dimensions of an array with so many levels of nesting; null for an empty one."""
    return F.when(F.size(_c(a)) > 0, F.lit(levels))


def _level(a, dim: int) -> Column:
    out = _c(a)
    for _ in range(dim - 1):
        out = F.try_element_at(out, F.lit(1))
    return out


def array_lower(a, dim: int = 1) -> Column:
    """1 where the dimension exists."""
    return F.when(F.size(_level(a, dim)) > 0, F.lit(1))


def array_upper(a, dim: int = 1) -> Column:
    return F.when(F.size(_level(a, dim)) > 0, F.size(_level(a, dim)))


def array_compare(a, b) -> Column:
    """-1, 0 or 1: element by element, a null over every value, the shorter first where one begins the other."""
    pair = F.zip_with(_c(a), _c(b), lambda x, y: F.when(x.eqNullSafe(y), 0).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, -1).otherwise(1))
    shared = F.slice(pair, F.lit(1), F.greatest(F.least(F.size(_c(a)), F.size(_c(b))), F.lit(0)))
    first = F.try_element_at(F.filter(shared, lambda s: s != 0), F.lit(1))
    return F.coalesce(first, F.signum(F.size(_c(a)) - F.size(_c(b))).cast("int"))


def all_compare(x, op: str, a) -> Column:
    """x op ALL(a) in three-valued logic, op one of = <> < <= > >=."""
    return F.forall(_c(a), lambda e: _OPS[op](_c(x), e))


def any_compare(x, op: str, a) -> Column:
    """x op ANY(a) in three-valued logic."""
    return F.exists(_c(a), lambda e: _OPS[op](_c(x), e))


_OPS = {
    "=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}


def row_compare(a: list, op: str, b: list) -> Column:
    """ROW(a...) op ROW(b...): the first pair that isn't equal decides; null where a null pair comes before it."""
    if len(a) != len(b) or not a:
        raise ValueError("rows differ in size")
    a, b = [x if isinstance(x, Column) else F.col(x) for x in a], [x if isinstance(x, Column) else F.col(x) for x in b]
    if op in ("=", "<>"):
        same = a[0] == b[0]
        for x, y in zip(a[1:], b[1:], strict=True):
            same = same & (x == y)
        return same if op == "=" else ~same
    out = _OPS[op](a[-1], b[-1])
    for x, y in zip(reversed(a[:-1]), reversed(b[:-1]), strict=True):
        out = F.when((x == y).isNull(), F.lit(None).cast("boolean")).when(x == y, out).otherwise(_OPS[op[0]](x, y))
    return out


def array_subquery(df, column: str, keys: list[str], order: list[str] | None = None):
    """ARRAY(SELECT column ...) for each outer row by key: one row a key with its values in the given order."""
    packed = F.sort_array(F.collect_list(F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order or [column])), F.col(column).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias(column))
