"""IPv4 addresses and networks as text 'a.b.c.d/len', and MAC addresses, by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.semantics import _c


def host(x) -> Column:
    return F.substring_index(_c(x), "/", 1)


def masklen(x) -> Column:
    return F.coalesce(F.try_element_at(F.split(_c(x), "/"), F.lit(2)).cast("int"), F.lit(32))


def to_int(x) -> Column:
    p = F.split(host(x), "\\.")
    return F.aggregate(p, F.lit(0).cast("long"), lambda a, b: a * 256 + b.cast("long"))


def from_int(n) -> Column:
    n = _c(n)
    return F.concat_ws(".", *(F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))


def _size(x) -> Column:
    return F.pow(F.lit(2), F.lit(32) - masklen(x)).cast("long")


def network_int(x) -> Column:
    return to_int(x) - F.pmod(to_int(x), _size(x))


def network(x) -> Column:
    return F.concat(from_int(network_int(x)), F.lit("/"), masklen(x).cast("string"))


def broadcast(x) -> Column:
    return F.concat(from_int(network_int(x) + _size(x) - 1), F.lit("/"), masklen(x).cast("string"))


def netmask(x) -> Column:
    return from_int(F.lit(1 << 32) - _size(x))


def hostmask(x) -> Column:
    return from_int(_size(x) - 1)


def contained(a, b) -> Column:
    """a << b: strictly inside the network b."""
    return (masklen(a) > masklen(b)) & contained_eq(a, b)


def contained_eq(a, b) -> Column:
    return (masklen(a) >= masklen(b)) & (network_int(b) == to_int(a) - F.pmod(to_int(a), _size(b)))


def set_masklen(x, n: int) -> Column:
    return F.concat(host(x), F.lit(f"/{n}"))


def add(x, n: int) -> Column:
    return from_int(to_int(x) + n)


def mac_to_int(m) -> Column:
    return F.conv(F.regexp_replace(_c(m), "[^0-9a-fA-F]", ""), 16, 10).cast("long")


def mac_trunc(m) -> Column:
    """The manufacturer's half; the other is zero."""
    hexes = F.lower(F.rpad(F.substring(F.regexp_replace(_c(m), "[^0-9a-fA-F]", ""), 1, 6), 12, "0"))
    return F.concat_ws(":", *(F.substring(hexes, i, 2) for i in range(1, 12, 2)))


def mac(m) -> Column:
    """Six pairs joined by colons, from any of the usual ways to write one; anything else is an error."""
    m = _c(m)
    p = "[0-9a-fA-F]{2}"
    q = "[0-9a-fA-F]{4}"
    ok = m.rlike(f"^(({p}:){{5}}{p}|({p}-){{5}}{p}|({p}){{3}}[:-]({p}){{3}}|{q}\\.{q}\\.{q}|({p}){{6}})$")
    h = F.lower(F.regexp_replace(m, "[^0-9a-fA-F]", ""))
    return F.when(m.isNull(), None).when(ok, F.concat_ws(":", *(F.substring(h, i, 2) for i in range(1, 12, 2)))).otherwise(F.raise_error(F.concat(F.lit("invalid macaddr: "), m)).cast("string"))


def _mac_zip(a, b, f) -> Column:
    n = f(mac_to_int(a), mac_to_int(b))
    h = F.lower(F.lpad(F.hex(n), 12, "0"))
    return F.concat_ws(":", *(F.substring(h, i, 2) for i in range(1, 12, 2)))


def mac_and(a, b) -> Column:
    return _mac_zip(a, b, lambda x, y: x.bitwiseAND(y))


def mac_or(a, b) -> Column:
    return _mac_zip(a, b, lambda x, y: x.bitwiseOR(y))


def mac_not(a) -> Column:
    return _mac_zip(a, a, lambda x, _: x.bitwiseXOR(F.lit((1 << 48) - 1)))


def family(x) -> Column:
    return F.when(F.contains(_c(x), F.lit(":")), 6).otherwise(4)


def text(x) -> Column:
    """Address with its mask length."""
    return F.concat(host(x), F.lit("/"), masklen(x).cast("string"))


def abbrev(x) -> Column:
    """Without a full mask length."""
    return F.when(masklen(x) == 32, host(x)).otherwise(text(x))


def minus(a, b) -> Column:
    return to_int(a) - to_int(b)


def inet_and(a, b) -> Column:
    return from_int(to_int(a).bitwiseAND(to_int(b)))


def inet_or(a, b) -> Column:
    return from_int(to_int(a).bitwiseOR(to_int(b)))


def inet_not(a) -> Column:
    return from_int(F.lit((1 << 32) - 1) - to_int(a))


def contains(a, b) -> Column:
    """a >> b."""
    return contained(b, a)
