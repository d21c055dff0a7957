"""Numeric functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.semantics import _c, bound, let


def _fail(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def sqrt(x) -> Column:
    return _fail(_c(x) < 0, "square root of a negative number", F.sqrt(_c(x)))


def cbrt(x) -> Column:
    return F.cbrt(_c(x))


def ln(x) -> Column:
    return _fail(_c(x) <= 0, "logarithm of zero or less", F.ln(_c(x)))


def log(x, base=None) -> Column:
    """Base 10 with one argument."""
    return F.log10(_c(x)) if base is None else F.ln(_c(x)) / F.ln(F.lit(float(base)))


def trunc(x, digits: int = 0) -> Column:
    """Toward zero at that many decimal places."""
    y = _c(x) * 10**digits
    return F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)) / F.lit(10**digits)


def round_numeric(x, digits: int = 0) -> Column:
    """Halves away from zero, as numerics round; digits may be negative."""
    return F.round(_c(x).cast("decimal(38,10)"), digits)


def factorial(n) -> Column:
    """n! as a decimal of up to 38 digits (n to 33)."""
    n = _c(n).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda a, i: (a * i.cast("decimal(20,0)")).cast("decimal(38,0)"))


def width_bucket(x, low: float, high: float, n: int) -> Column:
    """Bucket of x in n equal ones; 0 and n+1 beyond; bounds may be reversed."""
    x = _c(x).cast("double")
    if low < high:
        return F.when(x < low, 0).when(x >= high, n + 1).otherwise(F.floor((x - low) * n / (high - low)) + 1).cast("int")
    return F.when(x > low, 0).when(x <= high, n + 1).otherwise(F.floor((low - x) * n / (low - high)) + 1).cast("int")


def mod(a, b) -> Column:
    return _c(a) % _c(b)


#: Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n) -> Column:
    """Roman numeral of 1 to 3999, else #."""
    n = _c(n).cast("int")
    left, out = n, F.lit("")
    for value, sign in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = left % value
    return F.when((n >= 1) & (n <= 3999), out).otherwise(F.lit("#" * 15))


def ordinal(n) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    n = _c(n)
    return F.concat(n.cast("string"), F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def random_(seed: float | None = None) -> Column:
    """Uniform in [0, 1); a seed as setseed() takes it (-1 to 1) makes the sequence repeatable."""
    if seed is not None and not -1 <= seed <= 1:
        raise ValueError("a seed lies between -1 and 1")
    return F.rand() if seed is None else F.rand(int(seed * (2**31 - 1)))


def is_nan(x) -> Column:
    """NaN equals itself, is over every number, and isn't null."""
    return F.when(_c(x).isNull(), None).otherwise(F.isnan(_c(x)))


def generate_series(low, high, step=1) -> Column:
    """Array of low, low + step, ... up to high (down to it for a negative step); none where high lies on the other side. Explode it for rows."""
    low, high, step = (x if isinstance(x, Column) else F.lit(x) for x in (low, high, step))
    kind = "array<bigint>"
    fits = F.when(step > 0, low <= high).otherwise(low >= high)
    return F.when(step == 0, F.raise_error(F.lit("step size cannot be zero")).cast(kind)).when(fits, F.sequence(low.cast("bigint"), high.cast("bigint"), step.cast("bigint"))).otherwise(F.array().cast(kind))


def _digits_of(template: str) -> tuple[str, str]:
    """Whole and fractional digit places of a number template."""
    import re

    head, _, tail = re.sub("SG|MI|PL|PR|TH|th|EEEE|S|L", "", template).replace("D", ".").partition(".")
    return "".join(c for c in head if c in "09,G"), "".join(c for c in tail if c in "09,G")


@bound
def to_char_number(x, template: str) -> Column:
    """A number by a template of 9 0 . D , G S MI PL SG PR RN L TH V EEEE FM and quoted text.

    Leading 9s give blanks and a 0 forces digits from there on; a number that doesn't fit gives #. A sign is
    anchored to the number unless S, MI, PL, SG or PR says otherwise.
    """
    import re

    fill = "FM" in template
    quoted = re.findall(r'"([^"]*)"', template)
    t = re.sub(r'"[^"]*"', "\x00", template.replace("FM", ""))
    if "RN" in t.upper():
        r = roman(_c(x).cast("int"))
        return (F.lower(r) if "rn" in t else r) if fill else F.lpad(F.lower(r) if "rn" in t else r, 15, " ")
    ordinal_of = re.search("TH|th", t)
    flags = {k: k in t for k in ("MI", "PL", "SG", "PR", "EEEE", "V")} | {"S": "S" in t.replace("SG", ""), "L": "L" in t.replace("PL", "")}
    v = _c(x).cast("double") if flags["EEEE"] else _c(x).cast("decimal(38,10)")
    if flags["EEEE"]:
        places = len(_digits_of(t)[1])
        e = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(v)))).cast("int")
        mantissa = F.round(v / F.pow(F.lit(10.0), e), places)
        e, mantissa = F.when(F.abs(mantissa) >= 10, e + 1).otherwise(e), F.when(F.abs(mantissa) >= 10, mantissa / 10).otherwise(mantissa)
        body = F.concat(F.format_string(f"%.{places}f", F.abs(mantissa)), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        return F.concat(F.when(v < 0, "-").otherwise("" if fill else " "), body)
    if flags["V"]:
        shift = len(re.findall("[09]", t.split("V")[1]))
        v, t = (v * 10**shift).cast("decimal(38,10)"), t.replace("V", "")
    whole, part = _digits_of(t)
    places = len(part)
    return let(F.struct(v.alias("v"), F.round(F.abs(v), places).alias("r")), lambda n: _number_text(n["v"], n["r"], t, whole, part, fill, flags, ordinal_of, quoted))


def _number_text(v: Column, rounded: Column, t: str, whole: str, part: str, fill: bool, flags: dict, ordinal_of, quoted: list[str]) -> Column:
    import re

    places = len(part)
    n_digits = len(whole.replace(",", "").replace("G", ""))
    int_text = F.floor(rounded).cast("decimal(38,0)").cast("string")
    frac = F.lpad(F.floor((rounded - F.floor(rounded)) * 10**places).cast("decimal(38,0)").cast("string"), places, "0") if places else F.lit("")
    int_text = F.when((int_text == "0") & F.lit(places > 0 and "0" not in whole), "").otherwise(int_text)
    too_long = F.length(int_text) > n_digits
    least = next((len(whole[i:].replace(",", "").replace("G", "")) for i, c in enumerate(whole) if c == "0"), 0)
    padded = F.lpad(F.when(F.length(int_text) < least, F.lpad(int_text, least, "0")).otherwise(int_text), max(n_digits, 1), " ") if n_digits else F.lit("")

    def spread(padded: Column) -> Column:
        pieces, at = [], 0
        for c in whole:
            if c in ",G":
                seen = F.trim(F.substring(padded, 1, at)) != ""
                pieces.append(F.when(seen, ",").otherwise("" if fill else " "))
            else:
                at += 1
                pieces.append(F.substring(padded, at, 1))
        return F.concat(*pieces) if pieces else F.lit("")

    digits = let(padded, spread) if set(whole) & set(",G") else padded
    if fill:
        digits = F.ltrim(digits)
        keep = len(part) - len(part.rstrip("9")) if part else 0
        floor_ = places - keep  # places that a 0 forces
        frac = F.concat(F.substring(frac, 1, floor_), F.regexp_replace(F.substring(frac, floor_ + 1, 100), "0+$", ""))
    if places:
        digits = F.concat(digits, F.lit("."), frac)
    hashes = F.lit(re.sub("[09]", "#", whole) + ("." + "#" * places if places else ""))
    return let(F.when(too_long, hashes).otherwise(digits), lambda d: _signed(v, rounded, d, t, fill, places, flags, ordinal_of, quoted))


def _signed(v: Column, rounded: Column, digits: Column, t: str, fill: bool, places: int, flags: dict, ordinal_of, quoted: list[str]) -> Column:
    neg = (v < 0) & ~((rounded == 0))
    blank = F.lit("" if fill else " ")
    anchored = lambda sign, d: F.concat(F.regexp_extract(d, "^( *)", 1), sign, F.ltrim(d))
    if flags["L"]:
        digits = F.concat(F.lit("$"), digits) if t.index("L") < (t.find("9") if "9" in t else t.find("0")) else F.concat(digits, F.lit("$"))
    if flags["PR"]:
        body = F.when(neg, F.concat(anchored(F.lit("<"), digits), F.lit(">"))).otherwise(F.concat(blank, digits, blank))
    elif flags["MI"]:
        sign = F.when(neg, "-").otherwise(blank)
        body = F.concat(sign, digits) if t.startswith("MI") else F.concat(digits, sign)
    elif flags["SG"]:
        sign = F.when(neg, "-").otherwise("+")
        body = F.concat(sign, digits) if t.startswith("SG") else F.concat(digits, sign)
    elif flags["PL"]:
        plus = F.when(neg, blank).otherwise("+")
        body = F.concat(plus, F.when(neg, anchored(F.lit("-"), digits)).otherwise(F.concat(blank, digits))) if t.startswith("PL") else F.concat(F.when(neg, anchored(F.lit("-"), digits)).otherwise(F.concat(blank, digits)), plus)
    elif flags["S"]:
        sign = F.when(neg, "-").otherwise("+")
        body = F.concat(digits, sign) if t.rstrip("\x00").endswith("S") else anchored(sign, digits)
    else:
        body = F.when(neg, anchored(F.lit("-"), digits)).otherwise(F.concat(blank, digits))
    if ordinal_of and not places:
        tail = F.regexp_extract(ordinal(F.floor(rounded).cast("bigint")), "([a-z]+)$", 1)
        body = F.when(neg, body).otherwise(F.concat(body, F.upper(tail) if ordinal_of[0] == "TH" else tail))
    for text in quoted:
        lead = t.index("\x00") < min((t.find(c) for c in "09" if c in t), default=0)
        body = F.concat(F.lit(text), body) if lead else F.concat(body, F.lit(text))
    return body
