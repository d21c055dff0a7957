"""String and regular-expression functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quern.semantics import _c


def initcap(s) -> Column:
    """Upper-case the first letter of each alphanumeric word, lower-case the rest."""
    parts = F.regexp_extract_all(_c(s), F.lit(r"([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def substr(s, start, length=None) -> Column:
    """The window [start, start + length) cut with the string; starts below 1 use up length."""
    s, start = _c(s), start if isinstance(start, Column) else F.lit(start)
    if length is None:
        return F.substr(s, F.greatest(start, F.lit(1)))
    length = length if isinstance(length, Column) else F.lit(length)
    first = F.greatest(start, F.lit(1))
    return F.substr(s, first, F.greatest(start + length - first, F.lit(0)))


def left(s, n: int) -> Column:
    """First n characters; a negative n drops from the right."""
    s = _c(s)
    return substr(s, 1, F.lit(n)) if n >= 0 else substr(s, 1, F.greatest(F.length(s) + n, F.lit(0)))


def right(s, n: int) -> Column:
    """Last n characters; a negative n drops from the left."""
    s = _c(s)
    return F.substr(s, F.greatest(F.length(s) - n + 1, F.lit(1))) if n >= 0 else F.substr(s, F.lit(1 - n))


def strpos(s, part) -> Column:
    return F.locate(part, _c(s)) if isinstance(part, str) else F.position(part, _c(s))


def split_part(s, delimiter: str, n: int) -> Column:
    if n < 1:
        raise ValueError("field position must be over zero")
    return F.split_part(_c(s), F.lit(delimiter), F.lit(n))


def chr_(n) -> Column:
    """Character of a code point, beyond 255 too."""
    return F.decode(F.unhex(F.lpad(F.hex(_c(n).cast("int")), 8, "0")), "UTF-32")


def ascii_(s) -> Column:
    """Code point of the first character."""
    return F.conv(F.hex(F.encode(F.substring(_c(s), 1, 1), "UTF-32")), 16, 10).cast("int")


def _replacement(r: str) -> str:
    """\\1 and \\& of the engine's replacement strings in Java's form."""
    r = re.sub(r"\$", r"\\$", r)
    return re.sub(r"\\(\d)", r"$\1", r.replace("\\&", "$0"))


def regexp_replace(s, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match only, unless the flags have g; i ignores case."""
    p = ("(?i)" if "i" in flags else "") + pattern
    new = _replacement(replacement)
    if "g" in flags:
        return F.regexp_replace(_c(s), p, new)
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 2}" if m[1] != "0" else "$2", new)
    return F.regexp_replace(_c(s), f"(?s)\\A(.*?)({p})", "$1" + shifted)


def regexp_substring(s, pattern: str) -> Column:
    """First group, or the whole match; null without a match."""
    group = 1 if re.compile(pattern).groups else 0
    return F.when(_c(s).rlike(pattern), F.regexp_extract(_c(s), pattern, group))


def regexp_matches(s, pattern: str, flags: str = "") -> Column:
    """Array of capture arrays, one for each match with g, else of the first; explode it for rows."""
    p = ("(?i)" if "i" in flags else "") + pattern
    n = re.compile(pattern).groups
    groups = [F.regexp_extract_all(_c(s), F.lit(p), F.lit(g)) for g in (range(1, n + 1) if n else [0])]
    rows = F.transform(F.arrays_zip(*(g.alias(f"g{i}") for i, g in enumerate(groups))), lambda z: F.array(*(z[f"g{i}"] for i in range(len(groups)))))
    return rows if "g" in flags else F.slice(rows, 1, 1)


def regexp_split(s, pattern: str) -> Column:
    return F.split(_c(s), pattern)


def similar_pattern(p: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as a Java regular expression."""
    out, i, inside = [], 0, False
    while i < len(p):
        ch = p[i]
        if ch == escape and i + 1 < len(p):
            i += 1
            out.append(re.escape(p[i]))
        elif inside:
            inside = ch != "]"
            out.append(ch)
        elif ch == "[":
            inside = True
            out.append(ch)
        elif ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch in "|*+?{}()":
            out.append(ch)
        else:
            out.append(re.escape(ch))
        i += 1
    return f"(?s)\\A(?:{''.join(out)})\\z"


def similar_to(s, pattern: str, escape: str = "\\") -> Column:
    return _c(s).rlike(similar_pattern(pattern, escape))


def sql_substring(s, pattern: str, escape: str = "#") -> Column:
    """substring(s FROM pattern FOR escape) with two escape-double-quote markers."""
    a, b, c = pattern.split(escape + '"')
    strip = lambda x: similar_pattern(x, escape)[len("(?s)\\A(?:") : -len(")\\z")]
    p = f"(?s)\\A{strip(a)}({strip(b)}){strip(c)}\\z"
    return F.when(_c(s).rlike(p), F.regexp_extract(_c(s), p, 1))


def quote_literal(s) -> Column:
    """In single quotes, with quotes and backslashes doubled."""
    s = _c(s).cast("string")
    body = F.replace(F.replace(s, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.when(F.contains(s, F.lit("\\")), F.lit("E'")).otherwise(F.lit("'")), body, F.lit("'"))


def quote_nullable(s) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def quote_ident(s) -> Column:
    """In double quotes unless it is a plain lower-case name."""
    s = _c(s)
    return F.when(s.rlike("\\A[a-z_][a-z0-9_]*\\z"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def format_(template: str, *args) -> Column:
    """%s, %I and %L with %n$ positions and - and width; nulls are empty for %s and NULL for %L."""
    out, at, nxt = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?(-)?(\d+)?([sIL%])", template):
        out.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[4] == "%":
            out.append(F.lit("%"))
            continue
        nxt = int(m[1]) if m[1] else nxt + 1
        arg = _c(args[nxt - 1])
        v = {"s": lambda a: F.coalesce(a.cast("string"), F.lit("")), "I": quote_ident, "L": quote_nullable}[m[4]](arg)
        if m[3]:
            w = F.greatest(F.length(v), F.lit(int(m[3])))
            v = F.rpad(v, w, F.lit(" ")) if m[2] else F.lpad(v, w, F.lit(" "))
        out.append(v)
    return F.concat(*out, F.lit(template[at:]))


def encode(b, kind: str) -> Column:
    b = _c(b).cast("binary")
    if kind == "hex":
        return F.lower(F.hex(b))
    if kind == "base64":
        return F.regexp_replace(F.base64(b), "\r", "")
    raise ValueError(kind)


def decode(s, kind: str) -> Column:
    return {"hex": F.unhex, "base64": F.unbase64}[kind](_c(s))


def to_hex(n) -> Column:
    return F.lower(F.hex(_c(n)))


def get_byte(b, n: int) -> Column:
    return F.conv(F.hex(F.substring(_c(b).cast("binary"), n + 1, 1)), 16, 10).cast("int")


def set_byte(b, n: int, v: int) -> Column:
    b = _c(b).cast("binary")
    return F.concat(F.substring(b, 1, n), F.unhex(F.lit(f"{v:02X}")), F.substring(b, n + 2, 1 << 30))


def get_bit(b, n: int) -> Column:
    return F.shiftright(get_byte(b, n // 8), n % 8).bitwiseAND(1)


def bpchar_length(s) -> Column:
    """Length of a blank-padded string: trailing blanks don't count."""
    return F.length(F.rtrim(_c(s)))


def btrim(s, chars: str = " ") -> Column:
    """Without any of these characters at either end."""
    return F.trim(_c(s), F.lit(chars))


def ltrim(s, chars: str = " ") -> Column:
    return F.ltrim(_c(s), F.lit(chars))


def rtrim(s, chars: str = " ") -> Column:
    return F.rtrim(_c(s), F.lit(chars))


def overlay(s, new, start: int, length: int | None = None) -> Column:
    """s with `length` characters from `start` (as many as new has, by default) replaced."""
    return F.overlay(_c(s), _c(new), start, -1 if length is None else length)


def matches(s, pattern: str, ignore_case: bool = False) -> Column:
    """s ~ pattern, or s ~* pattern; negate it for !~ and !~*."""
    return _c(s).rlike(("(?i)" if ignore_case else "") + pattern)


def regexp_split_to_table(s, pattern: str) -> Column:
    """A row for each piece."""
    return F.explode(regexp_split(s, pattern))


def set_bit(b, n: int, v: int) -> Column:
    """Bit n (from the lowest of the first byte) set to 0 or 1."""
    old, mask = get_byte(b, n // 8), 1 << (n % 8)
    new = old.bitwiseOR(mask) if v else old.bitwiseAND(255 - mask)
    b = _c(b).cast("binary")
    return F.concat(F.substring(b, 1, n // 8), F.unhex(F.lpad(F.hex(new), 2, "0")), F.substring(b, n // 8 + 2, 1 << 30))


def escape_encode(b) -> Column:
    """encode(b, 'escape'): zero and high bytes as three octal digits, backslashes doubled."""
    h = F.regexp_extract_all(F.hex(_c(b).cast("binary")), F.lit("(..)"), F.lit(1))
    code = lambda x: F.conv(x, 16, 10).cast("int")
    octal = lambda x: F.concat(F.lit("\\"), F.lpad(F.conv(x, 16, 8), 3, "0"))
    return F.array_join(F.transform(h, lambda x: F.when(x == "5C", F.lit("\\\\")).when((code(x) == 0) | (code(x) > 127), octal(x)).otherwise(F.chr(code(x)))), "")


#: Escapes of one letter in E'' strings.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def e_string(text: str) -> str:
    """The value of an E'...' literal's body: \\n and the like, \\ooo, \\xhh, \\uXXXX, \\UXXXXXXXX; other characters stand for themselves."""

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "xuU" and len(x) > 1:
            return chr(int(x[1:], 16))
        return chr(int(x, 8) & 255) if x[0] in "01234567" else ESCAPES.get(x, x)

    return re.sub(r"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S).replace("''", "'")


#: Collations by name; others are taken as Spark's own names.
COLLATIONS = {"C": "UTF8_BINARY", "POSIX": "UTF8_BINARY", "en_US": "en_USA", "de_DE": "de", "sv_SE": "sv", "tr_TR": "tr"}


def collate(s, name: str) -> Column:
    """s COLLATE name: comparisons and sorting follow that locale, or bytes for C."""
    return F.collate(_c(s), COLLATIONS.get(name, name))
