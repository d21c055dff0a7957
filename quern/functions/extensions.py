"""Extension modules: trigrams, fuzzy matching, key-value maps, cubes, label paths, integer arrays, earth distance, check digits, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quern.semantics import _c


# trigrams
def show_trgm(s) -> Column:
    """Distinct trigrams of the lower-cased words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(_c(s)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def similarity(a, b) -> Column:
    x, y = show_trgm(a), show_trgm(b)
    common = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - common
    return F.when(total > 0, common / total).otherwise(F.lit(0.0))


# fuzzy strings
def levenshtein(a, b, limit: int | None = None) -> Column:
    """With a limit, limit + 1 where the distance is over it."""
    d = F.levenshtein(_c(a), _c(b))
    return d if limit is None else F.least(d, F.lit(limit + 1))


def soundex(s) -> Column:
    return F.soundex(_c(s))


def difference(a, b) -> Column:
    """How many of the four soundex characters agree."""
    x, y = F.soundex(_c(a)), F.soundex(_c(b))
    return reduce(lambda p, q: p + q, [(F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5)])


def phonetic_key(s) -> Column:
    """A compact phonetic key: vowels but the first go, common digraphs and letters fold."""
    s = F.upper(_c(s))
    #: Folds in order.
    for a, b in (("^(KN|GN|PN|WR)", "N"), ("PH", "F"), ("TH", "0"), ("SH|CH", "X"), ("CK", "K"), ("[DT]", "T"), ("[CGQ]", "K"), ("[VW]", "F"), ("[SZ]", "S"), ("(.)\\1+", "$1"), ("(?<!^)[AEIOUYH]", "")):
        s = F.regexp_replace(s, a, b)
    return s


# key-value maps
def hstore_text(m) -> Column:
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.array_join(F.transform(F.array_sort(F.map_entries(_c(m))), lambda e: F.concat(q(e["key"]), F.lit("=>"), F.coalesce(q(e["value"]), F.lit("NULL")))), ", ")


def hstore_concat(a, b) -> Column:
    """b's values win."""
    return F.map_zip_with(_c(a), _c(b), lambda k, x, y: F.when(F.map_contains_key(_c(b), k), y).otherwise(x))


def hstore_delete(m, *keys: str) -> Column:
    return F.map_filter(_c(m), lambda k, v: ~k.isin(*keys))


def hstore_slice(m, *keys: str) -> Column:
    return F.map_filter(_c(m), lambda k, v: k.isin(*keys))


def hstore_contains(a, b) -> Column:
    return F.forall(F.map_entries(_c(b)), lambda e: F.map_contains_key(_c(a), e["key"]) & F.try_element_at(_c(a), e["key"]).eqNullSafe(e["value"]))


def hstore_exists_any(m, *keys: str) -> Column:
    return F.arrays_overlap(F.map_keys(_c(m)), F.array(*map(F.lit, keys)))


# cubes: arrays of lower and upper corners
def cube(low, high) -> Column:
    z = lambda f, n: F.zip_with(_c(low), _c(high), f).alias(n)
    return F.struct(z(lambda x, y: F.least(x, y), "lo"), z(lambda x, y: F.greatest(x, y), "hi"))


def cube_contains(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.forall(F.zip_with(a["lo"], b["lo"], lambda x, y: x <= y), lambda t: t) & F.forall(F.zip_with(a["hi"], b["hi"], lambda x, y: x >= y), lambda t: t)


def cube_overlap(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.forall(F.zip_with(a["lo"], b["hi"], lambda x, y: x <= y), lambda t: t) & F.forall(F.zip_with(b["lo"], a["hi"], lambda x, y: x <= y), lambda t: t)


def cube_distance(a, b) -> Column:
    a, b = _c(a), _c(b)
    gap = F.zip_with(F.zip_with(a["lo"], b["hi"], lambda x, y: x - y), F.zip_with(b["lo"], a["hi"], lambda x, y: x - y), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g))


def cube_size(c) -> Column:
    return F.aggregate(F.zip_with(_c(c)["hi"], _c(c)["lo"], lambda x, y: x - y), F.lit(1.0), lambda s, g: s * g)


# label paths
def is_ancestor(a, b) -> Column:
    """a @> b: a is b or lies above it."""
    return (_c(a) == _c(b)) | F.startswith(_c(b), F.concat(_c(a), F.lit(".")))


def nlevel(p) -> Column:
    return F.when(_c(p) == "", 0).otherwise(F.size(F.split(_c(p), "\\.")))


def subpath(p, offset: int, length: int | None = None) -> Column:
    """0-based labels; a negative offset counts from the end."""
    parts = F.split(_c(p), "\\.")
    start = F.lit(offset + 1) if offset >= 0 else F.size(parts) + offset + 1
    return F.array_join(F.slice(parts, start, F.lit(length if length is not None else 1 << 30)), ".")


def lca(a, b) -> Column:
    """Longest common path above both."""
    x, y = F.split(_c(a), "\\."), F.split(_c(b), "\\.")
    n = F.least(F.size(x), F.size(y)) - 1
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + (s["go"] & e).cast("int")).alias("n"), (s["go"] & e).alias("go")))["n"]
    return F.array_join(F.slice(x, F.lit(1), F.least(same, n)), ".")


# integer arrays
def icount(a) -> Column:
    return F.size(_c(a))


def sort_ints(a, order: str = "asc") -> Column:
    return F.sort_array(_c(a), order == "asc")


def uniq(a) -> Column:
    """Without adjacent repeats."""
    a = _c(a)
    return F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), ((i == 0) | ~x.eqNullSafe(F.try_element_at(a, F.greatest(i, F.lit(1))))).alias("k"))), lambda s: s["k"]), lambda s: s["x"])


def idx(a, x) -> Column:
    return F.array_position(_c(a), x)


def int_union(a, b) -> Column:
    return F.sort_array(F.array_union(_c(a), _c(b)))


# earth distance
EARTH = 6378168.0


def earth_distance(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres by the haversine formula."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


# accents: decomposed pairs from the Unicode database, not listed here
def _pairs(limit: int = 0x250) -> tuple[str, str]:
    import unicodedata

    found = [(chr(c), d) for c in range(0xC0, limit) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def unaccent(s) -> Column:
    return F.translate(_c(s), *_pairs())


# product numbers
def ean13_valid(s) -> Column:
    d = F.regexp_replace(_c(s), "[^0-9]", "")
    total = reduce(lambda p, q: p + q, [F.try_element_at(F.split(d, ""), F.lit(i + 1)).cast("int") * (3 if i % 2 else 1) for i in range(13)])
    return F.when(F.length(d) == 13, total % 10 == 0).otherwise(F.lit(False))


def isbn10_check(s) -> Column:
    """Check character of the first nine digits."""
    d = F.split(F.substring(F.regexp_replace(_c(s), "[^0-9]", ""), 1, 9), "")
    r = F.pmod(11 - reduce(lambda p, q: p + q, [F.element_at(d, i + 1).cast("int") * (10 - i) for i in range(9)]) % 11, F.lit(11))
    return F.when(r == 10, "X").otherwise(r.cast("string"))


# tables
def crosstab(df: DataFrame, row: str, category: str, value: str, categories: list) -> DataFrame:
    """One row per row name, one column for each given category, by conditional aggregation."""
    return df.groupBy(row).agg(*(F.max(F.when(F.col(category) == c, F.col(value))).alias(f"c_{c}") for c in categories))


def connectby(df: DataFrame, key: str, parent: str, start, max_depth: int = 0, separator: str = "~") -> DataFrame:
    """key, parent, level, branch of the tree under start, to max_depth levels (0: all). A loop is an error."""
    from quern.operators.recursion import cut

    edges = df.select(F.col(key).alias("__k"), F.col(parent).alias("__p"))
    root = edges.where(F.col("__k") == start).select("__k", F.lit(None).cast(edges.schema["__p"].dataType).alias("__up"), F.lit(0).alias("level"), F.array("__k").alias("path")).distinct()
    level, out, depth = cut(root, "tree"), None, 0
    while not level.isEmpty():
        if not level.where(F.array_contains(F.slice(F.reverse("path"), 2, 1 << 30), F.col("__k"))).isEmpty():
            raise ValueError("infinite recursion: the tree has a loop")
        out = level if out is None else out.union(level)
        depth += 1
        if max_depth and depth > max_depth:
            break
        up = level.select(F.col("__k").alias("__above"), F.col("path").alias("__path"))
        level = cut(edges.join(up, F.col("__p") == F.col("__above")).select("__k", F.col("__p").alias("__up"), F.lit(depth).alias("level"), F.array_append("__path", F.col("__k")).alias("path")), "tree")
    out = level if out is None else out
    return out.select(F.col("__k").alias(key), F.col("__up").alias(parent), "level", F.array_join(F.transform("path", lambda p: p.cast("string")), separator).alias("branch"))


def normal_rand(spark, n: int, mean: float, sd: float, seed: int = 1) -> DataFrame:
    return spark.range(n).select((F.randn(seed) * sd + mean).alias("normal_rand"))


# digests
def digest(s, kind: str) -> Column:
    b = _c(s).cast("binary")
    return {"md5": F.md5(b), "sha1": F.sha1(b), "sha256": F.sha2(b, 256), "sha512": F.sha2(b, 512)}[kind]


def hmac(s, key: str, kind: str = "sha256") -> Column:
    block = 128 if kind == "sha512" else 64
    import hashlib

    k = key.encode()
    k = hashlib.new(kind, k).digest() if len(k) > block else k
    k = k.ljust(block, b"\0")
    inner = digest(F.concat(F.lit(bytes(b ^ 0x36 for b in k)), _c(s).cast("binary")), kind)
    return digest(F.concat(F.lit(bytes(b ^ 0x5C for b in k)), F.unhex(inner)), kind)


def _blob(x) -> Column:
    return _c(x).cast("binary")


def encrypt(data, key, kind: str = "aes") -> Column:
    """encrypt(data, key, 'aes' | 'aes-cbc' | 'aes-ecb'): zero IV, padded; the key has 16, 24 or 32 bytes."""
    mode = "ECB" if kind.endswith("ecb") else "CBC"
    if mode == "ECB":
        return F.aes_encrypt(_blob(data), _blob(key), F.lit("ECB"), F.lit("PKCS"))
    return F.substring(F.aes_encrypt(_blob(data), _blob(key), F.lit("CBC"), F.lit("PKCS"), F.lit(bytes(16))), 17, 1 << 30)  # without the IV in front


def decrypt(data, key, kind: str = "aes") -> Column:
    if kind.endswith("ecb"):
        return F.aes_decrypt(_blob(data), _blob(key), F.lit("ECB"), F.lit("PKCS"))
    return F.aes_decrypt(F.concat(F.lit(bytes(16)), _blob(data)), _blob(key), F.lit("CBC"), F.lit("PKCS"))


def encrypt_iv(data, key, iv: bytes) -> Column:
    return F.substring(F.aes_encrypt(_blob(data), _blob(key), F.lit("CBC"), F.lit("PKCS"), F.lit(iv)), 17, 1 << 30)


def decrypt_iv(data, key, iv: bytes) -> Column:
    return F.aes_decrypt(F.concat(F.lit(iv), _blob(data)), _blob(key), F.lit("CBC"), F.lit("PKCS"))


def salted_hash(password, salt: str, rounds: int = 1000) -> Column:
    """A stored password: salt and iterated SHA-256 of salt and password (checked by salted_equals)."""
    one = F.sha2(F.concat(F.lit(salt), _c(password)), 256)
    looped = F.aggregate(F.sequence(F.lit(2), F.lit(max(rounds, 2))), one, lambda h, _: F.sha2(h, 256))
    return F.concat(F.lit(f"{salt}${rounds}$"), looped if rounds > 1 else one)


def salted_equals(stored, password, salt: str, rounds: int = 1000) -> Column:
    """chkpass: the type's = compares a password with the stored form."""
    return _c(stored) == salted_hash(password, salt, rounds)


# metaphone
def metaphone(s, limit: int = 255) -> Column:
    """Lawrence Philips' metaphone: consonant sounds of an English word, a first vowel kept."""
    w = F.regexp_replace(F.upper(_c(s)), "[^A-Z]", "")
    #: The published rules, in order; lower-case letters are final sounds.
    rules = (
        ("^(AE|GN|KN|PN|WR)", ""), ("^X", "s"), ("^WH", "w"), ("([^C])\\1", "$1"), ("MB", "m"), ("TCH", "x"), ("SCH", "sk"), ("(C|S)IA", "xA"), ("CH", "x"), ("SC(?=[EIY])", "s"), ("C(?=[EIY])", "s"),
        ("(C|Q)", "k"), ("DG(?=[EIY])", "j"), ("D", "t"), ("GH(?=[^AEIOUY]|$)", ""), ("GN(ED)?$", "n$1"), ("G(?=[EIY])", "j"), ("GH", "k"), ("G", "k"), ("(?<=[CSPTGaeiouckstpx])H", ""), ("H(?=[^AEIOU]|$)", ""),
        ("H", "h"), ("(?<=k)K", ""), ("K", "k"), ("PH", "f"), ("SH|S(?=IO|IA)", "x"), ("T(?=IA|IO)", "x"), ("TH", "0"), ("V", "f"), ("W(?=[AEIOU])", "w"), ("W", ""), ("X", "ks"), ("Y(?=[AEIOU])", "y"), ("Y", ""), ("Z", "s"),
    )
    first = F.when(w.rlike("^(AE)"), "E").when(w.rlike("^[AEIOU]"), F.substring(w, 1, 1)).otherwise("")
    body = w
    for a, b in rules:
        if a == "^(AE|GN|KN|PN|WR)":
            body = F.regexp_replace(body, "^AE", "E")
            body = F.regexp_replace(body, "^[GKP]N", "N")
            body = F.regexp_replace(body, "^WR", "R")
        else:
            body = F.regexp_replace(body, a, b)
    body = F.upper(F.regexp_replace(body, "[AEIOU]", ""))
    return F.substring(F.concat(first, body), 1, limit)


# more of key-value maps
def hstore_record(*cols: str) -> Column:
    """hstore(record): every field by its name, as text."""
    return F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*(F.col(c).cast("string") for c in cols)))


def hstore_defined(m, key: str) -> Column:
    """The key is there and its value isn't null."""
    return F.coalesce(F.try_element_at(_c(m), F.lit(key)).isNotNull(), F.lit(False))


def hstore_akeys(m) -> Column:
    return F.array_sort(F.map_keys(_c(m)))


def hstore_avals(m) -> Column:
    return F.transform(F.array_sort(F.map_entries(_c(m))), lambda e: e["value"])


def hstore_to_json(m) -> Column:
    return F.to_json(_c(m), {"ignoreNullFields": "false"})


def hstore_delete_pairs(a, b) -> Column:
    """Pairs of a that b has with the same value go."""
    return F.map_filter(_c(a), lambda k, v: ~(F.map_contains_key(_c(b), k) & F.try_element_at(_c(b), k).eqNullSafe(v)))


def hstore_exists_all(m, *keys: str) -> Column:
    return reduce(lambda p, q: p & q, [F.map_contains_key(_c(m), k) for k in keys])


# path patterns
def lquery(p, pattern: str) -> Column:
    """path ~ pattern: labels, * for any labels, *{n}, *{n,m}, a|b, !a, and the marks @ (any case) and * (prefix) on a label."""
    import re as _re

    def label(x: str) -> str:
        negative, x = x.startswith("!"), x.lstrip("!")
        parts = []
        for y in x.split("|"):
            marks = _re.search("[@*%]*$", y)[0]
            word = _re.escape(y[: len(y) - len(marks)]) + ("\\w*" if "*" in marks else "")
            parts.append(f"(?i:{word})" if "@" in marks else word)
        one = "(?:" + "|".join(parts) + ")"
        return f"(?!{one}(?:\\.|$))\\w+" if negative else one

    out = ""
    for x in pattern.split("."):
        if m := _re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", x):
            low = m[1] or "0"
            high = "" if m[1] is None or (m[2] and not m[3]) else (m[3] or m[1])
            out += f"(?:\\.\\w+){{{low},{high}}}"
        else:
            out += "\\." + label(x)
    return F.concat(F.lit("."), _c(p)).rlike(f"^{out}$")


# integer queries
def query_int(a, text: str) -> Column:
    """array @@ query_int: whole numbers with & | ! and parentheses."""
    from quern.functions.textsearch import to_tsquery

    def holds(q) -> Column:
        if q.op == "word":
            return F.array_contains(_c(a), int(q.args[0]))
        if q.op == "!":
            return ~holds(q.args[0])
        x, y = (holds(z) for z in q.args)
        return x & y if q.op == "&" else x | y

    return holds(to_tsquery(text))


def int_subtract(a, b) -> Column:
    return F.sort_array(F.array_except(_c(a), _c(b)))


def int_intersect(a, b) -> Column:
    return F.sort_array(F.array_intersect(_c(a), _c(b)))


def int_array_aggregate(x) -> Column:
    """All values of a group, nulls too, as an array."""
    from quern.semantics import array_agg

    return array_agg(x)


def int_array_enum(a) -> Column:
    """A row for each element."""
    return F.explode(_c(a))


# more product numbers
def isbn13_from_isbn10(s) -> Column:
    """The 13 digits of a 10-digit number, with their own check digit."""
    d = F.concat(F.lit("978"), F.substring(F.regexp_replace(_c(s), "[^0-9X]", ""), 1, 9))
    return F.concat(d, ean13_check(d))


def ean13_check(twelve) -> Column:
    d = F.split(_c(twelve), "")
    total = reduce(lambda p, q: p + q, [F.element_at(d, i + 1).cast("int") * (3 if i % 2 else 1) for i in range(12)])
    return F.pmod(-total, F.lit(10)).cast("string")


def issn_check(seven) -> Column:
    d = F.split(_c(seven), "")
    r = F.pmod(11 - reduce(lambda p, q: p + q, [F.element_at(d, i + 1).cast("int") * (8 - i) for i in range(7)]) % 11, F.lit(11))
    return F.when(r == 10, "X").otherwise(r.cast("string"))


# XPath over text
def xpath_list(x, path: str, separator: str = ",") -> Column:
    return F.array_join(F.xpath(_c(x), F.lit(path)), separator)


def xpath_string(x, path: str) -> Column:
    return F.xpath_string(_c(x), F.lit(path))


def xpath_number(x, path: str) -> Column:
    return F.xpath_number(_c(x), F.lit(path))


def xpath_table(df: DataFrame, key: str, xml: str, paths: dict[str, str]) -> DataFrame:
    """One row for each nth match of the paths in a row's document."""
    found = {n: F.xpath(F.col(xml), F.lit(p)) for n, p in paths.items()}
    most = F.greatest(*(F.size(c) for c in found.values()), F.lit(0))
    nth = F.explode(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")))
    return df.select(F.col(key), F.col(xml), nth.alias("__n")).select(key, *(F.try_element_at(c, F.col("__n")).alias(n) for n, c in found.items()))


# more of cubes and segments
def cube_union(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.struct(F.zip_with(a["lo"], b["lo"], lambda x, y: F.least(x, y)).alias("lo"), F.zip_with(a["hi"], b["hi"], lambda x, y: F.greatest(x, y)).alias("hi"))


def cube_inter(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.struct(F.zip_with(a["lo"], b["lo"], lambda x, y: F.greatest(x, y)).alias("lo"), F.zip_with(a["hi"], b["hi"], lambda x, y: F.least(x, y)).alias("hi"))


def cube_enlarge(c, r: float) -> Column:
    """Every side moved out by r (in, for a negative r, as far as the middle)."""
    lo, hi = F.transform(_c(c)["lo"], lambda x: x - r), F.transform(_c(c)["hi"], lambda x: x + r)
    mid = F.zip_with(lo, hi, lambda x, y: (x + y) / 2)
    return F.struct(F.zip_with(lo, mid, lambda x, m: F.least(x, m)).alias("lo"), F.zip_with(hi, mid, lambda x, m: F.greatest(x, m)).alias("hi"))


def cube_dim(c) -> Column:
    return F.size(_c(c)["lo"])


def earth_box(lat, lon, radius: float) -> Column:
    """A box in degrees that holds every place within radius metres."""
    d = F.degrees(F.lit(radius / EARTH))
    e = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(radius / EARTH)) / F.greatest(F.cos(F.radians(_c(lat))), F.lit(1e-12)))))
    return cube(F.array(_c(lat) - d, _c(lon) - e), F.array(_c(lat) + d, _c(lon) + e))


# a parser of words and blanks
def simple_tokens(s) -> Column:
    """Tokens of (type 3, a word) and (type 12, blanks between)."""
    parts = F.regexp_extract_all(_c(s), F.lit(r"([^ ]+|[ ]+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.when(F.trim(p) == "", 12).otherwise(3).alias("tokid"), p.alias("token")))
