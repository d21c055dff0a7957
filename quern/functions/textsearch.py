"""Full-text search: a tsvector is a map from lexeme to its positions, a query a Python tree.

A position is a whole number whose upper bits hold its weight: position + WEIGHT * (0 for D, 1 for C, 2 for B, 3 for A).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quern.semantics import _c

#: A short English stop list.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: Default weights of D, C, B and A.
WEIGHTS = (0.1, 0.2, 0.4, 1.0)
#: A step of weight within a position.
WEIGHT = 1 << 14


def to_tsvector(text, stop: tuple[str, ...] = STOP) -> Column:
    """Lower-cased words with 1-based positions; stop words count as positions but aren't kept."""
    words = F.filter(F.split(F.lower(_c(text)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    at = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i"))), lambda s: ~s["w"].isin(*stop) if stop else F.lit(True))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(at, lambda s: s["w"])), lambda w: F.struct(w, F.transform(F.filter(at, lambda s: s["w"] == w), lambda s: s["i"]))))


@dataclass(frozen=True)
class Query:
    op: str  # word, prefix, &, | or !
    args: tuple

    def __and__(self, other: Query) -> Query:
        return Query("&", (self, other))

    def __or__(self, other: Query) -> Query:
        return Query("|", (self, other))

    def __invert__(self) -> Query:
        return Query("!", (self,))

    def words(self) -> list[str]:
        if self.op == "weighted":
            return self.args[0].words()
        return [self.args[0]] if self.op in ("word", "prefix") else [w for a in self.args for w in a.words()]

    def numnode(self) -> int:
        return 1 if self.op in ("word", "prefix", "weighted") else 1 + sum(a.numnode() for a in self.args)

    def rewrite(self, target: Query, new: Query) -> Query:
        if self == target:
            return new
        return self if self.op in ("word", "prefix", "weighted") else Query(self.op, tuple(a.rewrite(target, new) for a in self.args))

    def match(self, v) -> Column:
        v = _c(v)
        if self.op == "word":
            return F.map_contains_key(v, self.args[0])
        if self.op == "prefix":
            return F.exists(F.map_keys(v), lambda k: F.startswith(k, F.lit(self.args[0])))
        if self.op == "weighted":
            inner, letters = self.args
            wanted = ["DCBA".index(x) for x in letters]
            return F.exists(_positions(v, inner), lambda p: F.floor(p / WEIGHT).isin(*wanted))
        if self.op == "!":
            return ~self.args[0].match(v)
        a, b = (x.match(v) for x in self.args)
        return a & b if self.op == "&" else a | b


def to_tsquery(text: str) -> Query:
    """& | ! and parentheses, :* for prefixes, :AB for weights; ! binds tightest, then &, then |."""
    tokens = re.findall(r"[\w]+(?::[*a-d]+)?|[&|!()]", text.lower())
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either():
        out = both()
        while peek() == "|":
            take()
            out = out | both()
        return out

    def both():
        out = unit()
        while peek() == "&":
            take()
            out = out & unit()
        return out

    def unit():
        t = take()
        if t == "!":
            return ~unit()
        if t == "(":
            out = either()
            if take() != ")":
                raise ValueError("a parenthesis is missing")
            return out
        word, _, marks = t.partition(":")
        out = Query("prefix" if "*" in marks else "word", (word,))
        letters = marks.replace("*", "")
        return with_weight(out, letters) if letters else out

    out = either()
    if at != len(tokens):
        raise ValueError(f"syntax error in query: {text!r}")
    return out


def plainto_tsquery(text: str) -> Query:
    words = [w for w in re.findall(r"\w+", text.lower()) if w not in STOP]
    out = Query("word", (words[0],))
    for w in words[1:]:
        out = out & Query("word", (w,))
    return out


def _positions(v: Column, q: Query) -> Column:
    """All positions of a query's word, or of the words with its prefix."""
    none = F.array().cast("array<int>")
    if q.op == "word":
        return F.coalesce(F.try_element_at(v, F.lit(q.args[0])), none)
    return F.flatten(F.map_values(F.map_filter(v, lambda k, _: F.startswith(k, F.lit(q.args[0])))))


def _entries(v: Column, q: Query) -> Column:
    """The positions of each lexeme that the word or prefix meets."""
    if q.op == "word":
        return F.when(F.map_contains_key(v, q.args[0]), F.array(F.element_at(v, F.lit(q.args[0])))).otherwise(F.array().cast("array<array<int>>"))
    return F.map_values(F.map_filter(v, lambda k, _: F.startswith(k, F.lit(q.args[0]))))


def _weight(p: Column, weights: tuple) -> Column:
    w = F.floor(p / WEIGHT)
    return F.when(w == 0, weights[0]).when(w == 1, weights[1]).when(w == 2, weights[2]).otherwise(weights[3])


def _leaves(q: Query) -> list[Query]:
    return [q] if q.op in ("word", "prefix") else _leaves(q.args[0]) if q.op == "weighted" else [x for a in q.args for x in _leaves(a)]


def _rank_or(v: Column, leaves: list[Query], weights: tuple) -> Column:
    """Each lexeme's weights over squared ordinals, its largest weight counted as if it came first, over pi^2/6; averaged over the words."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(-1.0).alias("most"), F.lit(0).alias("at"))

    def add(a, p):
        w = _weight(p, weights).cast("double")
        up = w > a["most"]
        s = a["s"] + w / ((a["n"] + 1) * (a["n"] + 1))
        return F.struct(s.alias("s"), (a["n"] + 1).alias("n"), F.when(up, w).otherwise(a["most"]).alias("most"), F.when(up, a["n"]).otherwise(a["at"]).alias("at"))

    one = lambda ps: F.aggregate(F.when(F.size(ps) > 0, ps).otherwise(F.array(F.lit(1))), start, add, lambda a: (a["most"] + a["s"] - a["most"] / ((a["at"] + 1) * (a["at"] + 1))) / 1.64493406685)
    total = F.lit(0.0)
    for q in leaves:
        total = total + F.aggregate(F.transform(_entries(v, q), one), F.lit(0.0), lambda a, x: a + x)
    return total / max(len(leaves), 1)


def _rank_and(v: Column, leaves: list[Query], weights: tuple) -> Column:
    """Pairs of positions of different words: closer and heavier ones count more; 1 - the product of what each pair leaves."""
    left = F.lit(1.0)
    seen = F.lit(False)
    for i, a in enumerate(leaves):
        for b in leaves[:i]:
            near = lambda d: F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
            pairs = F.flatten(F.transform(_positions(v, a), lambda p: F.transform(_positions(v, b), lambda q: F.struct(p.alias("p"), q.alias("q")))))
            pairs = F.filter(pairs, lambda x: x["p"] % WEIGHT != x["q"] % WEIGHT)
            gains = F.transform(pairs, lambda x: 1 - F.sqrt(_weight(x["p"], weights) * _weight(x["q"], weights) * near(F.abs(x["p"] % WEIGHT - x["q"] % WEIGHT).cast("double"))))
            left = left * F.aggregate(gains, F.lit(1.0), lambda s, g: s * g)
            seen = seen | (F.size(pairs) > 0)
    return F.when(seen, 1 - left).otherwise(1e-20)


def ts_rank(v, query: Query, weights: tuple = WEIGHTS, normalise: bool = False) -> Column:
    """Rank by frequency and, where the query is a conjunction, by nearness; normalise divides by the number of lexemes."""
    v, leaves = _c(v), list(dict.fromkeys(_leaves(query)))
    total = _rank_and(v, leaves, weights) if query.op == "&" and len(leaves) > 1 else _rank_or(v, leaves, weights)
    return total / F.greatest(F.size(F.map_keys(v)), F.lit(1)) if normalise else total


def _last_start(q: Query, lasts: Column, leaves: list[Query]) -> Column:
    """The last hit from which a stretch up to now meets the query, by the last hit of each word; -1 for none."""
    if q.op in ("word", "prefix"):
        return lasts[leaves.index(q)]
    if q.op == "weighted":
        return _last_start(q.args[0], lasts, leaves)
    if q.op == "!":
        return F.lit(1 << 30)
    a, b = (_last_start(x, lasts, leaves) for x in q.args)
    return F.least(a, b) if q.op == "&" else F.greatest(a, b)


def ts_rank_cd(v, query: Query, weights: tuple = WEIGHTS) -> Column:
    """Cover density: sum over the shortest stretches that meet the query of their mean harmonic weight, less for every word between.

    One pass over the words' positions in order: a stretch is a shortest one where its start moves on. A negated word is ignored.
    """
    v, leaves = _c(v), list(dict.fromkeys(_leaves(query)))
    mark = lambda k, ps: F.transform(ps, lambda p: F.struct((p % WEIGHT).alias("at"), F.lit(k).alias("k"), _weight(p, weights).cast("double").alias("w")))
    hits = F.array_sort(F.flatten(F.array(*(mark(k, _positions(v, q)) for k, q in enumerate(leaves)))))

    def cover(hits: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.array(*(F.lit(-1) for _ in leaves)).alias("lasts"), F.lit(-1).alias("before"), F.lit(0.0).alias("total"))

        def add(s, h):
            lasts = F.transform(s["lasts"], lambda l, k: F.when(k == h["k"], s["i"]).otherwise(l))

            def gain(x):
                b, e = x["b"], s["i"]
                inside = F.slice(hits, b + 1, e - b + 1)
                noise = h["at"] - F.element_at(hits, b + 1)["at"] - (e - b)
                noise = F.when(noise < 0, F.floor((e - b) / 2)).otherwise(noise)
                return (e - b + 1) / F.aggregate(inside, F.lit(0.0), lambda t, y: t + 1.0 / y["w"]) / (noise + 1.0)

            def step(ls):
                b = _last_start(query, ls, leaves)
                b = F.when(b > s["i"], -1).otherwise(b)
                more = F.when(b > s["before"], F.transform(F.array(F.struct(b.alias("b"))), gain)[0]).otherwise(0.0)
                return F.struct((s["i"] + 1).alias("i"), ls.alias("lasts"), F.greatest(b, s["before"]).alias("before"), (s["total"] + more).alias("total"))

            return F.transform(F.array(lasts), step)[0]

        return F.aggregate(hits, start, add, lambda s: s["total"])

    return F.transform(F.array(hits), cover)[0]


def setweight(v, letter: str) -> Column:
    """All positions with that weight."""
    step = "DCBA".index(letter.upper()) * WEIGHT
    return F.transform_values(_c(v), lambda k, p: F.transform(p, lambda i: i % WEIGHT + step))


def with_weight(query: Query, letters: str) -> Query:
    """word:AB: the word where it has one of these weights."""
    return Query("weighted", (query, letters.upper()))


def tsvector_text(v) -> Column:
    """'word':1,2B 'other':3 in order of the words."""
    letter = lambda p: F.element_at(F.array(*(F.lit(x) for x in ("", "C", "B", "A"))), (F.floor(p / WEIGHT) + 1).cast("int"))
    places = lambda ps: F.array_join(F.transform(F.array_sort(ps, lambda a, b: a % WEIGHT - b % WEIGHT), lambda p: F.concat((p % WEIGHT).cast("string"), letter(p))), ",")
    return F.array_join(F.transform(F.array_sort(F.map_entries(_c(v))), lambda e: F.concat(F.lit("'"), e["key"], F.lit("'"), F.when(F.size(e["value"]) > 0, F.concat(F.lit(":"), places(e["value"]))).otherwise(""))), " ")


def parse_tsvector(text: str) -> Column:
    """A literal such as a:1 s:2C d."""
    entries: dict[str, list[int]] = {}
    for m in re.finditer(r"(?:'((?:[^']|'')*)'|([^\s:]+))(?::([\d,A-Da-d]+))?", text):
        word = m[1].replace("''", "'") if m[1] is not None else m[2]
        places = [int(p.rstrip("ABCDabcd")) + "DCBA".index((re.sub(r"\d", "", p) or "D").upper()) * WEIGHT for p in (m[3] or "").split(",") if p]
        entries.setdefault(word, []).extend(places)
    flat = [x for w, ps in entries.items() for x in (F.lit(w), F.array(*map(F.lit, sorted(set(ps), key=lambda p: p % WEIGHT))) if ps else F.array().cast("array<int>"))]
    return F.create_map(*flat)


#: Token types of the default parser, with their numbers and descriptions.
TOKENS = {
    "asciiword": (1, "Word, all ASCII"), "word": (2, "Word, all letters"), "numword": (3, "Word, letters and digits"), "email": (4, "Email address"), "url": (5, "URL"), "host": (6, "Host"),
    "sfloat": (7, "Scientific notation"), "version": (8, "Version number"), "hword_numpart": (9, "Hyphenated word part, letters and digits"), "hword_part": (10, "Hyphenated word part, all letters"),
    "hword_asciipart": (11, "Hyphenated word part, all ASCII"), "blank": (12, "Space symbols"), "tag": (13, "XML tag"), "protocol": (14, "Protocol head"), "numhword": (15, "Hyphenated word, letters and digits"),
    "asciihword": (16, "Hyphenated word, all ASCII"), "hword": (17, "Hyphenated word, all letters"), "url_path": (18, "URL path"), "file": (19, "File or path name"), "float": (20, "Decimal notation"), "int": (21, "Signed integer"),
    "uint": (22, "Unsigned integer"), "entity": (23, "XML entity"),
}
_TOKEN = re.compile(
    r"(?P<tag><[/!?]?[A-Za-z][^<>]*>)|(?P<entity>&(?:\w+|#\d+);)|(?P<email>[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)|(?P<protocol>[a-z]+://)|(?P<host>(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w.]))"
    r"|(?P<url_path>(?<=[A-Za-z])/[\w./?&=%-]+)|(?P<file>/[\w./-]+)|(?P<sfloat>[+-]?\d+(?:\.\d+)?[eE][+-]?\d+)|(?P<version>\d+\.\d+(?:\.\d+)+)|(?P<float>[+-]?\d+\.\d+)"
    r"|(?P<hyphen>[^\W_]+(?:-[^\W_]+)+)|(?P<int>(?<![^\W_])[+-]\d+(?![^\W_]))|(?P<uint>\d+(?![^\W_]))|(?P<letters>[^\W\d_]+(?![\w]))|(?P<numword>[^\W_]+)|(?P<blank>[^\w<&+/-]+|.)",
    re.S,
)


def parse_tokens(text: str) -> list[tuple[str, str]]:
    """(type, token) of the default parser: words, numbers, hosts, addresses, tags and what lies between; a hyphenated word comes whole and in parts."""
    out: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(text):
        kind, t = m.lastgroup, m[0]
        if kind == "letters":
            out.append(("asciiword" if t.isascii() else "word", t))
        elif kind == "hyphen":
            plain, num = t.isascii(), any(c.isdigit() for c in t)
            out.append(("numhword" if num else "asciihword" if plain else "hword", t))
            for i, p in enumerate(t.split("-")):
                out += [("blank", "-")] if i else []
                out.append(("hword_numpart" if any(c.isdigit() for c in p) else "hword_asciipart" if p.isascii() else "hword_part", p))
        elif kind == "blank" and out and out[-1][0] == "blank":
            out[-1] = ("blank", out[-1][1] + t)
        else:
            out.append((kind, t))
    return out


def ts_parse(docs: DataFrame, text: str) -> DataFrame:
    """The rows of docs, one for each token: nth, tokid, alias, token."""
    import pandas as pd

    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([[(i + 1, TOKENS[k][0], k, t) for i, (k, t) in enumerate(parse_tokens(x or ""))] for x in texts])

    tokens.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    found = F.pandas_udf(tokens, "array<struct<nth: int, tokid: int, alias: string, token: string>>")
    return docs.withColumn("__t", F.explode(found(F.col(text)))).select(*docs.columns, "__t.*")


def ts_lexize(token, stop: tuple[str, ...] = STOP) -> Column:
    """The simple dictionary: the lower-cased word; an empty array for a stop word."""
    w = F.lower(_c(token))
    return F.when(w.isin(*stop), F.array().cast("array<string>")).otherwise(F.array(w))


def ts_debug(docs: DataFrame, text: str) -> DataFrame:
    """ts_parse with each type's description, its dictionary and the lexemes it gives."""
    known = docs.sparkSession.createDataFrame([(k, d, None if k in ("blank", "tag", "entity", "protocol") else "simple") for k, (_, d) in TOKENS.items()], "alias string, description string, dictionary string")
    out = ts_parse(docs, text).join(F.broadcast(known), "alias")
    return out.withColumn("lexemes", F.when(F.col("dictionary").isNotNull(), ts_lexize("token")))


def strip(v) -> Column:
    return F.transform_values(_c(v), lambda k, p: F.array().cast("array<int>"))


def tsvector_concat(a, b) -> Column:
    """b's positions follow on from a's largest."""
    a, b = _c(a), _c(b)
    last = F.coalesce(F.array_max(F.flatten(F.map_values(a))), F.lit(0))
    moved = F.transform_values(b, lambda k, p: F.transform(p, lambda i: i + last))
    return F.map_zip_with(a, moved, lambda k, x, y: F.concat(F.coalesce(x, F.array().cast("array<int>")), F.coalesce(y, F.array().cast("array<int>"))))


def headline(text, query: Query, start: str = "<b>", stop: str = "</b>", max_words: int | None = None, max_fragments: int = 0, delimiter: str = " ... ") -> Column:
    """The text with the query's words marked; with max_words the stretch around the first hit, or so many stretches as max_fragments says."""
    p = "(?iu)(?<![\\p{L}\\p{N}])(" + "|".join(map(re.escape, query.words())) + ")(?![\\p{L}\\p{N}])"
    if max_words is None:
        return F.regexp_replace(_c(text), p, f"{start}$1{stop}")
    words = F.filter(F.split(_c(text), "\\s+"), lambda w: w != "")
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(p), i)), lambda i: i.isNotNull())
    # a stretch begins at the first hit that the one before doesn't hold
    starts = F.aggregate(hits, F.array().cast("array<int>"), lambda a, i: F.when((F.size(a) == 0) | (i >= F.try_element_at(a, F.lit(-1)) + max_words), F.array_append(a, i)).otherwise(a))
    starts = F.when(F.size(starts) > 0, F.slice(starts, 1, max(max_fragments, 1))).otherwise(F.array(F.lit(0)))
    pieces = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(max_words)), " "))
    return F.regexp_replace(F.array_join(pieces, delimiter), p, f"{start}$1{stop}")


def ts_stat(docs: DataFrame, vector: str) -> DataFrame:
    """word, ndoc, nentry."""
    rows = docs.select(F.explode(vector).alias("word", "at"))
    return rows.groupBy("word").agg(F.count("*").alias("ndoc"), F.sum(F.size("at")).alias("nentry"))
