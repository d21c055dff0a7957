"""Domains, money, uuids, case-insensitive text, number templates, sequences and session facts."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.semantics import _c


@dataclass(frozen=True)
class Domain:
    """A base type with constraints; check() gives the value or an error."""

    base: str
    constraint: str = "true"  # over the name `value`
    not_null: bool = False
    default: object = None

    def check(self, x) -> Column:
        v = F.coalesce(_c(x).cast(self.base), F.lit(self.default).cast(self.base)) if self.default is not None else _c(x).cast(self.base)
        ok = F.transform(F.array(v.alias("value")), lambda value: F.coalesce(_constraint(self.constraint, value), F.lit(True)))[0]
        bad = ~ok | (v.isNull() if self.not_null else F.lit(False))
        return F.when(bad, F.raise_error(F.lit(f"value violates the domain's check: {self.constraint}")).cast(self.base)).otherwise(v)


def _constraint(text: str, value: Column) -> Column:
    """`value op literal` joined by `and`, with op one of < <= > >= = <> like."""
    out = F.lit(True)
    for part in re.split(r"\s+and\s+", text):
        if part == "true":
            continue
        m = re.fullmatch(r"value\s*(<=|>=|<>|<|>|=|like)\s*(.+)", part.strip())
        if not m:
            raise ValueError(part)
        lit = F.expr(m[2])
        out = out & {"<": value < lit, "<=": value <= lit, ">": value > lit, ">=": value >= lit, "=": value == lit, "<>": value != lit, "like": value.like(m[2].strip("'"))}[m[1]]
    return out


def money(x) -> Column:
    return _c(x).cast("decimal(19,2)")


def money_text(x) -> Column:
    """$1,234.50, negative amounts as -$1,234.50."""
    v = money(x)
    return F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(v), 2))


def money_div(a, b) -> Column:
    """money / money is a number."""
    return _c(a).cast("double") / _c(b).cast("double")


def uuid_text(hexes: Column) -> Column:
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *(F.substring(hexes, a, n) for a, n in parts))


def _named(digest: Column, version: str) -> Column:
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return uuid_text(F.concat(F.substring(digest, 1, 12), F.lit(version), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)))


def uuid_v3(namespace: uuid.UUID, name) -> Column:
    return _named(F.md5(F.concat(F.lit(namespace.bytes), F.encode(_c(name), "UTF-8"))), "3")


def uuid_v5(namespace: uuid.UUID, name) -> Column:
    return _named(F.sha1(F.concat(F.lit(namespace.bytes), F.encode(_c(name), "UTF-8"))), "5")


def ci(x) -> Column:
    """Text that compares without case."""
    return F.collate(_c(x), "UTF8_LCASE")


def to_number(s, template: str) -> Column:
    """9 0 . D , G S MI PL SG PR L V TH templates: what isn't a digit, sign or point is dropped; V shifts the point; digits beyond the template are cut."""
    s = _c(s)
    negative = s.rlike("-|<.*>")
    places = lambda part: len(re.findall("[09]", part))
    whole, _, part = template.replace("D", ".").partition(".")
    digits = F.regexp_replace(s, "[^0-9.]", "")
    scale = places(part)
    if "V" in template:
        shift = places(template.split("V")[1])
        v = (digits.cast("decimal(38,10)") / 10**shift).cast(f"decimal(38,{max(shift, scale)})")
    else:
        parts = F.split(digits, "\\.")
        head = F.substring(parts[0], 1, places(whole))
        tail = F.substring(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), 1, scale)
        v = F.concat(F.when(head == "", "0").otherwise(head), F.lit("."), tail, F.lit("0")).cast(f"decimal(38,{scale})")
    return F.when(negative, -v).otherwise(v)


def nextval(df: DataFrame, name: str, start: int = 1, step: int = 1, order: list | None = None) -> DataFrame:
    """A gap-free number for each row: rows of each partition are counted, then numbered in it, without one global sort."""
    rows = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each partition
    before = sizes.select(F.col("__p").alias("__q"), (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy("__i")) - 1
    rows = rows.withColumn("__r", within).join(F.broadcast(before), F.col("__p") == F.col("__q"))
    return rows.withColumn(name, (F.lit(start) + (F.col("__b") + F.col("__r")) * step).cast("long")).drop("__p", "__i", "__q", "__b", "__r", "__n")


def typeof_name(x) -> Column:
    """Type names by the SQL standard."""
    t = F.typeof(_c(x))
    #: Names of types.
    names = {"int": "integer", "string": "text", "double": "double precision", "float": "real", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp with time zone", "binary": "bytea", "tinyint": "smallint"}
    out = t
    for a, b in names.items():
        out = F.when(t == a, b).otherwise(out)
    return F.when(t.startswith("decimal"), "numeric").otherwise(out)


# segments: (low, high) with the precision they were written in
def seg(low, high) -> Column:
    return F.struct(F.least(_c(low), _c(high)).cast("double").alias("lo"), F.greatest(_c(low), _c(high)).cast("double").alias("hi"))


def seg_overlap(a, b) -> Column:
    return (_c(a)["lo"] <= _c(b)["hi"]) & (_c(b)["lo"] <= _c(a)["hi"])


def seg_contains(a, b) -> Column:
    return (_c(a)["lo"] <= _c(b)["lo"]) & (_c(a)["hi"] >= _c(b)["hi"])


def seg_over_left(a, b) -> Column:
    return _c(a)["hi"] <= _c(b)["hi"]


# dictionaries
def dict_int(token, max_len: int = 6, reject_long: bool = False) -> Column:
    """Numbers longer than max_len are cut, or refused."""
    t = _c(token)
    long = F.length(t) > max_len
    return F.when(long, F.lit(None).cast("string") if reject_long else F.substring(t, 1, max_len)).otherwise(t)


def dict_synonyms(df: DataFrame, token: str, synonyms: DataFrame) -> DataFrame:
    """One row for the token and one for each synonym; synonyms (word, synonym)."""
    extra = df.join(synonyms, F.col(token) == F.col("word")).drop("word").withColumn(token, F.col("synonym")).drop("synonym")
    return df.unionByName(extra)


# facts about the session and sizes
def current_setting(spark, name: str, missing_ok: bool = False):
    """A setting's value; an unknown one is an error unless missing_ok."""
    value = spark.conf.get(name, None)
    if value is None and not missing_ok:
        raise ValueError(f"unrecognized configuration parameter: {name!r}")
    return value


def set_config(spark, name: str, value: str) -> str:
    spark.conf.set(name, value)
    return value


def relation_size(df: DataFrame) -> int:
    """Bytes of the files that a table is read from."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def column_size(x, kind: str) -> Column:
    """Bytes of a value of a fixed type, or of a text's bytes with their length word."""
    fixed = {"smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4, "timestamp_ntz": 8, "timestamp": 8}
    x = _c(x)
    return F.when(x.isNotNull(), F.lit(fixed[kind]) if kind in fixed else F.octet_length(x) + F.when(F.octet_length(x) < 127, 1).otherwise(4))
