"""COPY in text and CSV form, external tables, and remote queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators import recursion

#: Escapes of the text form.
ESCAPES = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\v", "\v"))


def copy_from(spark: SparkSession, path: str, schema, *, csv: bool = False, delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', escape: str | None = None) -> DataFrame:
    """Read a COPY file. Text form: tab, \\N for null, backslash escapes; CSV: comma, unquoted empty for null. A bad row is an error."""
    r = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST")
    if csv:
        return r.option("sep", delimiter or ",").option("nullValue", null or "").option("quote", quote).option("escape", escape or quote).option("multiLine", True).csv(path)
    from pyspark.sql import types as T

    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    null = "\\N" if null is None else null
    lines = spark.read.text(path).where(F.col("value") != "\\.")  # the end mark
    if header:
        raise ValueError("COPY HEADER is for CSV only")
    # an escaped backslash is kept apart as a zero character, which no text holds, so that the others can be told from it
    kept = F.replace(F.col("value"), F.lit("\\\\"), F.lit("\0"))
    fields = F.split(kept, "(?<!\\\\)" + re.escape(delimiter or "\t"))
    n = len(schema.fields)
    rows = lines.select(F.when(F.size(fields) == n, fields).otherwise(F.raise_error(F.concat(F.lit(f"a row of COPY data hasn't {n} columns: "), F.col("value"))).cast("array<string>")).alias("f"))

    def plain(x):
        for a, b in ESCAPES:
            x = F.replace(x, F.lit(a), F.lit(b))
        x = F.replace(x, F.lit("\\" + (delimiter or "\t")), F.lit(delimiter or "\t"))
        return F.replace(x, F.lit("\0"), F.lit("\\"))

    def value(i: int, t):
        text = F.col("f")[i]
        made = plain(text).cast(t)
        bad = F.raise_error(F.concat(F.lit(f"invalid input syntax for type {t.simpleString()}: "), text)).cast(t)
        return F.when(F.replace(text, F.lit("\0"), F.lit("\\\\")) == null, None).when(made.isNull(), bad).otherwise(made)

    return rows.select(*(value(i, f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))


def copy_to(df: DataFrame, path: str, *, csv: bool = False, delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', force_quote: bool = False) -> None:
    """Write a table or query in COPY's form."""
    if csv:
        df.write.option("sep", delimiter or ",").option("header", header).option("quote", quote).option("escape", quote).option("nullValue", null or "").option("emptyValue", '""').option("quoteAll", force_quote).csv(path)
        return

    def esc(c):
        c = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
        for a, b in ESCAPES:
            c = F.replace(c, F.lit(b), F.lit(a))
        return c if (delimiter or "\t") == "\t" else F.replace(c, F.lit(delimiter), F.lit("\\" + delimiter))

    line = F.concat_ws(delimiter or "\t", *(F.coalesce(esc(F.col(c)), F.lit("\\N" if null is None else null)) for c in df.columns))
    df.select(line.alias("value")).write.text(path)


def remote(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query on another server; filters and columns are pushed down by the JDBC source."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def values(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def create_table_as(df: DataFrame, name: str, keys: list[str] | None = None, buckets: int = 0, path: str | None = None) -> DataFrame:
    """SELECT INTO; with keys and buckets later joins on the keys need no shuffle."""
    w = df.write.mode("errorifexists").format("parquet")
    if keys and buckets:
        w = w.bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def numbered(df: DataFrame, order: list, name: str = "__n") -> DataFrame:
    """Each row's 1-based place in the order: a range sort, rows counted for each partition, then numbered within it."""
    from pyspark.sql import Window

    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    rows = recursion.cut(rows, "numbered")  # the partitions must not change between the two readings
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__c"))  # a row for each partition
    before = sizes.select(F.col("__p").alias("__q"), (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy("__i"))
    return rows.withColumn("__r", within).join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__b") + F.col("__r")).drop("__p", "__i", "__q", "__b", "__r")


class Cursor:
    """DECLARE ... SCROLL CURSOR over a query in an order: FETCH and MOVE by count, to a place, or back.

    The result is numbered once and written; a fetch reads its rows only.
    """

    def __init__(self, df: DataFrame, order: list):
        self.rows = recursion.cut(numbered(df, order), "cursor")
        self.size, self.at = self.rows.count(), 0

    def fetch(self, n: int = 1) -> DataFrame:
        """The next n rows, or for a negative n the rows before, nearest first."""
        if n >= 0:
            low, high = self.at + 1, self.at + n
            self.at = min(high, self.size + 1)
            return self._between(low, high, True)
        low, high = self.at + n, self.at - 1
        self.at = max(low, 0)
        return self._between(low, high, False)

    def absolute(self, n: int) -> DataFrame:
        """The nth row; from the end for a negative n."""
        self.at = min(max(n if n >= 0 else self.size + 1 + n, 0), self.size + 1)
        return self._between(self.at, self.at, True)

    def relative(self, n: int) -> DataFrame:
        return self.absolute(max(self.at + n, 0))

    def move(self, n: int) -> int:
        """How many rows it went by."""
        before = self.at
        self.at = min(max(self.at + n, 0), self.size + 1)
        return abs(min(max(self.at, 1), self.size) - min(max(before, 0), self.size)) if n else 0

    def _between(self, low: int, high: int, up: bool) -> DataFrame:
        order = F.col("__n") if up else F.desc("__n")
        return self.rows.where(F.col("__n").between(low, high)).orderBy(order).drop("__n")


def cursor(df: DataFrame):
    """Rows one partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


#: The signature of binary COPY files.
SIGNATURE = b"PGCOPY\n\xff\r\n\x00"
_EPOCH_DAYS, _EPOCH_MICROS = 10957, 946_684_800_000_000  # 2000-01-01


def _pack(kind: str):
    import struct

    return {
        "boolean": lambda v: struct.pack(">?", v), "smallint": lambda v: struct.pack(">h", v), "int": lambda v: struct.pack(">i", v), "bigint": lambda v: struct.pack(">q", v), "float": lambda v: struct.pack(">f", v), "double": lambda v: struct.pack(">d", v),
        "string": lambda v: v.encode(), "binary": bytes, "date": lambda v: struct.pack(">i", (v.toordinal() - 719163) - _EPOCH_DAYS), "timestamp_ntz": lambda v: struct.pack(">q", _micros(v) - _EPOCH_MICROS),
    }[kind]


def _micros(v) -> int:
    from datetime import datetime, timedelta

    return (v - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def _unpack(kind: str):
    import struct
    from datetime import date, datetime, timedelta

    one = lambda f: lambda b: struct.unpack(f, b)[0]
    return {
        "boolean": one(">?"), "smallint": one(">h"), "int": one(">i"), "bigint": one(">q"), "float": one(">f"), "double": one(">d"), "string": lambda b: b.decode(), "binary": bytes,
        "date": lambda b: date.fromordinal(one(">i")(b) + _EPOCH_DAYS + 719163), "timestamp_ntz": lambda b: datetime(1970, 1, 1) + timedelta(microseconds=one(">q")(b) + _EPOCH_MICROS),
    }[kind]


def copy_to_binary(df: DataFrame, path: str) -> DataFrame:
    """Write a table or query as binary COPY files, one for each partition; returns their manifest (path, n_rows)."""
    import struct
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    packers = [_pack(f.dataType.simpleString()) for f in df.schema.fields]
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)

    def write(batches):
        out, n, name = None, 0, uuid.uuid4().hex
        there, where = fs.FileSystem.from_uri(path)
        for x in batches:
            if out is None:
                out = there.open_output_stream(f"{where}/{name}.bin", compression=None)
                out.write(SIGNATURE + struct.pack(">ii", 0, 0))
            for s in range(0, x.num_rows, 1000):
                rows = []
                for r in zip(*(c.to_pylist() for c in x.slice(s, 1000).columns), strict=True):
                    rows.append(struct.pack(">h", len(packers)))
                    for v, p in zip(r, packers, strict=True):
                        b = None if v is None else p(v)
                        rows.append(struct.pack(">i", -1) if b is None else struct.pack(">i", len(b)) + b)
                out.write(b"".join(rows))
            n += x.num_rows
        if out is not None:
            out.write(struct.pack(">h", -1))
            out.close()
            yield pa.record_batch([pa.array([f"{path}/{name}.bin"]), pa.array([n], pa.int64())], ["path", "n_rows"])

    return recursion.cut(df.mapInArrow(write, "path string, n_rows long"), "copied")


def copy_from_binary(manifest: DataFrame, schema) -> DataFrame:
    """Read binary COPY files; a file without its trailer, or a row with another number of fields, is an error."""
    import struct

    import pyarrow as pa
    from pyarrow import fs
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    readers = [_unpack(f.dataType.simpleString()) for f in schema.fields]
    arrow = to_arrow_schema(schema)

    def read(batches):
        for x in batches:
            for uri in x.column("path").to_pylist():
                there, where = fs.FileSystem.from_uri(uri)
                with there.open_input_stream(where, compression=None) as f:
                    if f.read(11) != SIGNATURE:
                        raise ValueError("COPY file signature not recognized")
                    _, extra = struct.unpack(">ii", f.read(8))
                    f.read(extra)
                    rows = []
                    while (n := struct.unpack(">h", f.read(2))[0]) != -1:
                        if n != len(readers):
                            raise ValueError(f"row field count is {n}, expected {len(readers)}")
                        row = []
                        for g in readers:
                            size = struct.unpack(">i", f.read(4))[0]
                            row.append(None if size < 0 else g(f.read(size)))
                        rows.append(row)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return manifest.repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)
