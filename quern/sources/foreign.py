"""Foreign tables: wrappers over Spark's Python data source API, files in COPY form, and other servers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.sources import copy


class Wrapper:
    """What a foreign-data wrapper gives: columns, how the table splits, and the rows of a split."""

    def schema(self, options: dict) -> str:
        raise NotImplementedError

    def splits(self, options: dict) -> list:
        """One value for each task."""
        return [None]

    def rows(self, options: dict, split) -> Iterator[tuple]:
        raise NotImplementedError


def register(spark: SparkSession, name: str, wrapper: Wrapper) -> None:
    """CREATE FOREIGN DATA WRAPPER: spark.read.format(name) reads through it from then on."""

    class Part(InputPartition):
        def __init__(self, split):
            self.split = split

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [Part(s) for s in wrapper.splits(self.options)]

        def read(self, partition):
            yield from wrapper.rows(self.options, partition.split)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return wrapper.schema(dict(self.options))

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(Source)


class Server:
    """CREATE SERVER: a wrapper's name with options; table() is CREATE FOREIGN TABLE, import_schema() makes several."""

    def __init__(self, spark: SparkSession, wrapper: str, **options: str):
        self.spark, self.wrapper, self.options = spark, wrapper, options

    def table(self, schema=None, **options) -> DataFrame:
        options = self.options | options
        if self.wrapper == "file":
            csv = options.get("format", "text") == "csv"
            return copy.copy_from(self.spark, options["filename"], schema, csv=csv, delimiter=options.get("delimiter"), null=options.get("null"), header=options.get("header", "false") == "true")
        if self.wrapper == "jdbc":
            return self.spark.read.format("jdbc").options(**options).load()
        r = self.spark.read.format(self.wrapper).options(**options)
        return (r.schema(schema) if schema else r).load()
