"""User-defined functions, aggregates and table functions, prepared statements, views and stored results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type


def function(f: Callable, returns: str, strict: bool = True, volatile: bool = False) -> Callable[..., Column]:
    """A scalar function over Arrow batches; strict ones give null for null arguments and aren't called. NaN is a value."""

    def batch(*args: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in args), strict=True)
        return pa.array([None if strict and any(v is None for v in r) else f(*r) for r in rows], arrow)

    arrow = to_arrow_type(T._parse_datatype_string(returns))
    shapes = {1: lambda a: batch(a), 2: lambda a, b: batch(a, b), 3: lambda a, b, c: batch(a, b, c), 4: lambda a, b, c, d: batch(a, b, c, d)}
    n = f.__code__.co_argcount
    g = shapes[n]
    g.__annotations__ = dict.fromkeys("abcd"[:n], pa.Array) | {"return": pa.Array}
    u = F.arrow_udf(g, returns)
    return u.asNondeterministic() if volatile else u


def vectorised(f: Callable, returns: str, arguments: int) -> Callable[..., Column]:
    """A scalar function that takes and gives whole series: the fast form, for functions that numpy can express."""
    shapes = {1: lambda a: f(a), 2: lambda a, b: f(a, b), 3: lambda a, b, c: f(a, b, c)}
    g = shapes[arguments]
    g.__annotations__ = dict.fromkeys("abc"[:arguments], pd.Series) | {"return": pd.Series}
    return F.pandas_udf(g, returns)


def variadic(f: Callable[[list], object], returns: str, strict: bool = False) -> Callable[..., Column]:
    """VARIADIC: any number of arguments of one type reach f as a list."""
    one = function(lambda xs: f(list(xs)), returns, strict)
    return lambda *cols: one(F.array(*cols))


def polymorphic(make: Callable[..., Column]) -> Callable[..., Column]:
    """anyelement and anyarray: a function of columns whose type follows from its arguments', made of column expressions."""
    return make


def sql_function(spark: SparkSession, name: str, params: list[tuple], returns: str, body: str, replace: bool = True) -> None:
    """CREATE FUNCTION in SQL. params: (name, type) or (name, type, default); `returns table(...)` makes a table function.

    The body is inlined into the query, so the optimizer sees through it. Calls may name arguments (f(b => 2)).
    """
    args = ", ".join(f"{p[0]} {p[1]}" + (f" default {p[2]}" if len(p) > 2 else "") for p in params)
    spark.sql(f"create {'or replace ' if replace else ''}temporary function {name}({args}) returns {returns} return {body}")


def do_block(spark: SparkSession, text: str) -> DataFrame:
    """DO: a script of declarations, loops and conditions; the result of its last query."""
    return spark.sql(f"begin {text} end")


def window_function(f: Callable[[pd.Series], object], returns: str):
    """A user's window function: f sees the frame's values in its order. Use it with .over()."""

    def g(v: pd.Series):
        return f(v)

    kind = {"double": float, "bigint": int, "long": int, "int": int, "string": str}[returns]
    g.__annotations__ = {"v": pd.Series, "return": kind}
    return F.pandas_udf(g, returns)


class Operators:
    """CREATE OPERATOR and CREATE CAST: functions of columns under an operator's name, or from one type to another."""

    def __init__(self):
        self.known: dict[str, Callable] = {}
        self.casts: dict[tuple[str, str], Callable] = {}

    def define(self, name: str, f: Callable[[Column, Column], Column], commutator: str | None = None, negator: str | None = None) -> None:
        self.known[name] = f
        if commutator:
            self.known[commutator] = lambda a, b: f(b, a)
        if negator:
            self.known[negator] = lambda a, b: ~f(a, b)

    def apply(self, a: Column, name: str, b: Column) -> Column:
        return self.known[name](a, b)

    def cast(self, x: Column, source: str, target: str) -> Column:
        return self.casts[source, target](x) if (source, target) in self.casts else x.cast(target)


class Statements:
    """Counts of what was run: calls, time and rows of each query text, as a table."""

    def __init__(self):
        self.seen: dict[str, list] = {}

    def run(self, name: str, df: DataFrame) -> list:
        import time

        began = time.perf_counter()
        rows = df.collect()
        s = self.seen.setdefault(name, [0, 0.0, 0])
        s[0], s[1], s[2] = s[0] + 1, s[1] + (time.perf_counter() - began) * 1000, s[2] + len(rows)
        return rows

    def reset(self) -> None:
        self.seen.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *v) for k, v in self.seen.items()], "query string, calls long, total_time double, rows long")


def aggregate(f: Callable[[pd.Series], object], returns: str):
    """An aggregate over all values of a group, which must fit a task."""
    return window_function(f, returns)


def table_function(f: Callable, returns: str):
    """A set-returning function: f yields tuples."""

    class Rows:
        def eval(self, *args):
            yield from f(*args)

    return F.udtf(Rows, returnType=returns)


class Prepared:
    """PREPARE name AS text with :named parameters; execute() binds values, never text."""

    def __init__(self, spark: SparkSession, text: str, **tables: DataFrame):
        self.spark, self.text, self.tables = spark, text, tables

    def execute(self, **params) -> DataFrame:
        return self.spark.sql(self.text, args=params, **self.tables)


class MaterializedView:
    """A stored result with REFRESH: each version is a folder, readers see the last complete one."""

    def __init__(self, spark: SparkSession, path: str, define: Callable[[], DataFrame]):
        self.spark, self.path, self.define, self.version = spark, path, define, 0

    def refresh(self) -> None:
        self.define().write.parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1

    def read(self) -> DataFrame:
        if not self.version:
            raise RuntimeError("the view has not been populated")
        return self.spark.read.parquet(f"{self.path}/v{self.version}")
