"""Query registry: a name, a function of (spark, directory), and the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet tables of one directory, read on first use, and what ``shared`` steps made of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.made: dict = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def shared(make: Callable):
    """A step ``make(tables)`` that is planned once a query, so what it writes is written once however many steps read it."""

    @wraps(make)
    def get(t: Tables):
        if make not in t.made:
            t.made[make] = make(t)
        return t.made[make]

    return get


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with its SQL when it has one."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Double columns rounded, so that the order of a distributed sum does not show."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    chosen = [c for c in names if columns is None or c in columns]
    return df.select(*[F.round(c, digits).alias(c) if c in chosen else F.col(c) for c in df.columns])


def whole(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as bigint."""
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df
