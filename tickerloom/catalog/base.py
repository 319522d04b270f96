"""Shared pieces of the query catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import rnd

Query = Callable[[SparkSession, str], DataFrame]


def publish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result columns in plain types: dates as text, doubles rounded, lists joined."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = rnd(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, "; ")
        out.append(c.alias(field.name))
    return df.select(*out)


class Catalogue:
    """Named queries with the SQL that must give the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = lambda spark, sf_dir: publish(fn(spark, sf_dir), digits)
            self.queries[name].__doc__ = fn.__doc__
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register
