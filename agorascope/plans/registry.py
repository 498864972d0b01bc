"""Registry of named queries and of the SQL statement each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorascope.plans.bindings import with_frames
from agorascope.sources.fixtures import Corpus

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def present(frame: DataFrame) -> DataFrame:
    """Plain output types: dates and times as text, decimals as double, arrays joined by commas."""
    columns = []
    for field in frame.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        columns.append(c.alias(field.name))
    return frame.select(columns)


def query(key: str, sql: str | None = None):
    """Register ``fn(corpus) -> DataFrame`` under ``key``; ``sql`` may name the frames of ``bindings``."""

    def register(fn: Callable[[Corpus], DataFrame]):
        if key in _QUERIES:
            raise ValueError(f"query {key} registered twice")
        _QUERIES[key] = lambda spark, folder: present(fn(Corpus(spark, folder)))
        if sql is not None:
            _ORACLES[key] = with_frames(sql)
        return fn

    return register


def load() -> tuple[dict, dict]:
    """All queries and oracles, after importing the modules that register them."""
    import importlib

    for module in (
        "ingest_queries", "read_queries", "join_queries", "rollup_queries", "story_queries", "search_queries",
        "signal_queries", "stream_queries",
    ):
        importlib.import_module(f"agorascope.plans.{module}")
    return dict(_QUERIES), dict(_ORACLES)
