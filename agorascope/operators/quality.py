"""Data-quality rules as one table of violations (rule, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.functions.rules import set_count
from agorascope.schemas import UNIQUE_KEYS


def breaking(frame: DataFrame, rule: str, key: Column, broken: Column) -> DataFrame:
    """Rows that break a row rule; an undecided (NULL) condition is not a violation."""
    return frame.filter(F.coalesce(broken, F.lit(False))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def outside(column: str, allowed: tuple[str, ...]) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def duplicates(frame: DataFrame, rule: str, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys held by more than one row, counted with a partial aggregate."""
    rows = frame if where is None else frame.filter(where)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        F.lit(rule).alias("rule"),
        F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]).alias("key"),
    )


def unique_keys(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """The declared unique key of each given table, as rules ``<table>_key``."""
    return [duplicates(frame, f"{name}_key", list(UNIQUE_KEYS[name])) for name, frame in tables.items()]


def orphans(child: DataFrame, rule: str, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Values of a reference column without a parent row."""
    ids = parent.select(F.col(parent_key).alias(column))
    return child.filter(F.col(column).isNotNull()).join(ids, column, "left_anti").select(
        F.lit(rule).alias("rule"), F.col(column).cast("string").alias("key")
    )


def one_target(evidence: DataFrame, rule: str = "evidence_one_target") -> DataFrame:
    """Evidence rows whose number of targets is not one."""
    n = set_count(*[F.col(c) for c in ("record_id", "entity_id", "target_topic_id", "story_id")])
    return breaking(evidence, rule, F.col("signal_id"), n != 1)


def citation_target(citations: DataFrame, rule: str = "citation_record_xor_url") -> DataFrame:
    """Internal citations point to a record, external ones to a URL, none to both."""
    internal = F.col("citation_type") == "internal"
    good = F.when(internal, F.col("record_id").isNotNull() & F.col("external_url").isNull()).otherwise(
        F.col("external_url").isNotNull() & F.col("record_id").isNull()
    )
    return breaking(citations, rule, F.concat_ws("/", "story_id", "marker"), ~good)


def violations(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
