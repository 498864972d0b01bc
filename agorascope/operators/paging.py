"""Keyset and offset pages. A page is at most ``page_max`` rows, cut by a distributed top-k."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorascope.operators.positions import id_positions
from agorascope.params import P


def parse_limit(raw: str | None, default: int = P.page_default, most: int = P.page_max) -> int:
    """Absent, non-numeric, infinite or non-positive: the default. Else floored and bounded.

    A fraction below one gives one row, not an empty page.
    """
    if not raw:
        return default
    try:
        n = float(raw)
    except ValueError:
        return default
    if not math.isfinite(n) or n <= 0:
        return default
    return max(1, min(math.floor(n), most))


def parse_id_cursor(raw: str | None) -> int | None:
    """An integer, or None for anything else."""
    try:
        return int(raw) if raw else None
    except ValueError:
        return None


def parse_time_cursor(raw: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(raw.replace("Z", "+00:00")) if raw else None
    except ValueError:
        return None


def after(keys: list[str], cursor: list) -> Column:
    """Rows that come after ``cursor`` when all keys descend."""
    condition = F.lit(False)
    tie = F.lit(True)
    for name, value in zip(keys, cursor):
        v = value if isinstance(value, Column) else F.lit(value)
        condition = condition | (tie & (F.col(name) < v))
        tie = tie & (F.col(name) == v)
    return condition


def page(frame: DataFrame, keys: list[str], limit: int, cursor: list | None = None) -> DataFrame:
    """One page, newest first, with ``next_cursor`` (the last row's keys) or NULL at the end.

    ``limit + 1`` rows are taken to see whether more follow; the numbering runs over those
    few rows only.
    """
    rows = frame if cursor is None else frame.filter(after(keys, cursor))
    order = [F.col(k).desc() for k in keys]
    top = rows.orderBy(*order).limit(limit + 1)
    numbered = top.withColumn("page_row", F.row_number().over(W.orderBy(*order)))
    more = F.max("page_row").over(W.partitionBy(F.lit(0))) > limit
    last = F.max(
        F.when(F.col("page_row") == limit, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    ).over(W.partitionBy(F.lit(0)))
    return numbered.withColumn("next_cursor", F.when(more, last)).filter(F.col("page_row") <= limit)


def offset_page(frame: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by a unique numeric key, with the total and next offset.

    Works at any depth: positions come from bucket counts, nothing is gathered to skip rows.
    """
    total = frame.agg(F.count(F.lit(1))).scalar()
    rows = id_positions(frame, key).filter((F.col("position") >= offset) & (F.col("position") < offset + limit))
    return rows.withColumn("total", total).withColumn(
        "next_offset", F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit))
    )


def sitemap_pages(frame: DataFrame, key: str, modified: str, page_size: int = P.sitemap_page_size) -> DataFrame:
    """Row count and newest change of each sitemap page."""
    return (
        id_positions(frame, key)
        .groupBy(F.floor(F.col("position") / page_size).alias("page"))
        .agg(F.count(F.lit(1)).alias("count"), F.max(modified).alias("lastmod"))
        .withColumn("offset", F.col("page") * page_size)
    )


def top_per_group(frame: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; map tasks already drop the rest."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return frame.withColumn("rank", rank).filter(F.col("rank") <= n)
