"""Small scalar rules: labels, bands, gates and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agorascope.params import P
from agorascope.schemas import ARTICLE_KINDS


def lookup(values, index: Column) -> Column:
    """``values[index]`` of a short fixed list, 0-based."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def category(kind: Column) -> Column:
    return F.when(kind.isin(*ARTICLE_KINDS), "article").otherwise("discourse")


def sentiment_label(score: Column, cut: float = P.sentiment_cut) -> Column:
    return F.when(score > cut, "positive").when(score < -cut, "negative").when(score.isNotNull(), "neutral")


def severity_confidence(severity: Column) -> Column:
    """Fixed mapping: low 0.4, medium 0.7, high 0.9."""
    return F.when(severity == "low", 0.4).when(severity == "medium", 0.7).when(severity == "high", 0.9)


def severity_band(score: Column, medium: float = P.severity_medium, high: float = P.severity_high) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score.isNotNull(), "low")


def age_hours(then: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(then)) / F.lit(3_600_000_000.0)


def reading_seconds(words: Column, per_minute: int = P.words_per_minute) -> Column:
    return F.round(words / F.lit(float(per_minute)) * 60).cast("long")


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def length_status(size: Column, low: int, high: int) -> Column:
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "missing")
        .when(size < low, "too_short")
        .when(size > high, "too_long")
        .otherwise("ok")
    )


def set_count(*columns: Column) -> Column:
    """How many of the columns are not NULL."""
    total = F.lit(0)
    for c in columns:
        total = total + c.isNotNull().cast("int")
    return total
