"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram then answer totals, quantiles and
truncated totals for every context limit, without going back to the documents. The histogram has one row per
distinct length, so it grows with the longest text and not with the number of documents.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agorascope.llm.bpe import codec
from agorascope.llm.common import in_batches, stable

WIDTH = 1024  # lengths summed within one group; the groups' totals are summed after that


def _count(lines: bytes, pattern: str):
    coder = codec(lines, pattern)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([coder.count(t or "") for t in batch.column(0).to_pylist()], pa.int64())], ["n_tokens"]
        )

    return step


def lengths(docs: DataFrame, vocab: tuple[bytes, str]) -> DataFrame:
    """(n_tokens) per row of ``docs``; a null or empty text has none."""
    return docs.select(F.col("text").cast("string")).mapInArrow(
        in_batches(functools.partial(_count, *vocab)), "n_tokens long"
    )


def histogram(counted: DataFrame) -> DataFrame:
    """Per distinct n_tokens, rising: what a context limit of that length would give.

    n_docs have this length; docs_at_least and tokens_at_least are suffix sums over this and longer lengths;
    truncated_total is the sum of min(length, n_tokens) over all documents; total_docs and total_tokens are
    of the whole table. An empty table has no rows.
    """
    sizes = stable(counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))  # texts are encoded once
    sizes = sizes.withColumn("_g", F.floor(F.col("n_tokens") / WIDTH)).withColumn("_t", F.col("n_docs") * F.col("n_tokens"))
    groups = sizes.groupBy("_g").agg(F.sum("n_docs").alias("_gd"), F.sum("_t").alias("_gt"))
    later = Window.orderBy(F.col("_g").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per WIDTH lengths
    every = Window.orderBy(F.col("_g").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = groups.select(
        "_g", F.coalesce(F.sum("_gd").over(later), F.lit(0)).alias("_ld"), F.coalesce(F.sum("_gt").over(later), F.lit(0)).alias("_lt"),
        F.sum("_gd").over(every).alias("total_docs"), F.sum("_gt").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("_g").orderBy(F.col("n_tokens").desc())
    n, at_least = F.col("n_tokens"), F.col("docs_at_least")
    return (
        sizes.join(above, "_g")
        .withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("_ld"))
        .withColumn("tokens_at_least", F.sum("_t").over(inside) + F.col("_lt"))
        .select(
            "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
            (F.col("total_tokens") - F.col("tokens_at_least") + n * at_least).alias("truncated_total"),
            "total_docs", "total_tokens",
        )
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total) for any limits: the suffix sums at the next longer length answer each."""
    n = F.col("n_tokens")
    at = [F.min(F.when(n >= x, F.struct(n, "docs_at_least", "tokens_at_least"))).alias(f"m{i}") for i, x in enumerate(limits)]
    answers = [
        F.struct(
            F.lit(x).cast("long").alias("context_limit"),
            (
                F.coalesce(F.col("total"), F.lit(0)) - F.coalesce(F.col(f"m{i}.tokens_at_least"), F.lit(0))
                + F.coalesce(F.col(f"m{i}.docs_at_least"), F.lit(0)) * x
            ).alias("truncated_total"),
        )
        for i, x in enumerate(limits)
    ]
    return hist.agg(F.max("total_tokens").alias("total"), *at).select(F.inline(F.array(*answers)))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed; null if none."""
    up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    at = [F.min(F.when(up_to >= F.lit(float(x)) * F.col("total_docs"), F.col("n_tokens"))).alias(f"m{i}") for i, x in enumerate(shares)]
    answers = [F.struct(F.lit(float(x)).alias("share"), F.col(f"m{i}").alias("n_tokens")) for i, x in enumerate(shares)]
    return hist.agg(*at).select(F.inline(F.array(*answers)))
