"""Exact row positions over any number of rows, with no task seeing more than one bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucketed_positions(
    frame: DataFrame, by: list[str], bucket: Column, order: list[Column], name: str = "position"
) -> DataFrame:
    """0-based position within ``by`` in ``order``; ``bucket`` must rise with ``order``.

    Buckets are counted first (pre-aggregated before the shuffle), their running total gives
    each bucket its start, and only rows inside one (by, bucket) are sorted together. A hot
    ``by`` value therefore spreads over its buckets.
    """
    marked = frame.withColumn("_bucket", bucket)
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        marked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    renamed = starts.withColumnsRenamed({c: f"_k_{c}" for c in [*by, "_bucket"]})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_bucket"]]
    joined = marked.join(renamed, same).drop(*[f"_k_{c}" for c in [*by, "_bucket"]])
    inside = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order))
    return joined.withColumn(name, (F.col("_start") + inside - 1).cast("long")).drop("_bucket", "_start")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``big`` joined to ``small`` on ``keys``, each key's rows dealt over ``salts`` tasks by a hash of ``spread``.

    Each row of ``small`` is repeated ``salts`` times, so ``small`` should be pre-aggregated; it may be of any size.
    A later grouping by ``keys`` gets a shuffle of its own, with sums made before it.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def id_positions(frame: DataFrame, key: str, width: int = 65_536, name: str = "position") -> DataFrame:
    """0-based position of each row by a unique numeric ``key``.

    Two levels of buckets, so that even the running total over buckets is split: ``width``
    keys per bucket and ``width`` buckets per block.
    """
    k = F.col(key)
    marked = frame.withColumn("_b", F.floor(k / width)).withColumn("_block", F.floor(k / width / width))
    counts = marked.groupBy("_block", "_b").agg(F.count(F.lit(1)).alias("_n"))
    inner = W.partitionBy("_block").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    outer = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row per width * width keys
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_m")).select(
        "_block", F.coalesce(F.sum("_m").over(outer), F.lit(0)).alias("_base")
    )
    starts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(blocks, "_block").select(
        "_b", (F.col("_base") + F.col("_in")).alias("_start")
    )
    inside = F.row_number().over(W.partitionBy("_b").orderBy(k))
    return (
        marked.join(starts, "_b")
        .withColumn(name, (F.col("_start") + inside - 1).cast("long"))
        .drop("_b", "_block", "_start")
    )
