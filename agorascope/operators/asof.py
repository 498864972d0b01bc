"""As-of join: the latest earlier row of the other side, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_before(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tie: str,
    bucket: str = "hour", within: Column | None = None,
) -> DataFrame:
    """Each left row with ``match``: the last right row strictly before it (``tie`` breaks equal times).

    Time is cut into buckets. Rows are merged and scanned inside one (key, bucket) only; what
    earlier buckets hand over is one pre-aggregated row per bucket, so a key holding most of
    the rows is spread over its buckets. ``within`` (a day-time interval) voids older matches.
    """
    payload = F.struct(F.col(right_time).alias("at"), F.col(tie).alias("tie"), F.struct(*right.columns).alias("row"))
    keys = [f"_by{i}" for i in range(len(by))]
    own = F.struct(*left.columns)
    a = left.select(
        *[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(left_time).alias("_t"), F.lit(0).alias("_side"),
        own.alias("_left"),
    )
    b = right.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(right_time).alias("_t"), F.lit(1).alias("_side"),
        payload.alias("_right"),
    )
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, "_t"))

    ordered = W.partitionBy(*keys, "_bucket").orderBy("_t", "_side", F.col("_right.tie"))
    near = both.withColumn("_near", F.last("_right", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, 0)))

    ends = both.groupBy(*keys, "_bucket").agg(F.max(F.struct("_right.at", "_right.tie")).alias("_m"),
                                              F.max_by("_right", F.struct("_right.at", "_right.tie")).alias("_end"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_end", F.when(F.col("_m.at").isNotNull(), F.col("_end"))).select(
        *keys, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carry")
    )
    found = near.filter("_side = 0").join(carried, [*keys, "_bucket"], "left").withColumn(
        "_hit", F.coalesce("_near", "_carry")
    )
    if within is not None:
        found = found.withColumn("_hit", F.when(F.col("_hit.at") >= F.col("_t") - within, F.col("_hit")))
    return found.select("_left.*", F.col("_hit.row").alias("match"))
