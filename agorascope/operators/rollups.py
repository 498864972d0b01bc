"""Daily and rolling rollups, mixes, distributions, rankings by growth, usage and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorascope.functions.text import slug
from agorascope.params import P
from agorascope.schemas import TIER_DDL, TIERS

N = F.count


def n_rows() -> Column:
    return F.count(F.lit(1))


def day(column: str = "captured_at") -> Column:
    return F.to_date(column)


def since(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(days=F.lit(days))


def hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.make_dt_interval(hours=F.lit(hours))


def zero_filled(keys: DataFrame, first_day: Column, last_day: Column, name: str = "day") -> DataFrame:
    """Every key with every day of a period; keys come in, days are generated per row."""
    return keys.withColumn(name, F.explode(F.sequence(first_day, last_day)))


# ---- rollup tables --------------------------------------------------------------------------
def sentiment_daily(records: DataFrame) -> DataFrame:
    """Mean score per (day, kind) over scored rows, six decimals."""
    return records.filter(F.col("sentiment_score").isNotNull()).groupBy(day().alias("bucket_date"), "kind").agg(
        F.round(F.avg("sentiment_score"), 6).alias("avg_score"), n_rows().alias("record_count")
    )


def source_daily(records: DataFrame) -> DataFrame:
    return records.groupBy(day().alias("bucket_date"), "kind").agg(n_rows().alias("record_count"))


def recent_counts(records: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Total, last 24 hours and last 7 days per key, in one pass."""
    t = F.col("captured_at")
    return records.groupBy(*keys).agg(
        n_rows().alias("total_records"), F.count_if(t > hours_before(as_of, 24)).alias("last24h_records"),
        F.count_if(t > since(as_of, 7)).alias("last7d_records"),
    )


def topic_record_counts(assignments: DataFrame, records: DataFrame, stories: DataFrame) -> DataFrame:
    """Distinct records, active stories and newest record of each topic."""
    rows = assignments.join(records.select(F.col("id").alias("record_id"), "captured_at"), "record_id")
    counts = rows.groupBy("topic_id").agg(
        F.countDistinct("record_id").alias("record_count"), F.max("captured_at").alias("last_record_at")
    )
    live = stories.filter("active").groupBy("topic_id").agg(n_rows().alias("active_story_count"))
    return counts.join(live, "topic_id", "left").withColumn(
        "active_story_count", F.coalesce("active_story_count", F.lit(0))
    )


def entity_mention_daily(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(day().alias("bucket_date"), "entity_id").agg(n_rows().alias("mention_count"))


def entity_source_counts(mentions: DataFrame, records: DataFrame) -> DataFrame:
    kinds = records.select(F.col("id").alias("record_id"), "kind")
    return mentions.select("entity_id", "record_id").distinct().join(kinds, "record_id").groupBy(
        "entity_id", "kind"
    ).agg(n_rows().alias("record_count"))


def entity_stats(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with mention count and first and last sighting."""
    seen = mentions.groupBy(F.col("entity_id").alias("id")).agg(
        n_rows().alias("mention_count"), F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen")
    )
    return entities.join(seen, "id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))


# ---- per topic ------------------------------------------------------------------------------
def label_counts(with_unknown: bool = False) -> list[Column]:
    label = F.col("sentiment_label")
    counts = [F.count_if(label == v).alias(v) for v in ("positive", "neutral", "negative")]
    return [*counts, F.count_if(label.isNull()).alias("unknown")] if with_unknown else counts


def topic_sentiment(assignments: DataFrame, records: DataFrame, as_of: Column, window_days: int) -> DataFrame:
    """Labels per (topic, kind) in the window; each record counts once per topic."""
    recent = records.filter(F.col("captured_at") > since(as_of, window_days)).select(
        F.col("id").alias("record_id"), "kind", "sentiment_label"
    )
    pairs = assignments.select("topic_id", "record_id").distinct()
    return pairs.join(recent, "record_id").groupBy("topic_id", "kind").agg(*label_counts(), n_rows().alias("total"))


def topic_entities(assignments: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions of each entity inside each topic.

    Mentions are first counted per (record, entity), so repeats never enter the join.
    """
    per_record = mentions.groupBy("record_id", "entity_id").agg(n_rows().alias("_n"))
    pairs = assignments.select("topic_id", "record_id").distinct()
    counts = pairs.join(per_record, "record_id").groupBy("topic_id", "entity_id").agg(F.sum("_n").alias("mention_count"))
    return counts.join(entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id")


def topic_distribution(assignments: DataFrame, topics: DataFrame) -> DataFrame:
    """Distinct records per topic and the topic's share of the sum over topics."""
    counts = assignments.groupBy("topic_id").agg(F.countDistinct("record_id").alias("record_count"))
    total = counts.agg(F.sum("record_count")).scalar()
    names = topics.select(F.col("id").alias("topic_id"), F.col("display_name").alias("topic_name"))
    return counts.withColumn("share", F.col("record_count") / total).join(names, "topic_id")


# ---- per entity -----------------------------------------------------------------------------
def mentioned(mentions: DataFrame) -> DataFrame:
    """Distinct (entity, record) pairs."""
    return mentions.select("entity_id", "record_id").distinct()


def entity_topic_mix(mentions: DataFrame, assignments: DataFrame) -> DataFrame:
    pairs = assignments.select("topic_id", "record_id").distinct()
    return mentioned(mentions).join(pairs, "record_id").groupBy("entity_id", "topic_id").agg(
        n_rows().alias("record_count")
    )


def entity_source_mix(source_counts: DataFrame) -> DataFrame:
    """Kinds of each entity as one list, most records first (at most one entry per kind)."""
    entry = F.struct((-F.col("record_count")).alias("o"), "kind", "record_count")
    return source_counts.groupBy("entity_id").agg(F.sort_array(F.collect_list(entry)).alias("m")).select(
        "entity_id", F.transform("m", lambda x: F.concat(x["kind"], F.lit(":"), x["record_count"].cast("string")))
        .alias("source_mix"),
    )


def entity_sentiment(mentions: DataFrame, records: DataFrame) -> DataFrame:
    labels = records.select(F.col("id").alias("record_id"), "sentiment_label")
    return mentioned(mentions).join(labels, "record_id").groupBy("entity_id").agg(*label_counts(True))


def entity_sentiment_trend(mentions: DataFrame, records: DataFrame) -> DataFrame:
    """Mean score per week (NULL when no record was scored) and number of records."""
    rows = records.select(F.col("id").alias("record_id"), "captured_at", "sentiment_score")
    week = F.to_date(F.date_trunc("week", "captured_at"))
    return mentioned(mentions).join(rows, "record_id").groupBy("entity_id", week.alias("week_start")).agg(
        F.round(F.avg("sentiment_score"), 6).alias("avg_score"), n_rows().alias("sample_size")
    )


def source_diversity(counts: DataFrame, key: str = "entity_id") -> DataFrame:
    """Number of kinds and Herfindahl index (0 to 10000) from (key, kind, record_count)."""
    n = F.col("record_count").cast("double")
    sums = counts.groupBy(key).agg(
        n_rows().alias("distinct_sources"), F.sum(n * n).alias("_sq"), F.sum(n).alias("_n")
    )
    index = F.col("_sq") / (F.col("_n") * F.col("_n")) * 10_000
    return sums.select(key, "distinct_sources", F.round(index, 4).alias("herfindahl_index"))


def related_entities(mentions: DataFrame, entity_id: int) -> DataFrame:
    """Entities sharing records with one entity, and the number of shared records.

    Only the focal entity's records are matched: the work is linear in mentions, no pairs
    of a record's entities are formed.
    """
    pairs = mentioned(mentions)
    focal = pairs.filter(F.col("entity_id") == entity_id).select("record_id")
    return pairs.filter(F.col("entity_id") != entity_id).join(focal, "record_id", "left_semi").groupBy("entity_id").agg(
        n_rows().alias("shared_record_count")
    )


def growth(mentions: DataFrame, as_of: Column, recent_days: int = P.trend_recent_days,
           baseline_days: int = P.trend_baseline_days, epsilon: float = P.trend_epsilon,
           key: str = "entity_id") -> DataFrame:
    """Recent and baseline counts per key, and the ratio of their daily rates."""
    t = F.col("captured_at")
    split, start = since(as_of, recent_days), since(as_of, recent_days + baseline_days)
    counts = mentions.filter((t > start) & (t <= as_of)).groupBy(key).agg(
        F.count_if(t > split).alias("recent_mentions"), F.count_if(t <= split).alias("baseline_mentions")
    )
    rate = (F.col("recent_mentions") / float(recent_days)) / F.greatest(
        F.col("baseline_mentions") / float(baseline_days), F.lit(epsilon)
    )
    return counts.withColumn("growth_factor", F.round(rate, 6))


def trending_entities(mentions: DataFrame, entities: DataFrame, as_of: Column, top: int = 20, **windows) -> DataFrame:
    best = growth(mentions, as_of, **windows).orderBy(F.desc("growth_factor"), "entity_id").limit(top)
    names = entities.select(F.col("id").alias("entity_id"), "name", "type", slug(F.col("name")).alias("slug"))
    return best.join(names, "entity_id")


def prominence_rank(stats: DataFrame, min_peers: int = P.prominence_min_peers) -> DataFrame:
    """Percentile (0 to 100) of each entity's mentions among its type; NULL below ``min_peers``.

    The percentile depends on the count alone, so a histogram of counts per type is ranked
    (distinct counts, not entities) and looked up.
    """
    histogram = stats.groupBy("type", "mention_count").agg(n_rows().alias("_n"))
    below = W.partitionBy("type").orderBy("mention_count").rowsBetween(W.unboundedPreceding, -1)
    peers = histogram.groupBy("type").agg(F.sum("_n").alias("sample_size"))
    ranked = histogram.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).join(peers, "type")
    share = F.col("_below") / (F.col("sample_size") - 1) * 100
    ranked = ranked.withColumn(
        "within_type", F.when(F.col("sample_size") >= min_peers, F.round(share, 4))
    ).select("type", "mention_count", "within_type", "sample_size")
    return stats.join(ranked, ["type", "mention_count"])


# ---- timelines ------------------------------------------------------------------------------
def stats_timeline(spark: SparkSession, records: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Records per day of a period, zero days included."""
    days = spark.sql("SELECT 1 AS one").select(
        F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("date")
    )
    counts = records.groupBy(day().alias("date")).agg(n_rows().alias("count"))
    return days.join(counts, "date", "left").select("date", F.coalesce("count", F.lit(0)).alias("count"))


def mention_timeline(daily: DataFrame, keys: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Mentions per entity and day, zero days included, from the daily rollup."""
    grid = zero_filled(
        keys.select("entity_id"), F.lit(first_day).cast("date"), F.lit(last_day).cast("date"), "bucket_date"
    )
    return grid.join(daily, ["entity_id", "bucket_date"], "left").select(
        "entity_id", F.col("bucket_date").alias("date"), F.coalesce("mention_count", F.lit(0)).alias("count")
    )


def rolling_baseline(daily: DataFrame, key: str, first_day: str, last_day: str, days: int = P.baseline_days) -> DataFrame:
    """Each (key, day, n) with mean and deviation of the ``days`` days before it, zero days included.

    The window runs over one row per day; the facts were counted before.
    """
    grid = zero_filled(daily.select(key).distinct(), F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    full = grid.join(daily, [key, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.partitionBy(key).orderBy("day").rowsBetween(-days, -1)
    return full.select(
        key, "day", "n", F.avg("n").over(w).alias("baseline"), F.stddev_pop("n").over(w).alias("deviation"),
        n_rows().over(w).alias("baseline_n"),
    )


def daily_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, day().alias("day")).agg(n_rows().alias("n"))


def corpus_cube(records: DataFrame) -> DataFrame:
    """All daily rollups in one scan: (day), (day, kind), (kind) and the grand total."""
    view = records.select(day().alias("day"), "kind", "sentiment_score")
    return view.groupingSets([["day"], ["day", "kind"], ["kind"], []], "day", "kind").agg(
        F.grouping_id().alias("level"), n_rows().alias("n"), F.round(F.avg("sentiment_score"), 6).alias("avg_score")
    )


# ---- service logs ---------------------------------------------------------------------------
def tier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(t) for t in TIERS], TIER_DDL)


def quota_usage(usage: DataFrame, tiers: DataFrame, warn_share: float = P.soft_quota_share) -> DataFrame:
    """Calls per key and day against its tier: busiest minute, and state of the daily quota.

    Minutes are counted first and summed into days, so a busy key shuffles one row per minute.
    """
    minutes = usage.groupBy("key_id", "tier", "seats", F.date_trunc("minute", "called_at").alias("minute")).agg(
        n_rows().alias("_n")
    )
    days = minutes.groupBy("key_id", "tier", "seats", F.to_date("minute").alias("day")).agg(
        F.sum("_n").alias("calls"), F.max("_n").alias("peak_minute")
    )
    limits = days.join(F.broadcast(tiers), "tier", "left")  # the fixed six-row tier table
    day_limit, minute_limit = F.col("per_day") * F.col("seats"), F.col("per_minute") * F.col("seats")
    used = F.col("calls")
    state = (
        F.when(day_limit.isNull(), "unlimited")
        .when(F.col("hard_day") & (used > day_limit), "blocked")
        .when(~F.col("hard_day") & (used >= day_limit * warn_share), "warned")
        .otherwise("ok")
    )
    return limits.select(
        "key_id", "tier", "day", "calls", "peak_minute", day_limit.alias("day_limit"), state.alias("day_state"),
        F.coalesce(F.col("peak_minute") > minute_limit, F.lit(False)).alias("minute_blocked"),
    )


def webhook_health(deliveries: DataFrame) -> DataFrame:
    failed = F.col("status_code") >= 400
    return deliveries.groupBy("endpoint_id").agg(
        n_rows().alias("attempts"), F.count_if(failed).alias("failure_count"),
        F.max(F.when(~failed, F.col("attempted_at"))).alias("last_success_at"),
        F.max(F.when(failed, F.col("attempted_at"))).alias("last_failure_at"),
    )


def history_retention(usage: DataFrame, tiers: DataFrame, as_of: Column) -> DataFrame:
    """Rows a tier's history limit lets stay."""
    days = F.col("history_days")
    kept = usage.join(F.broadcast(tiers.select("tier", "history_days")), "tier")  # six fixed rows
    return kept.filter(days.isNull() | (F.col("called_at") >= as_of - F.make_dt_interval(days=days)))


def generation_audit(stories: DataFrame) -> DataFrame:
    return stories.groupBy("generation_model", "enrichment_version").agg(
        n_rows().alias("stories"), F.count_if("active").alias("active_stories")
    )
