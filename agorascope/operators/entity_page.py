"""Everything an entity page shows, in one row.

Each part filters to the one entity first and returns a single value (counts, or a list cut by a
distributed top-k), read as a scalar subquery; the parts run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.functions.text import slug
from agorascope.operators import rollups, signals as signal_ops, stories as story_ops
from agorascope.schemas import SOURCE_KINDS


def listed(rows: DataFrame, order: list[Column], value: Column, n: int) -> Column:
    """The first ``n`` values in ``order`` as one array."""
    top = rows.select(value.alias("_v"), F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)]).alias("_o")).orderBy("_o").limit(n)
    packed = F.sort_array(F.collect_list(F.struct("_o", "_v")))
    return top.agg(F.transform(packed, lambda x: x["_v"]).alias("v")).scalar()


def field(row: DataFrame, name: str) -> Column:
    return row.select(name).scalar()


def labelled(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def entity_detail(
    entity_id: int, *, entities: DataFrame, mentions: DataFrame, records: DataFrame, assignments: DataFrame, stories: DataFrame,
    signals: DataFrame, evidence: DataFrame, references: DataFrame, membership: DataFrame, as_of: Column, n: int = 5,
    weeks: int = 52, days: int = 30,
) -> DataFrame:
    c = F.col
    own = mentions.filter(c("entity_id") == entity_id)
    own_records = own.select("record_id").distinct()
    rows = records.join(own_records.withColumnRenamed("record_id", "id"), "id", "left_semi")

    stats = rollups.entity_stats(entities, mentions)
    rank = rollups.prominence_rank(stats.select("id", "type", "mention_count")).filter(c("id") == entity_id)
    rate = rollups.growth(own, as_of)
    mix = rollups.entity_source_counts(own, records)
    diversity = rollups.source_diversity(mix)
    mood = rollups.entity_sentiment(own, records)
    trend = rollups.entity_sentiment_trend(own, records)
    topics = rollups.entity_topic_mix(own, assignments)
    related = rollups.related_entities(mentions, entity_id)
    timeline = rollups.entity_mention_daily(own)
    linked = story_ops.source_pairs(stories.filter("active")).join(own_records, "record_id", "left_semi").select(
        c("story_id").alias("id")
    ).distinct().join(stories.select("id", "generated_at"), "id")
    direct = signals.join(
        evidence.filter((c("target") == "entity") & (c("entity_id") == entity_id)).select(c("signal_id").alias("id")), "id", "left_semi"
    )
    arcs = story_ops.entity_arcs(references, entities.filter(c("id") == entity_id), membership, stories)
    novel = signal_ops.entity_novelty_active(entities.filter(c("id") == entity_id), signals, evidence)

    one = stats.filter(c("id") == entity_id).withColumn("slug", slug(c("name")))
    return one.select(
        "id", "name", "type", "slug", F.concat(F.lit("/entity/"), "slug").alias("canonical_path"), "mention_count", "first_seen", "last_seen",
        F.coalesce(field(rate, "recent_mentions"), F.lit(0)).alias("recent_mentions"),
        F.coalesce(field(rate, "baseline_mentions"), F.lit(0)).alias("baseline_mentions"),
        field(rate, "growth_factor").alias("growth_factor"),
        field(diversity, "distinct_sources").alias("distinct_sources"), field(diversity, "herfindahl_index").alias("herfindahl_index"),
        field(rank, "within_type").alias("within_type"), field(rank, "sample_size").alias("sample_size"),
        *[field(mood, k).alias(k) for k in ("positive", "neutral", "negative", "unknown")],
        field(novel, "novelty_active").alias("novelty_active"),
        listed(rows, [-F.unix_micros("captured_at"), -c("id")], c("id"), n).alias("recent_records"),
        listed(linked, [-F.unix_micros("generated_at"), c("id")], c("id"), n).alias("recent_stories"),
        listed(direct, [-F.unix_micros("detected_at"), -c("id")], c("id"), n).alias("direct_signals"),
        listed(related, [-c("shared_record_count"), c("entity_id")], labelled(c("entity_id"), c("shared_record_count")), n).alias("related_entities"),
        listed(topics, [-c("record_count"), c("topic_id")], labelled(c("topic_id"), c("record_count")), n).alias("topic_mix"),
        listed(mix, [-c("record_count"), c("kind")], labelled(c("kind"), c("record_count")), len(SOURCE_KINDS)).alias("source_mix"),
        listed(trend, [-F.unix_date("week_start")], labelled(c("week_start"), F.round(c("avg_score") * 1_000_000).cast("long"), c("sample_size")), weeks).alias("sentiment_trend"),
        listed(timeline, [-F.unix_date("bucket_date")], labelled(c("bucket_date"), c("mention_count")), days).alias("mention_timeline"),
        listed(arcs, [-c("story_count"), c("arc_id")], labelled(c("arc_id"), c("story_count")), n).alias("story_arcs"),
    )
