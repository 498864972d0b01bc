"""Outgoing event rows: webhook envelopes and the slim signal notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.functions.rules import iso_ms
from agorascope.functions.text import slug
from agorascope.operators.links import record_entities
from agorascope.params import P


def keyed_uuid(*parts: Column) -> Column:
    """A UUID-shaped id derived from keys: the same event always gets the same one."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def envelope(frame: DataFrame, event_type: str, key: Column, created: Column, data: list[Column]) -> DataFrame:
    """Rows as events: id, type, creation time, idempotency key and JSON payload with explicit nulls."""
    stable = keyed_uuid(F.lit(event_type), key.cast("string"))
    return frame.select(
        keyed_uuid(F.lit("delivery"), F.lit(event_type), key.cast("string")).alias("id"), F.lit(event_type).alias("event_type"),
        iso_ms(created).alias("created_at"), stable.alias("idempotency_key"),
        F.to_json(F.struct(*data), {"ignoreNullFields": "false"}).alias("data"),
    )


def webhook_payloads(
    stories: DataFrame, signals: DataFrame, mentions: DataFrame, entities: DataFrame, arc_stats: DataFrame, arcs: DataFrame,
    search_matches: DataFrame,
) -> DataFrame:
    """All five event types in one frame."""
    c = F.col
    published = envelope(stories, "story.published", c("id"), c("generated_at"), [
        c("id").alias("story_id"), c("slug"), c("type"), c("topic_id"), c("entity_name"), c("version"),
        iso_ms(c("generated_at")).alias("generated_at"), iso_ms(c("publish_at")).alias("publish_at"),
    ])
    detected = envelope(signals, "signal.detected", c("id"), c("detected_at"), [
        c("id").alias("signal_id"), c("kind"), c("severity"), c("score"), c("headline"), c("topic_id"),
        iso_ms(c("detected_at")).alias("detected_at"),
    ])
    times = mentions.groupBy("record_id", "entity_id").agg(F.max("captured_at").alias("captured_at"))
    named = record_entities(mentions, entities).join(times, ["record_id", "entity_id"])
    mentioned = envelope(named, "entity.mentioned", F.concat_ws("/", "entity_id", "record_id"), c("captured_at"), [
        c("entity_id"), c("name").alias("entity_name"), c("type").alias("entity_type"), slug(c("name")).alias("entity_slug"),
        c("record_id").cast("string").alias("record_id"), c("confidence"),
    ])
    updated = arc_stats.join(arcs.select(c("id").alias("arc_id"), c("slug").alias("arc_slug")), "arc_id")
    arc_events = envelope(updated, "arc.updated", c("arc_id"), c("last_story_at"), [
        c("arc_id"), c("arc_slug"), c("story_count"), iso_ms(c("last_story_at")).alias("updated_at"),
    ])
    matched = envelope(search_matches, "saved_search.matched", c("search_id"), c("matched_at"), [
        c("search_id").cast("string").alias("saved_search_id"), c("match_count"),
    ])
    return published.unionByName(detected).unionByName(mentioned).unionByName(arc_events).unionByName(matched)


def signal_notify(signals: DataFrame, max_bytes: int = P.notify_max_bytes) -> DataFrame:
    """Slim JSON notices; ``fits`` is false where the channel's byte limit is exceeded."""
    c = F.col
    payload = F.to_json(F.struct(
        c("id").alias("signalId"), c("kind"), c("severity"), c("score"), c("headline"), c("topic_id").alias("topicId"),
        iso_ms(c("detected_at")).alias("detectedAt"),
    ), {"ignoreNullFields": "false"})
    rows = signals.select("id", payload.alias("payload"))
    return rows.withColumn("bytes", F.octet_length("payload")).withColumn("fits", c("bytes") <= max_bytes)
