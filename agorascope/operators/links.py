"""Joins between records, topics, entities, signals and stories; alerts; delete propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.functions.text import tokens
from agorascope.operators.rollups import n_rows


def records_with_source(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Source settings beside each record; the reference is optional."""
    settings = sources.select(
        F.col("id").alias("source_config_id"), F.col("name").alias("source_name"), F.col("enabled").alias("source_enabled")
    )
    return records.join(settings, "source_config_id", "left")


def record_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct entities of each record with the best confidence."""
    best = mentions.groupBy("record_id", "entity_id").agg(F.max("confidence").alias("confidence"))
    return best.join(entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id")


def record_topics(assignments: DataFrame, topics: DataFrame) -> DataFrame:
    return assignments.join(topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name")), "topic_id")


def record_signals(evidence: DataFrame, signals: DataFrame) -> DataFrame:
    pairs = evidence.filter(F.col("record_id").isNotNull()).select("record_id", "signal_id").dropDuplicates()
    return pairs.join(signals.select(F.col("id").alias("signal_id"), "kind", "severity"), "signal_id")


def record_stories(stories: DataFrame) -> DataFrame:
    """(record, story) through the stored id lists."""
    return stories.select(
        F.explode(F.col("source_record_ids").cast("array<bigint>")).alias("record_id"), F.col("id").alias("story_id"), "slug", "active"
    ).dropDuplicates(["record_id", "story_id"])


def backlog(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records an enrichment has not reached yet."""
    return records.join(done.select(F.col("record_id").alias("id")), "id", "left_anti")


def signal_evidence_resolved(
    evidence: DataFrame, records: DataFrame, entities: DataFrame, topics: DataFrame, stories: DataFrame
) -> DataFrame:
    """Evidence with the label of whichever target it points to.

    The evidence is split by target, so each part meets one table and NULL keys join nothing.
    """

    def part(target: str, key: str, names: DataFrame) -> DataFrame:
        rows = evidence.filter(F.col("target") == target).select(
            "signal_id", "target", F.col(key).cast("string").alias("target_id"), "weight", F.col(key).alias("_k")
        )
        return rows.join(names, "_k", "left").drop("_k")

    return (
        part("record", "record_id", records.select(F.col("id").alias("_k"), F.concat_ws("/", "kind", "external_id").alias("label")))
        .unionByName(part("entity", "entity_id", entities.select(F.col("id").alias("_k"), F.col("name").alias("label"))))
        .unionByName(part("topic", "target_topic_id", topics.select(F.col("id").alias("_k"), F.col("display_name").alias("label"))))
        .unionByName(part("story", "story_id", stories.select(F.col("id").alias("_k"), F.col("slug").alias("label"))))
    )


def cascade_delete(parent: DataFrame, child: DataFrame, column: str, action: str) -> DataFrame:
    """Child rows after parents were deleted (``parent`` is what remains).

    ``cascade`` drops children of missing parents, ``set_null`` clears the reference. A NULL
    reference is untouched by either.
    """
    ids = parent.select(F.col("id").alias(column)).withColumn("_have", F.lit(True))
    joined = child.join(ids, column, "left")
    gone = F.col(column).isNotNull() & F.col("_have").isNull()
    if action == "cascade":
        return joined.filter(~gone).drop("_have")
    return joined.withColumn(column, F.when(~gone, F.col(column))).drop("_have")


def entity_alerts(mentions: DataFrame, subscriptions: DataFrame, salts: int = 16) -> DataFrame:
    """Matches per subscriber, entity and day.

    Mentions are counted per (entity, day) first. Subscribers of one popular entity are spread
    over ``salts`` and the small daily counts repeated for each, so no task holds them all.
    """
    daily = mentions.groupBy("entity_id", F.to_date("captured_at").alias("day")).agg(
        n_rows().alias("match_count"), F.max("captured_at").alias("last_match_at")
    )
    spread = daily.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = subscriptions.withColumn("_salt", F.pmod(F.xxhash64("subscriber_id"), F.lit(salts)).cast("int"))
    return salted.join(spread, ["entity_id", "_salt"]).drop("_salt")


def saved_search_matches(texts: DataFrame, searches: DataFrame) -> DataFrame:
    """(search, document) where the document contains the query's words in sequence.

    An equi-join on the first two words (or the only one) finds candidates, the whole phrase
    is then checked on them; queries of any length are exact. ``texts`` has ``id`` and ``text``.
    """
    q = searches.withColumn("_w", tokens(F.col("query"))).filter(F.size("_w") > 0).select(
        "search_id", F.concat_ws(" ", F.slice("_w", 1, 2)).alias("anchor"),
        F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_phrase"),
    )
    words = texts.withColumn("_w", tokens(F.col("text")))
    pairs = F.zip_with("_w", F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    anchors = F.array_distinct(F.concat("_w", F.filter(pairs, lambda p: p.isNotNull())))
    flat = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))
    wanted = q.select("anchor").distinct()
    heads = words.select("id", F.explode(anchors).alias("anchor")).join(wanted, "anchor", "left_semi")
    hits = heads.join(q, "anchor").select("id", "search_id", "_phrase")
    return hits.join(words.select("id", flat.alias("_flat")), "id").filter(F.contains("_flat", "_phrase")).select(
        "search_id", "id"
    )


def alert_digest(matches: DataFrame, as_of: Column, top: int) -> DataFrame:
    """Per search and cadence: new matches since the last run and up to ``top`` newest ids.

    ``matches`` holds ``search_id``, ``cadence``, ``id`` and ``matched_at``. Counting and the
    short list are separate, so no group is gathered to be cut.
    """
    from agorascope.operators.paging import top_per_group

    span = F.when(F.col("cadence") == "daily", 24).when(F.col("cadence") == "weekly", 168).otherwise(1)
    since = as_of - F.make_dt_interval(hours=span)
    fresh = matches.filter((F.col("matched_at") > since) & (F.col("matched_at") <= as_of))
    counts = fresh.groupBy("search_id", "cadence").agg(n_rows().alias("match_count"))
    best = top_per_group(fresh, ["search_id", "cadence"], [F.desc("matched_at"), F.desc("id")], top)
    ids = best.groupBy("search_id", "cadence").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("top_ids")
    )
    return counts.join(ids, ["search_id", "cadence"])
