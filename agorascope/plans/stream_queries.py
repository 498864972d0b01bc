"""Queries: streaming flows run to completion, incremental cursors, late rows, entity detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.operators.entity_page import entity_detail
from agorascope.plans.bindings import NE
from agorascope.plans.ingest_queries import ACCEPTED
from agorascope.plans.read_queries import STATS
from agorascope.plans.registry import query
from agorascope.plans.rollup_queries import GROWTH, GROWTH_RATE
from agorascope.session import fresh_dir
from agorascope.streaming import envelopes, flows
from agorascope.streaming.bound import StreamCorpus


def streaming(c) -> StreamCorpus:
    return StreamCorpus(c.spark, c.folder)


@query("stream_record_ingested", """SELECT CAST(id AS STRING) AS "recordId", kind, content_type AS "contentType", external_id AS "externalId",
    CAST(captured_at AS STRING) AS "capturedAt" FROM core""")
def _(c):
    events = streaming(c).core.select(
        F.col("id").cast("string").alias("recordId"), "kind", F.col("content_type").alias("contentType"),
        F.col("external_id").alias("externalId"), F.col("captured_at").alias("capturedAt"),
    )
    return flows.record_ingested(events)


@query("stream_ingest_dedup", f"""SELECT DISTINCT 'hackernews' AS kind, CAST(id AS STRING) AS external_id,
    CASE WHEN type = 'story' THEN 'post' ELSE 'comment' END AS content_type FROM ({ACCEPTED})""")
def _(c):
    return flows.ingest_dedup(streaming(c).items, 3, c.as_of).select("kind", "external_id", "content_type")


def _envelopes(c) -> DataFrame:
    """The corpus's events as envelopes, some of them outside their type's domain, cut short, or of no known type."""

    def packed(frame: DataFrame, event_type: str, **fields) -> DataFrame:
        return frame.select(F.lit(event_type).alias("event_type"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("payload"))

    col, text = F.col, lambda name: F.col(name).cast("string")
    core, active = c.core.select("id", "kind", "content_type", "external_id", "captured_at"), c.stories
    found = c.mentions.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.max("captured_at").alias("t"))
    targets = c.evidence.groupBy(col("signal_id").alias("id")).agg(F.sort_array(F.collect_set("target")).alias("targets"))
    arcs = c.membership.groupBy("arc_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = c.variants.groupBy("story_id").agg(F.sort_array(F.collect_set("variant_type")).alias("types"))
    rows = [
        packed(core, "record_ingested", recordId=text("id"), kind=F.when(col("id") % 97 == 0, "fax").otherwise(col("kind")), contentType=col("content_type"),
               externalId=col("external_id"), capturedAt=col("captured_at")),
        packed(found, "entities_extracted", recordId=text("record_id"), entityCount=col("n"), extractedAt=col("t")),
        packed(c.embeddings, "embedding_ready", recordId=text("record_id"), modelName=col("model_name"), dimensions=F.when(col("record_id") % 50 == 0, 0).otherwise(col("dimensions")))
        .withColumn("payload", F.when(F.get_json_object("payload", "$.recordId").cast("long") % 50 == 1, F.substring("payload", 1, 20)).otherwise(col("payload"))),
        packed(c.assignments, "topic_assigned", recordId=text("record_id"), topicId=col("topic_id"), method=col("method"), confidence=col("confidence")),
        packed(c.signals.join(targets, "id"), "signal_detected", signalId=col("id"), kind=col("kind"), severity=F.when(col("id") % 10 == 0, "extreme").otherwise(col("severity")),
               topicId=col("topic_id"), detectedAt=col("detected_at"), evidenceTargets=col("targets")),
        packed(active, "story_published", storyId=col("id"), type=col("type"), topicId=col("topic_id"), entityName=col("entity_name"), version=col("version"),
               previousVersionId=col("previous_version_id"), publishAt=col("publish_at"), generatedAt=col("generated_at"), generationModel=col("generation_model")),
        packed(active, "story_enriched", storyId=col("id"), enrichmentVersion=col("enrichment_version"), enrichedAt=col("enriched_at"), generationModel=col("generation_model"),
               externalCitationCount=F.lit(1), variantCount=col("turn"), schemaOrgGenerated=F.lit(True)),
        packed(arcs, "arc_updated", arcId=col("arc_id"), arcSlug=F.concat(F.lit("arc-"), text("arc_id")), arcStatus=F.lit("ongoing"), storyCount=col("n"), updatedAt=c.as_of),
        packed(kinds, "variants_generated", storyId=col("story_id"), variantTypes=col("types"), generationModel=F.lit("m"), generatedAt=c.as_of),
        packed(core.filter("id % 500 = 0"), "record_deleted", recordId=text("id")),
    ]
    return reduce(DataFrame.union, rows).withColumn("sent_at", c.as_of)


def _routed(c) -> envelopes.Sinks:
    landed = fresh_dir(c.spark, "sent")
    sent = _envelopes(c)
    sent.write.parquet(landed)
    return envelopes.route(flows.read_stream(c.spark, landed, "*.parquet", sent.schema))


_DEAD_SQL = f"""SELECT 'record_ingested' AS event_type, 'kind outside its domain' AS reason, count(*) AS n FROM core WHERE id % 97 = 0
    UNION ALL SELECT 'embedding_ready', 'dimensions below 1', count(*) FROM emb WHERE record_id % 50 = 0
    UNION ALL SELECT 'embedding_ready', 'payload does not parse', count(*) FROM emb WHERE record_id % 50 = 1
    UNION ALL SELECT 'signal_detected', 'severity outside its domain', count(*) FROM sig WHERE id % 10 = 0
    UNION ALL SELECT 'story_enriched', 'enrichedAt is missing', count(*) FROM st WHERE enrichment_version = 0
    UNION ALL SELECT 'arc_updated', 'arcId below 1', count(DISTINCT arc_id) FROM arcm WHERE arc_id = 0
    UNION ALL SELECT 'record_deleted', 'unknown type', count(*) FROM core WHERE id % 500 = 0"""


@query("stream_events", f"""SELECT 'record_ingested' AS event_type, count(*) AS n, count(DISTINCT kind) AS detail FROM core WHERE id % 97 <> 0
    UNION ALL SELECT 'entities_extracted', count(DISTINCT record_id), count(*) FROM ment
    UNION ALL SELECT 'embedding_ready', count(*), sum(len(vector)) FROM emb WHERE record_id % 50 > 1
    UNION ALL SELECT 'topic_assigned', count(*), count(confidence) FROM ta
    UNION ALL SELECT 'signal_detected', count(*), (SELECT count(DISTINCT (signal_id, target)) FROM sigev WHERE signal_id % 10 <> 0) FROM sig WHERE id % 10 <> 0
    UNION ALL SELECT 'story_published', count(*), sum(version) FROM st
    UNION ALL SELECT 'story_enriched', count(*), sum(turn) FROM st WHERE enrichment_version > 0
    UNION ALL SELECT 'arc_updated', count(DISTINCT arc_id), count(*) FROM arcm WHERE arc_id > 0
    UNION ALL SELECT 'variants_generated', count(DISTINCT story_id), count(DISTINCT (story_id, variant_type)) FROM vars""")
def _(c):
    """Events in each typed sink, with a sum over one of the type's own fields."""
    sinks = _routed(c)
    detail = {
        "record_ingested": F.count_distinct("kind"), "entities_extracted": F.sum("entityCount"), "embedding_ready": F.sum("dimensions"),
        "topic_assigned": F.count("confidence"), "signal_detected": F.sum(F.size("evidenceTargets")), "story_published": F.sum("version"),
        "story_enriched": F.sum("variantCount"), "arc_updated": F.sum("storyCount"), "variants_generated": F.sum(F.size("variantTypes")),
    }
    parts = [sinks.events(t).agg(F.count(F.lit(1)).alias("n"), d.cast("long").alias("detail")).select(F.lit(t).alias("event_type"), "n", "detail") for t, d in detail.items()]
    return reduce(DataFrame.union, parts)


@query("stream_dead_letters", f"SELECT * FROM ({_DEAD_SQL}) WHERE n > 0")
def _(c):
    return _routed(c).dead.groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("stream_daily_rollup", """SELECT CAST(CAST(captured_at AS DATE) AS STRING) AS bucket_date, kind, count(*) AS record_count FROM core GROUP BY 1, 2""")
def _(c):
    return flows.daily_rollup(streaming(c).core.select("kind", "captured_at"))


@query("stream_sliding_counts", """WITH w AS (SELECT kind, date_trunc('hour', captured_at) - i * INTERVAL 1 HOUR AS s FROM core, (SELECT unnest(range(0, 24)) AS i))
    SELECT CAST(s AS STRING) AS window_start, CAST(s + INTERVAL 24 HOUR AS STRING) AS window_end, kind, count(*) AS records FROM w
    WHERE s + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY s, kind""")
def _(c):
    return flows.sliding_counts(streaming(c).core.select("kind", "captured_at"))


@query("stream_embedding_gate", """WITH r AS (SELECT e.vec_id AS id, v.ts + INTERVAL 5 MINUTE AS ready_at FROM embeddings e JOIN events v ON v.event_id = e.vec_id
      WHERE e.vec_id % 3 <> 0)
    SELECT c.id AS record_id, CAST(c.captured_at AS STRING) AS captured_at, CAST(ready_at AS STRING) AS ready_at, ready_at IS NOT NULL AS embedded
    FROM core c LEFT JOIN r ON r.id = c.id AND ready_at BETWEEN captured_at AND captured_at + INTERVAL 1 HOUR
    WHERE ready_at IS NOT NULL OR captured_at + INTERVAL 70 MINUTE < (SELECT max(captured_at) FROM core)""")
def _(c):
    s = streaming(c)
    return flows.embedding_gate(s.core.select(F.col("id").alias("record_id"), "captured_at"), s.ready_embeddings())


@query("webhook_dedup", "SELECT DISTINCT idempotency_key FROM deliv")
def _(c):
    return flows.webhook_dedup(streaming(c).deliveries).select("idempotency_key")


@query("late_split", """SELECT kind, epoch(ingested_at) - epoch(captured_at) > 86400 AS is_backfill, count(*) AS n FROM arrivals GROUP BY 1, 2""")
def _(c):
    return flows.late_split(c.arrivals).groupBy("kind", "is_backfill").agg(F.count(F.lit(1)).alias("n"))


@query("incremental_cursor", f"""SELECT 'embed' AS task, {NE} + 1 AS waiting, '499' AS next_cursor
    UNION ALL SELECT 'extract', {NE} - 100, '600' UNION ALL SELECT 'classify', 0, CAST({NE} AS STRING)""")
def _(c):
    last = c._top("events", "event_id").cast("string")
    cursors = c.spark.createDataFrame([("embed",), ("extract",), ("classify",)], "task string").withColumn(
        "cursor", F.when(F.col("task") == "extract", "100").when(F.col("task") == "classify", last)
    )
    rows = []
    for task in ("embed", "extract", "classify"):
        moved = flows.advance(cursors, task, flows.next_batch(c.core, cursors, task, 500)).filter(F.col("task") == task)
        waiting = flows.pending(c.core, cursors, task).agg(F.count(F.lit(1))).scalar()
        rows.append(moved.select("task", waiting.alias("waiting"), F.col("cursor").alias("next_cursor")))
    return reduce(DataFrame.union, rows)


_ID = 4
_OWN = f"(SELECT DISTINCT record_id FROM ment WHERE entity_id = {_ID})"


def _top(inner: str, value: str, order: str, n: int) -> str:
    return f"(SELECT array_to_string(list(v ORDER BY rn), ',') FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {order}) AS rn FROM ({inner})) WHERE rn <= {n})"


_RECENT_SQL = _top(f"SELECT id, captured_at FROM core WHERE id IN {_OWN}", "CAST(id AS STRING)", "captured_at DESC, id DESC", 5)
_STORIES_SQL = _top(
    f"SELECT DISTINCT id, generated_at FROM (SELECT id, generated_at, unnest(source_record_ids) AS rid FROM st WHERE active) WHERE CAST(rid AS BIGINT) IN {_OWN}",
    "id", "generated_at DESC, id", 5)
_SIGNALS_SQL = _top(
    f"SELECT id, detected_at FROM sig WHERE id IN (SELECT signal_id FROM sigev WHERE target = 'entity' AND entity_id = {_ID})",
    "CAST(id AS STRING)", "detected_at DESC, id DESC", 5)
_RELATED_SQL = _top(
    f"SELECT entity_id, count(DISTINCT record_id) AS n FROM ment WHERE entity_id <> {_ID} AND record_id IN {_OWN} GROUP BY 1",
    "concat(entity_id, ':', n)", "n DESC, entity_id", 5)
_TOPICS_SQL = _top(
    f"SELECT topic_id, count(DISTINCT record_id) AS n FROM ta WHERE record_id IN {_OWN} GROUP BY 1", "concat(topic_id, ':', n)", "n DESC, topic_id", 5)
_KINDS = f"SELECT kind, count(*) AS n FROM core WHERE id IN {_OWN} GROUP BY 1"
_TREND_SQL = _top(
    f"SELECT CAST(date_trunc('week', captured_at) AS DATE) AS w, round(avg(sentiment_score), 6) AS a, count(*) AS n FROM core WHERE id IN {_OWN} GROUP BY 1",
    "concat_ws(':', CAST(w AS STRING), CAST(CAST(round(a * 1000000) AS BIGINT) AS STRING), CAST(n AS STRING))", "w DESC", 52)
_DAYS_SQL = _top(
    f"SELECT CAST(captured_at AS DATE) AS d, count(*) AS n FROM ment WHERE entity_id = {_ID} GROUP BY 1", "concat(CAST(d AS STRING), ':', n)", "d DESC", 30)
_ARCS_SQL = _top(
    f"""SELECT m.arc_id, count(DISTINCT r.story_id) AS n FROM refs r JOIN arcm m ON m.story_id = r.story_id
        WHERE r.ref_type = 'entity' AND r.ref_slug = 'nation-{_ID}' GROUP BY 1""", "concat(arc_id, ':', n)", "n DESC, arc_id", 5)


def _mood(label: str) -> str:
    return f"(SELECT count(*) FROM core WHERE id IN {_OWN} AND sentiment_label {label})"


@query("entity_detail", f"""WITH {STATS}, pr AS (SELECT id, round(percent_rank() OVER (PARTITION BY type ORDER BY mention_count) * 100, 4) AS pct,
      count(*) OVER (PARTITION BY type) AS n FROM es), g AS (SELECT * FROM ({GROWTH}) WHERE entity_id = {_ID})
    SELECT es.id, es.name, es.type, concat('nation-', es.id) AS slug, concat('/entity/nation-', es.id) AS canonical_path, mention_count,
      CAST(first_seen AS STRING) AS first_seen, CAST(last_seen AS STRING) AS last_seen, g.recent_mentions, g.baseline_mentions, {GROWTH_RATE} AS growth_factor,
      (SELECT count(*) FROM ({_KINDS})) AS distinct_sources,
      (SELECT round(sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) * 10000, 4) FROM ({_KINDS})) AS herfindahl_index,
      pr.pct AS within_type, pr.n AS sample_size, {_mood("= 'positive'")} AS positive, {_mood("= 'neutral'")} AS neutral, {_mood("= 'negative'")} AS negative,
      {_mood("IS NULL")} AS unknown, es.id IN (SELECT v.entity_id FROM sigev v JOIN sig s ON s.id = v.signal_id WHERE v.target = 'entity' AND s.kind = 'novelty'
        AND NOT s.acknowledged) AS novelty_active,
      {_RECENT_SQL} AS recent_records, {_STORIES_SQL} AS recent_stories, {_SIGNALS_SQL} AS direct_signals, {_RELATED_SQL} AS related_entities,
      {_TOPICS_SQL} AS topic_mix, {_top(_KINDS, "concat(kind, ':', n)", "n DESC, kind", 9)} AS source_mix, {_TREND_SQL} AS sentiment_trend,
      {_DAYS_SQL} AS mention_timeline, {_ARCS_SQL} AS story_arcs
    FROM es JOIN pr ON pr.id = es.id LEFT JOIN g ON g.entity_id = es.id WHERE es.id = {_ID}""")
def _(c):
    return entity_detail(
        _ID, entities=c.entities, mentions=c.mentions, records=c.core, assignments=c.assignments, stories=c.stories, signals=c.signals,
        evidence=c.evidence, references=c.references, membership=c.membership, as_of=c.as_of,
    )
