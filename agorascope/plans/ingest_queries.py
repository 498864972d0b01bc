"""Queries: sources, sinks, normalisation, dedup and upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from agorascope.functions import rules, text, vectors
from agorascope.operators import dedup, ingest
from agorascope.plans.bindings import NE, T_AS_OF, host
from agorascope.plans.registry import query
from agorascope.session import fresh_dir
from agorascope.sources import corpus as store

HYDRATED = "SELECT * FROM items WHERE NOT deleted AND NOT dead"
ACCEPTED = f"SELECT * FROM ({HYDRATED}) h WHERE type IN ('story','comment') AND \"by\" IS NOT NULL"


def _batch(c):
    """Every item of the feed, hydrated and normalised, with its delivery order."""
    ids = c.feed.filter("feed = 'new'")
    items = ingest.hydrate_items(ids, c.items)
    return ingest.normalize_items(items, 3)


def _stored(c):
    """What the store already holds: every seventh item."""
    return c.events.filter("event_id % 7 = 0").select(
        F.lit("hackernews").alias("kind"), F.col("event_id").cast("string").alias("external_id")
    )


def _added(c):
    new = ingest.upsert_records(ingest.canonical_record(_batch(c)), _stored(c), [F.col("source_metadata")], c.as_of)
    start = c._top("events", "event_id", 1)
    return ingest.assign_ids(new.withColumn("_n", F.col("external_id").cast("long")), "_n", start)


@query("scan_raw_items", """SELECT id, type, "by", time, title, url, score, descendants,
    array_to_string(kids, ',') AS kids, parent, deleted, dead FROM items""")
def _(c):
    path = fresh_dir(c.spark, "items")
    store.land_items(c.items, path)
    return store.scan_raw_items(c.spark, path).drop("text")


@query("candidate_ids", "SELECT feed, rank, id FROM feed WHERE feed = 'top' ORDER BY rank, id LIMIT 200")
def _(c):
    return ingest.candidate_ids(c.feed, "top", 200).select("feed", "rank", "id")


@query("hydrate_items", f"SELECT id, type, \"by\", time, delivery FROM ({HYDRATED})")
def _(c):
    return ingest.hydrate_items(c.feed.filter("feed = 'new'"), c.items).select("id", "type", "by", "time", "delivery")


@query("ensure_source", """SELECT kind, concat(kind, '-main') AS name,
      CASE WHEN category = 'discourse' THEN '{"v":1}' ELSE '{"v":2}' END AS config, category <> 'discourse' AS enabled,
      substring(sha256(concat(kind, '/', kind, '-main')), 1, 12) AS source_id
    FROM (SELECT DISTINCT kind, category FROM core)""")
def _(c):
    kinds = c.core.select("kind", "category").distinct().withColumn("name", F.concat("kind", F.lit("-main")))
    old = kinds.filter("category = 'discourse'").select(
        "kind", "name", F.lit('{"v":1}').alias("config"), F.lit(False).alias("enabled")
    )
    return ingest.ensure_source(old, kinds.select("kind", "name", F.lit('{"v":2}').alias("config")))


@query("cursor_window", """WITH cur AS (SELECT kind, TIMESTAMP '2024-01-10 00:00:00' +
        CAST(min(source_config_id) AS INTEGER) * INTERVAL 1 DAY AS cursor FROM core GROUP BY kind)
    SELECT cur.kind, CAST(cur.cursor AS STRING) AS cursor, count(c.id) AS rows,
      CAST(coalesce(max(c.captured_at), cur.cursor) AS STRING) AS next_cursor
    FROM cur LEFT JOIN core c ON c.kind = cur.kind AND c.captured_at > cur.cursor
      AND c.captured_at <= cur.cursor + INTERVAL 24 HOUR GROUP BY cur.kind, cur.cursor""")
def _(c):
    days = F.make_dt_interval(days=F.min("source_config_id"))
    cursors = c.core.groupBy("kind").agg((F.lit("2024-01-10 00:00:00").cast("timestamp") + days).alias("cursor"))
    return ingest.advance_cursors(cursors, ingest.next_window(c.core, cursors))


@query("scan_corpus", """SELECT CAST(CAST(captured_at AS DATE) AS STRING) AS captured_date, kind, count(*) AS n,
    CAST(count(content_text) AS BIGINT) AS with_text, CAST(sum(length(content_text)) AS BIGINT) AS chars
    FROM rec GROUP BY 1, 2""")
def _(c):
    path = fresh_dir(c.spark, "records")
    store.write_records(c.records, path)
    back = store.read_records(c.spark, path)
    return back.groupBy("captured_date", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("content_text").alias("with_text"),
        F.sum(F.length("content_text")).alias("chars"),
    )


TYPED = {
    "records": ("core", ["captured_at"]), "entities": ("entities", None), "entity_mentions": ("mentions", ["record_id"]), "topics": ("topics", None),
    "topic_assignments": ("assignments", ["record_id"]), "signals": ("signals", ["detected_at"]), "signal_evidence": ("evidence", ["signal_id"]),
    "stories": ("stories", ["generated_at"]), "story_citations": ("citations", ["story_id"]), "story_arcs": ("arcs", None),
    "story_arc_membership": ("membership", None), "story_content_variants": ("variants", None), "story_references": ("references", None),
    "story_related": ("related", None), "seo_metadata": ("seo", None), "embeddings": ("embeddings", ["record_id"]),
}


@query("scan_tables", """SELECT 'records' AS name, count(*) AS n, count(DISTINCT kind) AS detail FROM core UNION ALL SELECT 'entities', count(*), count(DISTINCT name) FROM ent
    UNION ALL SELECT 'entity_mentions', count(*), count(start_offset) FROM ment UNION ALL SELECT 'topics', count(*), count(DISTINCT name) FROM topics
    UNION ALL SELECT 'topic_assignments', count(*), count(confidence) FROM ta UNION ALL SELECT 'signals', count(*), count(topic_id) FROM sig
    UNION ALL SELECT 'signal_evidence', count(*), count(entity_id) FROM sigev UNION ALL SELECT 'stories', count(*), count(publish_at) FROM st
    UNION ALL SELECT 'story_citations', count(*), count(external_url) FROM cit UNION ALL SELECT 'story_arcs', count(*), count(DISTINCT slug) FROM arcs
    UNION ALL SELECT 'story_arc_membership', count(*), count(DISTINCT arc_id) FROM arcm UNION ALL SELECT 'story_content_variants', count(*), count(DISTINCT variant_type) FROM vars
    UNION ALL SELECT 'story_references', count(*), count(DISTINCT ref_slug) FROM refs UNION ALL SELECT 'story_related', count(*), count(DISTINCT related_id) FROM rel
    UNION ALL SELECT 'seo_metadata', count(*), count(DISTINCT page_type) FROM seo UNION ALL SELECT 'embeddings', count(*), sum(len(vector)) FROM emb""")
def _(c):
    """Typed tables written in their layout and read back with their declared columns."""
    details = {
        "records": F.count_distinct("kind"), "entities": F.count_distinct("name"), "entity_mentions": F.count("start_offset"), "topics": F.count_distinct("name"),
        "topic_assignments": F.count("confidence"), "signals": F.count("topic_id"), "signal_evidence": F.count("entity_id"), "stories": F.count("publish_at"),
        "story_citations": F.count("external_url"), "story_arcs": F.count_distinct("slug"), "story_arc_membership": F.count_distinct("arc_id"),
        "story_content_variants": F.count_distinct("variant_type"), "story_references": F.count_distinct("ref_slug"),
        "story_related": F.count_distinct("related_id"), "seo_metadata": F.count_distinct("page_type"), "embeddings": F.sum(F.size("vector")),
    }
    parts = []
    for name, (frame, order) in TYPED.items():
        path = fresh_dir(c.spark, name)
        store.write_table(getattr(c, frame), name, path, order)
        back = store.read_table(c.spark, name, path)
        parts.append(back.agg(F.count(F.lit(1)).alias("n"), details[name].cast("long").alias("detail")).select(F.lit(name).alias("name"), "n", "detail"))
    return reduce(lambda a, b: a.union(b), parts)


@query("ingest_lag", f"""SELECT kind, CAST(max(captured_at) AS STRING) AS last_captured_at,
    CAST(floor(epoch({T_AS_OF})) - floor(epoch(max(captured_at))) AS BIGINT) AS lag_seconds,
    CAST(floor(epoch({T_AS_OF})) - floor(epoch(max(captured_at))) AS BIGINT) > 43200 AS late FROM core GROUP BY kind""")
def _(c):
    return ingest.ingest_lag(c.core, c.as_of)


@query("parse_vectors", """SELECT vec_id AS record_id, CAST(64 AS BIGINT) AS dimensions,
    round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, true AS same FROM embeddings""")
def _(c):
    wire = c.vectors.select("record_id", "vector", vectors.render_vector(F.col("vector")).alias("wire"))
    back = wire.withColumn("parsed", vectors.parse_vector(F.col("wire")))
    total = F.aggregate("parsed", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select(
        "record_id", F.size("parsed").alias("dimensions"), F.round(total, 6).alias("total"),
        (F.col("parsed") == F.col("vector")).alias("same"),
    )


@query("record_ingested_events", f"""WITH fresh AS (SELECT DISTINCT id, type FROM ({ACCEPTED}) a WHERE id % 7 <> 0)
    SELECT CAST({NE} + row_number() OVER (ORDER BY id) AS STRING) AS "recordId", 'hackernews' AS kind,
      CASE WHEN type = 'story' THEN 'post' ELSE 'comment' END AS "contentType", CAST(id AS STRING) AS "externalId",
      strftime({T_AS_OF}, '%Y-%m-%dT%H:%M:%S.%gZ') AS "capturedAt" FROM fresh""")
def _(c):
    return ingest.record_ingested_events(_added(c))


@query("export_csv", """SELECT 'saved_search_results' AS kind, 'completed' AS status, count(*) AS row_count
    FROM core WHERE category = 'article'""")
def _(c):
    report = c.core.filter("category = 'article'").select("id", "kind", "external_id", "title", "captured_at")
    return store.export_csv(report, fresh_dir(c.spark, "export"), "saved_search_results")


@query("normalize_items", f"""SELECT 'hackernews' AS kind, CAST(3 AS BIGINT) AS source_config_id,
      CASE WHEN type = 'story' THEN 'post' ELSE 'comment' END AS content_type, CAST(id AS STRING) AS external_id,
      title, text AS content_text, url, "by" AS author, CAST(make_timestamp(time * 1000000) AS STRING) AS published_at,
      CAST(NULL AS STRING) AS subreddit, 'en' AS language,
      concat('{{"score":', coalesce(score, 0), ',"descendants":', coalesce(descendants, 0), ',"kids":[',
        coalesce(array_to_string(kids, ','), ''), '],"parent":', coalesce(CAST(parent AS STRING), 'null'),
        ',"hn_type":"', type, '"}}') AS source_metadata FROM ({ACCEPTED})""")
def _(c):
    return _batch(c)


@query("canonical_record", f"""SELECT kind, category, CASE WHEN category = 'article' THEN {host('url')} END AS publisher,
    content_type, external_id, title, url, author, 'en' AS language, source_metadata, '{{}}' AS analysis,
    CAST(NULL AS STRING) AS published_at FROM rec""")
def _(c):
    shaped = ingest.canonical_record(c.records_url.drop("category", "publisher"))
    return shaped.drop("source_config_id", "content_text", "subreddit")


@query("derive_category", "SELECT kind, category, count(*) AS n FROM core GROUP BY 1, 2")
def _(c):
    return c.core.select("kind", rules.category(F.col("kind")).alias("category")).groupBy("kind", "category").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("derive_publisher", "SELECT id, url, publisher FROM rec WHERE category = 'article'")
def _(c):
    return c.records_url.filter("category = 'article'").select(
        "id", "url", text.host(F.col("url")).alias("publisher")
    )


@query("engagement_score", """SELECT id, round(coalesce(score, 0) + 2.0 * coalesce(descendants, 0), 6) AS engagement_score
    FROM items WHERE delivery = 0 AND type IN ('story','comment') AND "by" IS NOT NULL""")
def _(c):
    rows = ingest.normalize_items(c.items.filter("delivery = 0"), 3)
    return ingest.engagement(rows).select(F.col("external_id").cast("long").alias("id"), "engagement_score")


@query("metadata_fields", """SELECT id, CAST(regexp_extract(source_metadata, '([0-9]+)', 1) AS BIGINT) AS k,
    false AS has_score FROM core""")
def _(c):
    return c.core.select(
        "id", F.get_json_object("source_metadata", "$.k").cast("long").alias("k"),
        F.get_json_object("source_metadata", "$.score").isNotNull().alias("has_score"),
    )


@query("upsert_records", f"""WITH acc AS (SELECT DISTINCT id, type FROM ({ACCEPTED}) a)
    SELECT 'hackernews' AS kind, CAST(id AS STRING) AS external_id,
      CASE WHEN type = 'story' THEN 'post' ELSE 'comment' END AS content_type FROM acc WHERE id % 7 <> 0""")
def _(c):
    batch = ingest.canonical_record(_batch(c))
    return ingest.upsert_records(batch, _stored(c), [F.col("source_metadata")], c.as_of).select(
        "kind", "external_id", "content_type"
    )


@query("dedup_article_url", """SELECT id, url FROM (SELECT id, url, category,
      row_number() OVER (PARTITION BY url, category ORDER BY captured_at, id) AS rn FROM rec)
    WHERE category <> 'article' OR url IS NULL OR rn = 1""")
def _(c):
    return dedup.dedup_article_urls(c.records_url.select("id", "url", "category", "captured_at")).select("id", "url")


@query("upsert_embeddings", """SELECT record_id, model_name, CAST(len(vector) AS BIGINT) AS dimensions FROM emb
    WHERE NOT (model_name = 'm64' AND record_id % 2 = 0)""")
def _(c):
    stored = c.embeddings.filter("model_name = 'm64' AND record_id % 2 = 0")
    batch = c.embeddings.union(c.embeddings.filter("model_name = 'm32'"))
    return dedup.upsert_embeddings(batch, stored, [F.col("dimensions")]).select("record_id", "model_name", "dimensions")


@query("canonical_entities", """WITH v AS (SELECT name, type, id FROM ent
      UNION ALL SELECT CASE WHEN id % 2 = 1 THEN upper(name) ELSE name END, type, id + 1000 FROM ent)
    SELECT lower(name) AS name_key, type, arg_min(name, id) AS name, min(id) AS first_seen, count(*) AS variants
    FROM v GROUP BY 1, 2""")
def _(c):
    e = c.entities.select("name", "type", F.col("id").alias("first_seen"))
    shouted = e.select(
        F.when(F.col("first_seen") % 2 == 1, F.upper("name")).otherwise(F.col("name")), "type", F.col("first_seen") + 1000
    )
    return dedup.canonical_entities(e.union(shouted))


@query("dedup_mentions", """SELECT entity_id, record_id, start_offset FROM (SELECT DISTINCT entity_id, record_id,
    start_offset FROM ment) WHERE NOT (record_id % 9 = 0 AND start_offset IS NULL)""")
def _(c):
    stored = c.mentions.filter("record_id % 9 = 0 AND start_offset IS NULL")
    return dedup.dedup_mentions(c.mentions, stored).select("entity_id", "record_id", "start_offset")


@query("dedup_assignments", """SELECT record_id, topic_id, method, max(confidence) AS confidence FROM (
      SELECT * FROM ta UNION ALL SELECT record_id, topic_id, method, 0.5 FROM ta)
    GROUP BY 1, 2, 3""")
def _(c):
    again = c.assignments.withColumn("confidence", F.lit(0.5))
    return dedup.dedup_assignments(c.assignments.union(again))


@query("upsert_signals", """WITH b AS (SELECT * FROM sig WHERE id % 4 <> 0), s AS (SELECT * FROM sig WHERE id % 4 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind, topic_id, dedup_key ORDER BY detected_at, id) AS rn FROM b)
    SELECT id, kind, topic_id, dedup_key FROM r WHERE dedup_key IS NULL OR (rn = 1 AND NOT EXISTS (
      SELECT 1 FROM s WHERE s.kind = r.kind AND s.topic_id IS NOT DISTINCT FROM r.topic_id AND s.dedup_key = r.dedup_key))""")
def _(c):
    s = c.signals
    return dedup.upsert_signals(s.filter("id % 4 <> 0"), s.filter("id % 4 = 0")).select(
        "id", "kind", "topic_id", "dedup_key"
    )


@query("upsert_editorial", """SELECT coalesce(n.story_id, o.story_id) AS story_id,
      coalesce(n.variant_type, o.variant_type) AS variant_type, coalesce(n.content, o.content) AS content
    FROM vars o FULL JOIN (SELECT story_id, variant_type, concat('new ', content) AS content FROM vars
      WHERE variant_type LIKE 'summary%' OR variant_type = 'email_teaser') n
    ON n.story_id = o.story_id AND n.variant_type = o.variant_type""")
def _(c):
    fresh = c.variants.filter("variant_type LIKE 'summary%' OR variant_type = 'email_teaser'")
    return dedup.keyed_refresh(
        c.variants, fresh.withColumn("content", F.concat(F.lit("new "), "content")), ["story_id", "variant_type"]
    )


@query("merge_entities", """SELECT DISTINCT CASE WHEN entity_id BETWEEN 101 AND 125 THEN 101 + (entity_id - 101) // 2
      ELSE entity_id END AS entity_id, record_id, start_offset FROM ment""")
def _(c):
    aliases = c.entities.filter("id BETWEEN 101 AND 125").select(
        F.col("id").alias("alias_id"), (F.floor((F.col("id") - 101) / 2) + 101).cast("int").alias("canonical_id")
    )
    return dedup.merge_entities(c.mentions, aliases).select("entity_id", "record_id", "start_offset")
