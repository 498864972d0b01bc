"""Queries: joins between the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorascope.operators import links, rollups, stories as ops
from agorascope.params import P
from agorascope.plans.bindings import slug, tokens
from agorascope.plans.registry import query
from agorascope.plans.rollup_queries import SENT_DAILY
from agorascope.schemas import VARIANT_TYPES


@query("records_with_source", """SELECT r.id, r.kind, s.name AS source_name, s.enabled AS source_enabled FROM core r
    LEFT JOIN (SELECT DISTINCT source_config_id AS id, concat(kind, '-main') AS name, source_config_id <> 4 AS enabled FROM core
      WHERE source_config_id <> 9) s ON s.id = r.source_config_id""")
def _(c):
    sources = c.core.filter("source_config_id <> 9").select(
        F.col("source_config_id").alias("id"), F.concat("kind", F.lit("-main")).alias("name"),
        (F.col("source_config_id") != 4).alias("enabled"),
    ).distinct()
    return links.records_with_source(c.core, sources).select("id", "kind", "source_name", "source_enabled")


@query("record_entities", """SELECT record_id, entity_id, name, type, max(confidence) AS confidence FROM ment
    JOIN ent e ON e.id = ment.entity_id GROUP BY ALL""")
def _(c):
    return links.record_entities(c.mentions, c.entities)


@query("record_topics", """SELECT record_id, topic_id, t.name AS topic_name, method, confidence FROM ta
    JOIN topics t ON t.id = ta.topic_id""")
def _(c):
    return links.record_topics(c.assignments, c.topics)


@query("record_signals", """SELECT DISTINCT e.record_id, e.signal_id, s.kind, s.severity FROM sigev e JOIN sig s ON s.id = e.signal_id
    WHERE e.record_id IS NOT NULL""")
def _(c):
    return links.record_signals(c.evidence, c.signals)


@query("record_stories", """SELECT DISTINCT CAST(rid AS BIGINT) AS record_id, id AS story_id, slug, active
    FROM (SELECT unnest(source_record_ids) AS rid, id, slug, active FROM st)""")
def _(c):
    return links.record_stories(c.stories)


@query("story_with_citations", """SELECT s.id, c.marker, c.citation_type, c.record_id, c.external_url, c.position,
    coalesce(n.i, 0) AS internal_count, coalesce(n.e, 0) AS external_count FROM st s LEFT JOIN cit c ON c.story_id = s.id
    LEFT JOIN (SELECT story_id, count_if(citation_type = 'internal') AS i, count_if(citation_type = 'external') AS e FROM cit
      GROUP BY 1) n ON n.story_id = s.id""")
def _(c):
    return ops.story_with_citations(c.stories.select("id"), c.citations).select(
        "id", "marker", "citation_type", "record_id", "external_url", "position", "internal_count", "external_count"
    )


@query("story_citations", """SELECT s.id, coalesce(array_to_string(list(concat_ws(':', c.position, c.marker, c.citation_type, coalesce(CAST(c.record_id AS STRING), c.external_url, ''))
      ORDER BY c.position, c.marker) FILTER (WHERE c.story_id IS NOT NULL), ','), '') AS citations, count_if(c.citation_type = 'internal') AS internal_count,
      count_if(c.citation_type = 'external') AS external_count FROM st s LEFT JOIN cit c ON c.story_id = s.id GROUP BY s.id""")
def _(c):
    line = lambda x: F.concat_ws(":", x["position"], x["marker"], x["citation_type"], F.coalesce(x["record_id"].cast("string"), x["external_url"], F.lit("")))
    return ops.story_citations(c.stories.select("id"), c.citations).select(
        "id", F.coalesce(F.array_join(F.transform("citations", line), ","), F.lit("")).alias("citations"), "internal_count", "external_count"
    )


@query("story_sources", """SELECT c.story_id, CASE WHEN c.citation_type = 'internal' THEN 'sources' ELSE 'external' END AS section,
    c.record_id, r.kind, r.title, r.author AS byline, r.sentiment_score, c.external_url, c.inferred, c.credibility_score
    FROM cit c LEFT JOIN core r ON r.id = c.record_id""")
def _(c):
    return ops.story_sources(c.citations, c.core).select(
        "story_id", "section", "record_id", "kind", "title", "byline", "sentiment_score", "external_url", "inferred",
        "credibility_score",
    )


@query("story_related", """SELECT r.story_id, r.related_id, r.relationship_type, r.similarity_score, s.headline AS related_headline
    FROM rel r JOIN st s ON s.id = r.related_id WHERE s.active""")
def _(c):
    return ops.story_related(c.related, c.stories).filter("active").drop("active")


@query("story_variants", "SELECT story_id, " + ", ".join(
    f"max(content) FILTER (variant_type = '{v}') AS {v}" for v in VARIANT_TYPES) + " FROM vars GROUP BY story_id")
def _(c):
    return ops.story_variants(c.active_stories, c.variants, VARIANT_TYPES)


BEFORE = """SELECT s.id, g.id AS signal_id, g.kind AS signal_kind, g.severity, g.score,
      row_number() OVER (PARTITION BY s.id ORDER BY g.detected_at DESC, g.id DESC) AS rn
    FROM st s JOIN sig g ON g.topic_id = s.topic_id AND g.detected_at < s.generated_at
      AND g.detected_at >= s.generated_at - INTERVAL 24 HOUR"""


@query("signals_before_story", f"""SELECT s.id, s.topic_id, b.signal_id, b.signal_kind FROM st s
    LEFT JOIN ({BEFORE}) b ON b.id = s.id AND b.rn = 1""")
def _(c):
    return ops.signals_before_story(c.stories, c.signals, 24).select("id", "topic_id", "signal_id", "signal_kind")


@query("story_signal_provenance", f"""SELECT s.id, b.signal_id, b.signal_kind, b.severity, b.score, CASE b.severity
      WHEN 'low' THEN CAST(0.4 AS DOUBLE) WHEN 'medium' THEN 0.7 WHEN 'high' THEN 0.9 END AS confidence
    FROM st s LEFT JOIN ({BEFORE}) b ON b.id = s.id AND b.rn = 1""")
def _(c):
    before = ops.signals_before_story(c.stories, c.signals, 24)
    return ops.signal_provenance(c.stories, before).drop("slug")


@query("asof_baseline", f"""WITH d AS ({SENT_DAILY}) SELECT r.id, r.kind, d.bucket_date AS baseline_day, d.avg_score AS baseline_avg
    FROM core r ASOF LEFT JOIN (SELECT *, CAST(bucket_date AS DATE) AS bd FROM d) d
      ON d.kind = r.kind AND CAST(r.captured_at AS DATE) > d.bd""")
def _(c):
    return ops.asof_baseline(c.core, rollups.sentiment_daily(c.core)).select("id", "kind", "baseline_day", "baseline_avg")


@query("arc_members", """SELECT m.arc_id, concat('arc-', m.arc_id) AS arc_slug, m.story_id, s.headline, s.type,
    row_number() OVER (PARTITION BY m.arc_id ORDER BY s.generated_at, m.story_id) AS sequence_order
    FROM arcm m JOIN st s ON s.id = m.story_id""")
def _(c):
    sequence = ops.arc_sequence(c.membership, c.stories)
    return ops.arc_members(c.arcs, sequence, c.stories).select(
        "arc_id", "arc_slug", "story_id", "headline", "type", "sequence_order"
    )


@query("signal_evidence_resolved", """SELECT v.signal_id, v.target, coalesce(CAST(v.record_id AS STRING), CAST(v.entity_id AS STRING),
      CAST(v.target_topic_id AS STRING), v.story_id) AS target_id, v.weight,
    coalesce(r.kind || '/' || r.external_id, e.name, t.display_name, s.slug) AS label
    FROM sigev v LEFT JOIN core r ON r.id = v.record_id LEFT JOIN ent e ON e.id = v.entity_id
    LEFT JOIN topics t ON t.id = v.target_topic_id LEFT JOIN st s ON s.id = v.story_id""")
def _(c):
    return links.signal_evidence_resolved(c.evidence, c.core, c.entities, c.topics, c.stories)


@query("records_with_dispatch", """SELECT id, id IN (SELECT CAST(rid AS BIGINT) FROM (SELECT unnest(source_record_ids) AS rid FROM st
    WHERE active AND type = 'dispatch')) AS has_dispatch FROM core""")
def _(c):
    hits = ops.dispatch_records(c.stories).select(F.col("record_id").alias("id"), F.lit(True).alias("d"))
    return c.core.select("id").join(hits, "id", "left").select("id", F.col("d").isNotNull().alias("has_dispatch"))


@query("embedding_backlog", """SELECT 'embedding' AS enrichment, count(*) AS waiting FROM core WHERE id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'technology_mention', count(*) FROM core WHERE id NOT IN (SELECT record_id FROM ment WHERE entity_id > 100)
    UNION ALL SELECT 'cluster_topic', count(*) FROM core WHERE id NOT IN (SELECT record_id FROM ta WHERE method = 'cluster')""")
def _(c):
    def waiting(name, done):
        return links.backlog(c.core.select("id"), done).agg(F.count(F.lit(1)).alias("waiting")).select(
            F.lit(name).alias("enrichment"), "waiting"
        )

    return (
        waiting("embedding", c.vectors)
        .union(waiting("technology_mention", c.mentions.filter("entity_id > 100")))
        .union(waiting("cluster_topic", c.assignments.filter("method = 'cluster'")))
    )


@query("link_integrity", f"""SELECT r.ref_type, r.ref_slug, count(*) AS in_degree, r.ref_slug NOT IN (
      SELECT {slug('name')} FROM ent WHERE r.ref_type = 'entity' UNION ALL SELECT name FROM topics WHERE r.ref_type = 'beat'
      UNION ALL SELECT slug FROM st WHERE active AND r.ref_type = 'story') AS broken
    FROM refs r GROUP BY r.ref_type, r.ref_slug""")
def _(c):
    return ops.link_integrity(c.references, c.entities, c.topics, c.stories)


@query("page_seo", """SELECT p.page_type, p.page_id, s.seo_title, s.version FROM (
      SELECT 'story' AS page_type, slug AS page_id FROM st WHERE active UNION ALL SELECT 'beat', name FROM topics
      UNION ALL SELECT 'entity', lower(name) FROM ent UNION ALL SELECT 'arc', slug FROM arcs) p
    LEFT JOIN (SELECT * FROM seo WHERE active AND NOT (page_type = 'beat' AND page_id = 'src3')) s
      ON s.page_type = p.page_type AND s.page_id = p.page_id""")
def _(c):
    seo = c.seo.filter("NOT (page_type = 'beat' AND page_id = 'src3')")
    return ops.page_seo(c.stories, c.topics, c.entities, c.arcs, seo)


@query("entity_alerts", """SELECT s.subscriber_id, s.entity_id, s.cadence, m.day, m.match_count, m.last_match_at FROM subs s JOIN (
      SELECT entity_id, CAST(CAST(captured_at AS DATE) AS STRING) AS day, count(*) AS match_count,
        CAST(max(captured_at) AS STRING) AS last_match_at FROM ment GROUP BY 1, 2) m ON m.entity_id = s.entity_id""")
def _(c):
    return links.entity_alerts(c.mentions, c.subscriptions)


MATCHES = f"""SELECT q.search_id, s.id FROM (SELECT id, concat(' ', array_to_string({tokens('content')}, ' '), ' ') AS flat FROM st
      WHERE active) s JOIN saved q ON contains(s.flat, concat(' ', q.query, ' '))"""


def matches(c):
    texts = c.active_stories.select("id", F.col("content").alias("text"))
    return links.saved_search_matches(texts, c.saved_searches)


@query("saved_search_matches", MATCHES)
def _(c):
    return matches(c)


@query("alert_digest", f"""WITH m AS (SELECT q.search_id, ['instant','daily','weekly'][q.search_id % 3 + 1] AS cadence, s.id, s.generated_at
      FROM ({MATCHES}) q JOIN st s ON s.id = q.id),
    f AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY generated_at DESC, id DESC) AS rn FROM m
      WHERE generated_at <= TIMESTAMP '2024-01-05 00:00:00' AND generated_at > TIMESTAMP '2024-01-05 00:00:00'
        - CASE cadence WHEN 'daily' THEN INTERVAL 24 HOUR WHEN 'weekly' THEN INTERVAL 168 HOUR ELSE INTERVAL 1 HOUR END)
    SELECT search_id, cadence, count(*) AS match_count, string_agg(id, ',' ORDER BY rn) FILTER (rn <= 5) AS top_ids
    FROM f GROUP BY 1, 2""")
def _(c):
    from agorascope.functions.rules import lookup
    from agorascope.plans.read_queries import s_as_of

    times = c.stories.select("id", F.col("generated_at").alias("matched_at"))
    found = matches(c).join(times, "id").withColumn(
        "cadence", lookup(("instant", "daily", "weekly"), F.col("search_id") % 3)
    )
    return links.alert_digest(found, s_as_of(), P.alert_top_ids)


@query("cascade_delete", """SELECT 'mention' AS child, count(*) AS rows, count(entity_id) AS linked FROM ment WHERE entity_id % 4 <> 0
    UNION ALL SELECT 'story_topic', count(*), count(CASE WHEN topic_id % 4 <> 0 THEN 1 END) FROM st
    UNION ALL SELECT 'evidence', count(*), count(record_id) FROM sigev WHERE record_id IS NULL OR record_id % 4 <> 0""")
def _(c):
    def outcome(name, rows, column):
        return rows.agg(F.count(F.lit(1)).alias("rows"), F.count(column).alias("linked")).select(
            F.lit(name).alias("child"), "rows", "linked"
        )

    entities, topics = c.entities.filter("id % 4 <> 0"), c.topics.filter("id % 4 <> 0")
    records = c.core.filter("id % 4 <> 0")
    return (
        outcome("mention", links.cascade_delete(entities, c.mentions, "entity_id", "cascade"), "entity_id")
        .union(outcome("story_topic", links.cascade_delete(topics, c.stories, "topic_id", "set_null"), "topic_id"))
        .union(outcome("evidence", links.cascade_delete(records, c.evidence, "record_id", "cascade"), "record_id"))
    )
