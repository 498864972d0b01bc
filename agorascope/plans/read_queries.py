"""Queries: projections, filters, lookups, paging and data-quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.functions import rules, text
from agorascope.operators import paging, quality, reads, rollups, stories as story_ops
from agorascope.plans.bindings import NE, T_AS_OF, slug
from agorascope.plans.registry import query
from agorascope.schemas import ARC_STATUSES, CONTENT_TYPES, SEVERITIES, SOURCE_KINDS, STORY_TYPES

S_AS_OF = "2024-01-05 00:00:00"  # the fixture stories fall into the first days of the month
S_TIME = f"TIMESTAMP '{S_AS_OF}'"


def s_as_of():
    return F.lit(S_AS_OF).cast("timestamp")


# Computed arc status as SQL: stored breaking and young; else live through its topic's signals or its arc.
COMPUTED = f"""comp AS (SELECT s.*, CASE
      WHEN s.arc_status = 'breaking' AND s.generated_at >= {S_TIME} - INTERVAL 48 HOUR THEN 'breaking'
      WHEN s.arc_status NOT IN ('resolved', 'archived') AND (lt.topic_id IS NOT NULL OR la.arc_id IS NOT NULL)
        THEN 'developing' END AS computed_arc_status
    FROM st s
    LEFT JOIN (SELECT DISTINCT topic_id FROM sig WHERE topic_id IS NOT NULL AND detected_at <= {S_TIME}
        AND detected_at >= {S_TIME} - INTERVAL 12 HOUR) lt ON lt.topic_id = s.topic_id
    LEFT JOIN arcm m ON m.story_id = s.id
    LEFT JOIN (SELECT DISTINCT m2.arc_id FROM arcm m2 JOIN st s2 ON s2.id = m2.story_id
        WHERE s2.active AND s2.generated_at <= {S_TIME} AND s2.generated_at >= {S_TIME} - INTERVAL 12 HOUR) la
      ON la.arc_id = m.arc_id)"""


def computed(c) -> DataFrame:
    return story_ops.computed_arc_status(c.stories, c.signals, c.membership, s_as_of(), live_hours=12)


@query("story_summary", f"""WITH {COMPUTED},
    src AS (SELECT s.id, r.kind FROM (SELECT id, unnest(source_record_ids) AS rid FROM st) s
      JOIN core r ON r.id = CAST(s.rid AS BIGINT)),
    plat AS (SELECT id, array_to_string(list_sort(list(DISTINCT kind)), ',') AS source_platforms FROM src GROUP BY id)
    SELECT c.id, c.slug, c.type, c.topic_id, t.name AS topic_name, c.headline, c.entity_name,
      c.computed_arc_status AS arc_status, c.version, CAST(c.generated_at AS STRING) AS generated_at,
      p.source_platforms FROM comp c LEFT JOIN topics t ON t.id = c.topic_id LEFT JOIN plat p ON p.id = c.id
    WHERE c.active""")
def _(c):
    return story_ops.story_summary(computed(c).filter("active"), c.topics, c.core).select(
        "id", "slug", "type", "topic_id", "topic_name", "headline", "entity_name",
        F.col("computed_arc_status").alias("arc_status"), "version", "generated_at", "source_platforms",
    )


@query("record_summary", f"""WITH tt AS (SELECT record_id, array_to_string(list(concat(topic_id, ':', display_name) ORDER BY topic_id), ',') AS topics
      FROM (SELECT DISTINCT record_id, topic_id FROM ta) a JOIN topics t ON t.id = a.topic_id GROUP BY 1),
    te AS (SELECT record_id, entity_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY record_id
      ORDER BY confidence DESC, coalesce(start_offset, 2147483647), entity_id) AS rn FROM ment) WHERE rn = 1),
    d AS (SELECT DISTINCT CAST(rid AS BIGINT) AS rid FROM (SELECT unnest(source_record_ids) AS rid FROM st
      WHERE active AND type = 'dispatch'))
    SELECT r.id, r.kind, r.external_id, r.title, r.url, r.author, CAST(r.captured_at AS STRING) AS captured_at, r.sentiment_label, r.sentiment_score,
      r.category, r.content_type, r.publisher, substring(r.content_text, 1, 160) AS excerpt, tt.topics, e.name AS top_entity,
      CASE WHEN e.id IS NOT NULL THEN te.confidence END AS salience, d.rid IS NOT NULL AS has_dispatch
    FROM rec r LEFT JOIN tt ON tt.record_id = r.id LEFT JOIN te ON te.record_id = r.id
    LEFT JOIN ent e ON e.id = te.entity_id LEFT JOIN d ON d.rid = r.id""")
def _(c):
    topics = F.transform("topics", lambda t: F.concat(t["id"].cast("string"), F.lit(":"), t["display_name"]))
    return story_ops.record_summary(c.records, c.assignments, c.mentions, c.entities, c.stories, c.topics).select(
        "id", "kind", "external_id", "title", "url", "author", "captured_at", "sentiment_label", "sentiment_score", "category", "content_type",
        "publisher", "excerpt", topics.alias("topics"), F.col("top_entity.name").alias("top_entity"), F.col("top_entity.salience").alias("salience"),
        "has_dispatch",
    )


@query("signal_confidence", """SELECT id, severity, CASE severity WHEN 'low' THEN CAST(0.4 AS DOUBLE)
    WHEN 'medium' THEN 0.7 ELSE 0.9 END AS confidence FROM sig""")
def _(c):
    return c.signals.select("id", "severity", rules.severity_confidence(F.col("severity")).alias("confidence"))


@query("computed_arc_status", f"WITH {COMPUTED} SELECT id, arc_status, computed_arc_status FROM comp")
def _(c):
    return computed(c).select("id", "arc_status", "computed_arc_status")


@query("reading_time", r"""WITH w AS (SELECT id, len(string_split(trim(regexp_replace(content, '\s+', ' ', 'g')), ' ')) AS word_count
      FROM st) SELECT id, word_count, CAST(round(word_count / CAST(200 AS DOUBLE) * 60) AS BIGINT) AS reading_time_seconds FROM w""")
def _(c):
    words = c.stories.select("id", text.word_count(F.col("content")).alias("word_count"))
    return words.withColumn("reading_time_seconds", rules.reading_seconds(F.col("word_count")))


@query("seo_diagnostics", """SELECT page_type, page_id, version,
    CASE WHEN coalesce(length(seo_title), 0) = 0 THEN 'missing' WHEN length(seo_title) < 10 THEN 'too_short'
      WHEN length(seo_title) > 45 THEN 'too_long' ELSE 'ok' END AS seo_title,
    CASE WHEN coalesce(length(seo_description), 0) = 0 THEN 'missing' WHEN length(seo_description) < 50 THEN 'too_short'
      WHEN length(seo_description) > 145 THEN 'too_long' ELSE 'ok' END AS seo_description,
    CASE WHEN coalesce(length(og_title), 0) = 0 THEN 'missing' WHEN length(og_title) > 70 THEN 'too_long' ELSE 'ok' END AS og_title,
    CASE WHEN coalesce(length(og_description), 0) = 0 THEN 'missing' WHEN length(og_description) > 200 THEN 'too_long'
      ELSE 'ok' END AS og_description,
    CASE WHEN coalesce(len(keywords), 0) = 0 THEN 'missing' WHEN len(keywords) < 5 THEN 'too_short'
      WHEN len(keywords) > 10 THEN 'too_long' ELSE 'ok' END AS keywords FROM seo""")
def _(c):
    return story_ops.seo_diagnostics(c.seo).select(
        "page_type", "page_id", "version", *[f"{n}_status" for n in
        ("seo_title", "seo_description", "og_title", "og_description", "keywords")]
    ).withColumnsRenamed({f"{n}_status": n for n in
                          ("seo_title", "seo_description", "og_title", "og_description", "keywords")})


# ---- filters --------------------------------------------------------------------------------
@query("record_list", """SELECT id, kind, external_id, sentiment_label FROM core
    WHERE kind = 'hackernews' AND sentiment_label = 'positive' AND captured_at >= TIMESTAMP '2024-01-03 00:00:00'
      AND captured_at <= TIMESTAMP '2024-01-28 00:00:00' AND sentiment_score >= 0.3 AND sentiment_score <= 0.9
      AND id IN (SELECT record_id FROM ta WHERE topic_id = 3) AND id IN (SELECT record_id FROM ment WHERE entity_id = 4)
    UNION ALL SELECT id, kind, external_id, sentiment_label FROM core WHERE content_type = 'article'
      AND sentiment_score <= -0.5""")
def _(c):
    ts = lambda s: F.lit(s).cast("timestamp")
    narrow = reads.record_list(
        c.core, c.assignments, c.mentions, kind="hackernews", sentiment="positive", topic_id=3, entity_id=4,
        since=ts("2024-01-03 00:00:00"), until=ts("2024-01-28 00:00:00"), min_sentiment=0.3, max_sentiment=0.9,
    )
    wide = reads.record_list(c.core, content_type="article", max_sentiment=-0.5)
    return narrow.union(wide).select("id", "kind", "external_id", "sentiment_label")


_STORY_FILTER = f"active AND enriched_at IS NOT NULL AND computed_arc_status = 'developing' AND generated_at >= TIMESTAMP '2024-01-01 06:00:00'"


@query("story_list", f"""WITH {COMPUTED} SELECT id, type, topic_id, computed_arc_status FROM comp WHERE {_STORY_FILTER}
    UNION ALL SELECT id, type, topic_id, computed_arc_status FROM comp WHERE active AND type = 'entity_story'
      AND entity_name = 'NATION_4'""")
def _(c):
    s = computed(c)
    a = reads.story_list(s, arc_status="developing", enriched=True, since=F.lit("2024-01-01 06:00:00").cast("timestamp"))
    b = reads.story_list(s, type="entity_story", entity_name="NATION_4")
    return a.union(b).select("id", "type", "topic_id", "computed_arc_status")


@query("story_count", f"WITH {COMPUTED} SELECT count(*) AS n FROM comp WHERE {_STORY_FILTER}")
def _(c):
    return reads.story_list(
        computed(c), arc_status="developing", enriched=True, since=F.lit("2024-01-01 06:00:00").cast("timestamp")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("signal_list", """SELECT id, kind, topic_id, CAST(detected_at AS STRING) AS detected_at FROM sig
    WHERE id IN (SELECT signal_id FROM sigev WHERE target = 'entity' AND entity_id = 4)
      AND detected_at >= TIMESTAMP '2024-01-02 00:00:00'
    UNION ALL SELECT id, kind, topic_id, CAST(detected_at AS STRING) FROM sig WHERE kind = 'velocity' AND topic_id = 7""")
def _(c):
    a = reads.signal_list(c.signals, c.evidence, entity_id=4, since=F.lit("2024-01-02 00:00:00").cast("timestamp"))
    b = reads.signal_list(c.signals, kind="velocity", topic_id=7)
    return a.union(b).select("id", "kind", "topic_id", "detected_at")


@query("signal_feed", f"""SELECT id, kind, severity, CAST(detected_at AS STRING) AS detected_at FROM sig
    WHERE detected_at > {T_AS_OF} - INTERVAL 48 HOUR AND detected_at <= {T_AS_OF}""")
def _(c):
    return reads.signal_feed(c.signals, c.as_of, 48).select("id", "kind", "severity", "detected_at")


STATS = """es AS (SELECT e.id, e.name, e.type, e.indexability, count(m.entity_id) AS mention_count,
      min(m.captured_at) AS first_seen, max(m.captured_at) AS last_seen
    FROM ent e LEFT JOIN ment m ON m.entity_id = e.id GROUP BY ALL)"""


@query("entity_list", f"""WITH {STATS} SELECT id, name, type, mention_count FROM es
    WHERE type = 'organization' AND lower(name) LIKE '%nation~_1%' ESCAPE '~' AND mention_count >= 10""")
def _(c):
    s = rollups.entity_stats(c.entities, c.mentions)
    return reads.entity_list(s, name="nation_1", type="organization", min_mentions=10).select(
        "id", "name", "type", "mention_count"
    )


@query("keyword_scan", """SELECT id, kind FROM rec WHERE contains(lower(content_text), 'thon the')
    OR contains(lower(title), 'thon the')""")
def _(c):
    return reads.keyword_scan(c.records_text, "Thon The").select("id", "kind")


@query("record_by_id", "SELECT id, kind, external_id, author FROM core WHERE id = 421")
def _(c):
    return reads.by_id(c.core, 421).select("id", "kind", "external_id", "author")


@query("active_stories", "SELECT id, slug, version FROM st WHERE active")
def _(c):
    return c.active_stories.select("id", "slug", "version")


@query("worksets", """SELECT 'open_signals' AS workset, count(*) AS n FROM sig WHERE NOT acknowledged
    UNION ALL SELECT 'enabled_sources', count(*) FROM (SELECT DISTINCT kind FROM core WHERE category = 'article')
    UNION ALL SELECT 'unclassified_entities', count(*) FROM ent WHERE indexability IS NULL
    UNION ALL SELECT 'scheduled_stories', count(*) FROM st WHERE publish_at > TIMESTAMP '2024-01-31 00:00:00'
    UNION ALL SELECT 'stale_enrichment', count(*) FROM st WHERE active AND enriched_at IS NOT NULL AND enrichment_version < 2
    UNION ALL SELECT 'publisher_articles', count(*) FROM rec WHERE category = 'article' AND publisher IS NOT NULL""")
def _(c):
    sources = c.core.select("kind", (F.col("category") == "article").alias("enabled")).distinct()
    sets = reads.worksets(c.records_url, sources, c.entities, c.signals, c.stories, c.as_of, 2)
    return reduce(DataFrame.union, [
        f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("workset"), "n") for name, f in sets.items()
    ])


@query("publish_gate", """SELECT s.id, CASE WHEN v.quality_passed THEN 'passed' WHEN v.quality_passed IS NOT NULL THEN 'blocked'
    ELSE 'pending' END AS gate, coalesce(v.quality_passed, false) AS published
    FROM st s LEFT JOIN verd v ON v.conv_id = s.conv_id WHERE s.active""")
def _(c):
    return reads.publish_gate(c.stories, c.verdicts, "conv_id").select("id", "gate", "published")


@query("slug_lookup", f"""SELECT {slug('name')} AS slug, count(*) AS matches, min(id) AS first_id, max(id) AS last_id,
    array_to_string(list(id ORDER BY id), ',') AS ids,
    CASE WHEN count(*) = 1 THEN 'entity' ELSE 'disambiguation' END AS kind
    FROM (SELECT id, name FROM ent UNION ALL SELECT id + 1000, replace(name, '#', ' ') FROM ent WHERE type = 'technology')
    GROUP BY 1""")
def _(c):
    twin = c.entities.filter("type = 'technology'").select(
        (F.col("id") + 1000).alias("id"), F.regexp_replace("name", "#", " ").alias("name")
    )
    return reads.slug_lookup(c.entities.select("id", "name").union(twin))


@query("entity_slug", f"SELECT id, name, {slug('name')} AS slug FROM ent")
def _(c):
    return c.entities.select("id", "name", text.slug(F.col("name")).alias("slug"))


@query("public_entities", "SELECT id, name FROM ent WHERE indexability IS NULL OR indexability = 'index'")
def _(c):
    return reads.public_entities(c.entities).select("id", "name")


@query("seo_list", """SELECT page_type, page_id, version FROM seo WHERE NOT active AND page_type = 'story'
    UNION ALL SELECT page_type, page_id, version FROM seo WHERE active AND (contains(lower(page_id), 'on')
      OR contains(lower(seo_title), 'on'))""")
def _(c):
    a = reads.seo_list(c.seo, page_type="story", status="inactive")
    b = reads.seo_list(c.seo, q="ON")
    return a.union(b).select("page_type", "page_id", "version")


@query("sentiment_label", """SELECT CASE WHEN sentiment_score > 0.2 THEN 'positive' WHEN sentiment_score < -0.2 THEN 'negative'
    WHEN sentiment_score IS NOT NULL THEN 'neutral' END AS label, count(*) AS n FROM core GROUP BY 1""")
def _(c):
    return c.core.select(rules.sentiment_label(F.col("sentiment_score")).alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("dq_violations", f"""SELECT 'record_kind' AS rule, CAST(id AS STRING) AS key FROM core WHERE kind NOT IN ('arxiv','bluesky',
      'hackernews','google_news','reddit','twitter','youtube','exa')
    UNION ALL SELECT 'sentiment_range', CAST(id AS STRING) FROM core WHERE sentiment_score * 1.05 NOT BETWEEN -1 AND 1
    UNION ALL SELECT 'content_type', CAST(id AS STRING) FROM core WHERE content_type NOT IN ('post','comment','article')
    UNION ALL SELECT 'record_key', concat(kind, '/', external_id) FROM (SELECT 'hackernews' AS kind, CAST(id AS STRING) AS external_id
      FROM items) GROUP BY kind, external_id HAVING count(*) > 1
    UNION ALL SELECT 'mention_key', concat(entity_id, '/', record_id, '/', coalesce(CAST(start_offset AS STRING), '~')) FROM ment
      GROUP BY entity_id, record_id, start_offset HAVING count(*) > 1
    UNION ALL SELECT 'evidence_one_target', CAST(signal_id AS STRING) FROM (SELECT signal_id, record_id,
        CASE WHEN signal_id % 10 = 0 THEN 1 ELSE entity_id END AS entity_id, target_topic_id, story_id FROM sigev)
      WHERE (record_id IS NOT NULL)::INT + (entity_id IS NOT NULL)::INT + (target_topic_id IS NOT NULL)::INT
        + (story_id IS NOT NULL)::INT <> 1
    UNION ALL SELECT 'citation_record_xor_url', concat(story_id, '/', marker) FROM cit WHERE marker = 2 AND credibility_score > 0.5
    UNION ALL SELECT 'active_slug', slug FROM (SELECT slug FROM st WHERE version <= 2) GROUP BY slug HAVING count(*) > 1
    UNION ALL SELECT 'reference_orphan', ref_slug FROM refs WHERE ref_type = 'beat' AND ref_slug NOT IN (SELECT name FROM topics)
    UNION ALL SELECT 'topic_assignments_key', concat(record_id, '/', topic_id, '/', method) FROM ta GROUP BY record_id, topic_id, method HAVING count(*) > 1
    UNION ALL SELECT 'embeddings_key', concat(record_id, '/', model_name) FROM emb GROUP BY record_id, model_name HAVING count(*) > 1
    UNION ALL SELECT 'story_references_key', concat(story_id, '/', ref_type, '/', ref_slug) FROM (SELECT * FROM refs UNION ALL SELECT * FROM refs
      WHERE ref_type = 'beat') GROUP BY story_id, ref_type, ref_slug HAVING count(*) > 1
    UNION ALL SELECT 'story_arc_membership_key', story_id FROM arcm GROUP BY story_id HAVING count(*) > 1
    UNION ALL SELECT 'topics_key', name FROM topics GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT 'severity', CAST(id AS STRING) FROM sig WHERE severity NOT IN ('low','medium','high')""")
def _(c):
    ev = c.evidence.withColumn("entity_id", F.when(F.col("signal_id") % 10 == 0, 1).otherwise(F.col("entity_id")))
    bad_citations = c.citations.withColumn(
        "external_url", F.when((F.col("marker") == 2) & (F.col("credibility_score") > 0.5), "x").otherwise(F.col("external_url"))
    )
    items = c.items.select(F.lit("hackernews").alias("kind"), F.col("id").cast("string").alias("external_id"))
    key = F.col("id")
    return quality.violations(
        quality.breaking(c.core, "record_kind", key, quality.outside("kind", SOURCE_KINDS[:-1])),
        quality.breaking(c.core, "sentiment_range", key, F.abs(F.col("sentiment_score") * 1.05) > 1),
        quality.breaking(c.core, "content_type", key, quality.outside("content_type", CONTENT_TYPES)),
        quality.duplicates(items, "record_key", ["kind", "external_id"]),
        quality.duplicates(c.mentions, "mention_key", ["entity_id", "record_id", "start_offset"]),
        quality.one_target(ev), quality.citation_target(bad_citations),
        quality.duplicates(c.stories, "active_slug", ["slug"], F.col("version") <= 2),
        quality.orphans(
            c.references.filter("ref_type = 'beat'"), "reference_orphan", "ref_slug", c.topics, "name"
        ),
        *quality.unique_keys({
            "topic_assignments": c.assignments, "embeddings": c.embeddings, "topics": c.topics, "story_arc_membership": c.membership,
            "story_references": c.references.union(c.references.filter("ref_type = 'beat'")),
        }),
        quality.breaking(c.signals, "severity", key, quality.outside("severity", SEVERITIES)),
        quality.breaking(c.stories, "story_type", key, quality.outside("type", STORY_TYPES)),
        quality.breaking(c.stories, "arc_status", key, quality.outside("arc_status", ARC_STATUSES)),
    )


# ---- paging ---------------------------------------------------------------------------------
@query("records_page", f"""SELECT id, kind, CAST(row_number() OVER (ORDER BY id DESC) AS BIGINT) AS page_row,
    CAST({NE} - 99 - 50 AS STRING) AS next_cursor FROM (SELECT id, kind FROM core WHERE id < {NE} - 99 ORDER BY id DESC LIMIT 50)""")
def _(c):
    cursor = [c._top("events", "event_id") - 99]
    return paging.page(c.core.select("id", "kind"), ["id"], paging.parse_limit("50"), cursor)


@query("stories_page", """WITH p AS (SELECT id, generated_at FROM st WHERE active AND generated_at < TIMESTAMP '2024-01-03 00:00:00'
      ORDER BY generated_at DESC LIMIT 26), q AS (SELECT *, row_number() OVER (ORDER BY generated_at DESC) AS rn FROM p)
    SELECT id, rn AS page_row, CASE WHEN (SELECT count(*) FROM q) > 25 THEN
      (SELECT CAST(generated_at AS STRING) FROM q WHERE rn = 25) END AS next_cursor FROM q WHERE rn <= 25""")
def _(c):
    cursor = [F.lit("2024-01-03 00:00:00").cast("timestamp")]
    rows = c.active_stories.select("id", "generated_at")
    return paging.page(rows, ["generated_at"], paging.parse_limit(None), cursor).drop("generated_at")


@query("stories_public_page", """WITH p AS (SELECT id, coalesce(publish_at, generated_at) AS shown_at, type FROM st
      WHERE active AND coalesce(publish_at, generated_at) <= TIMESTAMP '2024-01-31 00:00:00' AND word_count >= 20),
    q AS (SELECT *, row_number() OVER (ORDER BY shown_at DESC, id DESC) AS rn FROM p)
    SELECT id, CAST(shown_at AS STRING) AS shown_at, rn AS page_row, CASE WHEN (SELECT count(*) FROM q) > 20 THEN
      (SELECT concat(CAST(shown_at AS STRING), '|', id) FROM q WHERE rn = 20) END AS next_cursor FROM q WHERE rn <= 20""".replace(
    "word_count >= 20", r"len(string_split(trim(regexp_replace(content, '\s+', ' ', 'g')), ' ')) >= 20"))
def _(c):
    shown = story_ops.public_stories(c.stories, c.as_of, stub_words=20)
    return paging.page(shown.select("id", "shown_at"), ["shown_at", "id"], 20)


@query("entities_page", f"""WITH {STATS}, a AS (SELECT *, row_number() OVER (ORDER BY last_seen DESC, id DESC) AS rn FROM es),
    b AS (SELECT *, row_number() OVER (ORDER BY mention_count DESC, id DESC) AS rn FROM es)
    SELECT 'last_seen' AS sort, id, rn AS page_row FROM a WHERE rn <= 20
    UNION ALL SELECT 'mentions_desc', id, rn FROM b WHERE rn <= 20""")
def _(c):
    s = rollups.entity_stats(c.entities, c.mentions)
    a = paging.page(s.select("id", "last_seen"), ["last_seen", "id"], 20)
    b = paging.page(s.select("id", "mention_count"), ["mention_count", "id"], 20)
    return a.select(F.lit("last_seen").alias("sort"), "id", "page_row").union(
        b.select(F.lit("mentions_desc"), "id", "page_row")
    )


@query("entity_slugs_page", f"""SELECT id, {slug('name')} AS slug, rn - 1 AS position, total,
    CASE WHEN 30 < total THEN 30 END AS next_offset FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn,
      count(*) OVER () AS total FROM ent) WHERE rn > 10 AND rn <= 30""")
def _(c):
    rows = c.entities.select("id", text.slug(F.col("name")).alias("slug"))
    return paging.offset_page(rows, "id", 10, 20)


@query("sitemap_pages", """SELECT page, count(*) AS count, page * 1000 AS offset, CAST(max(captured_at) AS STRING) AS lastmod
    FROM (SELECT captured_at, (row_number() OVER (ORDER BY id) - 1) // 1000 AS page FROM core WHERE category = 'article')
    GROUP BY page""")
def _(c):
    articles = c.core.filter("category = 'article'").select("id", "captured_at")
    return paging.sitemap_pages(articles, "id", "captured_at", 1000)


@query("topic_list", """SELECT t.id, t.name, t.display_name, t.cluster, c.record_count, c.active_story_count,
    CAST(c.last_record_at AS STRING) AS last_record_at FROM topics t LEFT JOIN (
      SELECT a.topic_id, count(DISTINCT a.record_id) AS record_count, max(r.captured_at) AS last_record_at,
        (SELECT count(*) FROM st WHERE active AND st.topic_id = a.topic_id) AS active_story_count
      FROM ta a JOIN core r ON r.id = a.record_id GROUP BY a.topic_id) c ON c.topic_id = t.id""")
def _(c):
    counts = rollups.topic_record_counts(c.assignments, c.core, c.stories)
    return c.topics.join(counts, c.topics.id == counts.topic_id, "left").select(
        "id", "name", "display_name", "cluster", "record_count", "active_story_count", "last_record_at"
    )


@query("topic_recent_records", """SELECT topic_id, id AS record_id, rn AS rank FROM (SELECT a.topic_id, r.id,
      row_number() OVER (PARTITION BY a.topic_id ORDER BY r.captured_at DESC, r.id DESC) AS rn
    FROM (SELECT DISTINCT topic_id, record_id FROM ta) a JOIN core r ON r.id = a.record_id) WHERE rn <= 5""")
def _(c):
    pairs = c.assignments.select("topic_id", F.col("record_id").alias("id")).distinct()
    rows = pairs.join(c.core.select("id", "captured_at"), "id")
    return paging.top_per_group(rows, ["topic_id"], [F.desc("captured_at"), F.desc("id")], 5).select(
        "topic_id", F.col("id").alias("record_id"), "rank"
    )
