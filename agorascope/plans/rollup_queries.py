"""Queries: aggregations, rollups and window functions over rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorascope.operators import rollups
from agorascope.plans.bindings import T_AS_OF, slug
from agorascope.plans.read_queries import STATS
from agorascope.plans.registry import query
from agorascope.session import fresh_dir

FIRST, LAST = "2024-01-01", "2024-01-30"
DAYS = f"(SELECT unnest(range(DATE '{FIRST}', DATE '2024-01-31', INTERVAL 1 DAY)) AS d)"
PAIRS = "(SELECT DISTINCT entity_id, record_id FROM ment)"
TOPIC_PAIRS = "(SELECT DISTINCT topic_id, record_id FROM ta)"
DAY = "CAST(captured_at AS DATE)"
SENT_DAILY = f"""SELECT CAST({DAY} AS STRING) AS bucket_date, kind, round(avg(sentiment_score), 6) AS avg_score,
    count(*) AS record_count FROM core WHERE sentiment_score IS NOT NULL GROUP BY 1, 2"""


@query("sentiment_daily", SENT_DAILY)
def _(c):
    return rollups.sentiment_daily(c.core)


@query("source_daily", f"SELECT CAST({DAY} AS STRING) AS bucket_date, kind, count(*) AS record_count FROM core GROUP BY 1, 2")
def _(c):
    return rollups.source_daily(c.core)


_RECENT = f"""count(*) AS total_records, count_if(captured_at > {T_AS_OF} - INTERVAL 24 HOUR) AS last24h_records,
    count_if(captured_at > {T_AS_OF} - INTERVAL 7 DAY) AS last7d_records"""


@query("source_kind_rollup", f"SELECT kind, {_RECENT} FROM core GROUP BY kind")
def _(c):
    return rollups.recent_counts(c.core, ["kind"], c.as_of)


@query("source_stats", f"SELECT source_config_id, kind, concat(kind, '-main') AS name, {_RECENT} FROM core GROUP BY 1, 2, 3")
def _(c):
    return rollups.recent_counts(c.core, ["source_config_id", "kind"], c.as_of).withColumn(
        "name", F.concat("kind", F.lit("-main"))
    )


@query("topic_record_counts", """SELECT a.topic_id, count(DISTINCT a.record_id) AS record_count,
    CAST(max(r.captured_at) AS STRING) AS last_record_at,
    (SELECT count(*) FROM st WHERE active AND st.topic_id = a.topic_id) AS active_story_count
    FROM ta a JOIN core r ON r.id = a.record_id GROUP BY a.topic_id""")
def _(c):
    return rollups.topic_record_counts(c.assignments, c.core, c.stories)


@query("entity_mention_daily", f"SELECT CAST({DAY} AS STRING) AS bucket_date, entity_id, count(*) AS mention_count FROM ment GROUP BY 1, 2")
def _(c):
    return rollups.entity_mention_daily(c.mentions)


SOURCE_COUNTS = f"SELECT p.entity_id, r.kind, count(*) AS record_count FROM {PAIRS} p JOIN core r ON r.id = p.record_id GROUP BY 1, 2"


@query("entity_source_counts", SOURCE_COUNTS)
def _(c):
    return rollups.entity_source_counts(c.mentions, c.core)


@query("entity_stats", f"""WITH {STATS} SELECT id, name, mention_count, CAST(first_seen AS STRING) AS first_seen,
    CAST(last_seen AS STRING) AS last_seen FROM es""")
def _(c):
    return rollups.entity_stats(c.entities, c.mentions).select("id", "name", "mention_count", "first_seen", "last_seen")


@query("topic_sentiment", f"""SELECT p.topic_id, r.kind, count(*) FILTER (sentiment_label = 'positive') AS positive,
    count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'negative') AS negative, count(*) AS total
    FROM {TOPIC_PAIRS} p JOIN core r ON r.id = p.record_id WHERE r.captured_at > {T_AS_OF} - INTERVAL 14 DAY GROUP BY 1, 2""")
def _(c):
    return rollups.topic_sentiment(c.assignments, c.core, c.as_of, 14)


@query("topic_entities", f"""SELECT p.topic_id, m.entity_id, e.name, e.type, count(*) AS mention_count
    FROM {TOPIC_PAIRS} p JOIN ment m ON m.record_id = p.record_id JOIN ent e ON e.id = m.entity_id GROUP BY ALL""")
def _(c):
    return rollups.topic_entities(c.assignments, c.mentions, c.entities)


@query("topic_distribution", f"""SELECT topic_id, concat('Topic ', topic_id) AS topic_name, count(*) AS record_count,
    round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM {TOPIC_PAIRS} GROUP BY topic_id""")
def _(c):
    return rollups.topic_distribution(c.assignments, c.topics).withColumn("share", F.round("share", 6))


@query("entity_topic_mix", f"""SELECT p.entity_id, t.topic_id, count(*) AS record_count FROM {PAIRS} p
    JOIN {TOPIC_PAIRS} t ON t.record_id = p.record_id GROUP BY 1, 2""")
def _(c):
    return rollups.entity_topic_mix(c.mentions, c.assignments)


@query("entity_source_mix", f"""SELECT entity_id, string_agg(concat(kind, ':', record_count), ',' ORDER BY record_count DESC, kind)
    AS source_mix FROM ({SOURCE_COUNTS}) GROUP BY entity_id""")
def _(c):
    return rollups.entity_source_mix(rollups.entity_source_counts(c.mentions, c.core))


@query("entity_sentiment_dist", f"""SELECT p.entity_id, count(*) FILTER (sentiment_label = 'positive') AS positive,
    count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'negative') AS negative,
    count_if(sentiment_label IS NULL) AS unknown FROM {PAIRS} p JOIN core r ON r.id = p.record_id GROUP BY 1""")
def _(c):
    return rollups.entity_sentiment(c.mentions, c.core)


@query("entity_sentiment_trend", f"""SELECT p.entity_id, CAST(CAST(date_trunc('week', r.captured_at) AS DATE) AS STRING) AS week_start,
    round(avg(sentiment_score), 6) AS avg_score, count(*) AS sample_size FROM {PAIRS} p JOIN core r ON r.id = p.record_id GROUP BY 1, 2""")
def _(c):
    return rollups.entity_sentiment_trend(c.mentions, c.core)


@query("source_diversity", f"""WITH sc AS ({SOURCE_COUNTS}), t AS (SELECT *, sum(record_count) OVER (PARTITION BY entity_id) AS n FROM sc)
    SELECT entity_id, count(*) AS distinct_sources, round(sum((100.0 * record_count / CAST(n AS DOUBLE)) ** 2), 4) AS herfindahl_index
    FROM t GROUP BY entity_id""")
def _(c):
    return rollups.source_diversity(rollups.entity_source_counts(c.mentions, c.core))


@query("stats_timeline", f"""SELECT CAST(CAST(d AS DATE) AS STRING) AS date, count(r.id) AS count FROM {DAYS} x
    LEFT JOIN core r ON CAST(r.captured_at AS DATE) = CAST(x.d AS DATE) GROUP BY 1""")
def _(c):
    return rollups.stats_timeline(c.spark, c.core, FIRST, LAST)


@query("sentiment_timeline", f"SELECT * FROM ({SENT_DAILY}) ORDER BY 1, 2")
def _(c):
    daily = rollups.sentiment_daily(c.core)
    path = fresh_dir(c.spark, "sentiment-daily")
    daily.write.partitionBy("kind").parquet(path)  # the rollup is stored once; timelines read it
    stored = c.spark.read.schema(daily.schema).parquet(path).select(*daily.columns)
    return stored.orderBy("bucket_date", "kind")


@query("mention_timeline", f"""SELECT e.id AS entity_id, CAST(CAST(x.d AS DATE) AS STRING) AS date, count(m.record_id) AS count
    FROM ent e CROSS JOIN {DAYS} x LEFT JOIN ment m ON m.entity_id = e.id AND CAST(m.captured_at AS DATE) = CAST(x.d AS DATE)
    GROUP BY 1, 2""")
def _(c):
    return rollups.mention_timeline(
        rollups.entity_mention_daily(c.mentions), c.entities.select(F.col("id").alias("entity_id")), FIRST, LAST
    )


GROWTH = f"""SELECT entity_id, count_if(captured_at > {T_AS_OF} - INTERVAL 7 DAY) AS recent_mentions,
      count_if(captured_at <= {T_AS_OF} - INTERVAL 7 DAY) AS baseline_mentions FROM ment
    WHERE captured_at > {T_AS_OF} - INTERVAL 28 DAY AND captured_at <= {T_AS_OF} GROUP BY entity_id"""
GROWTH_RATE = "round((recent_mentions / CAST(7 AS DOUBLE)) / greatest(baseline_mentions / CAST(21 AS DOUBLE), 0.1), 6)"


@query("trending_entities", f"""SELECT g.entity_id, e.name, e.type, {slug('e.name')} AS slug, recent_mentions, baseline_mentions,
    {GROWTH_RATE} AS growth_factor FROM ({GROWTH}) g JOIN ent e ON e.id = g.entity_id
    ORDER BY {GROWTH_RATE} DESC, g.entity_id LIMIT 20""")
def _(c):
    return rollups.trending_entities(c.mentions, c.entities, c.as_of)


@query("related_entities", f"""SELECT b.entity_id, count(*) AS shared_record_count FROM {PAIRS} a JOIN {PAIRS} b
    ON b.record_id = a.record_id AND b.entity_id <> a.entity_id WHERE a.entity_id = 4 GROUP BY 1""")
def _(c):
    return rollups.related_entities(c.mentions, 4)


@query("prominence_rank", f"""WITH {STATS} SELECT id, type, mention_count, count(*) OVER (PARTITION BY type) AS sample_size,
    CASE WHEN count(*) OVER (PARTITION BY type) >= 5
      THEN round(percent_rank() OVER (PARTITION BY type ORDER BY mention_count) * 100, 4) END AS within_type FROM es""")
def _(c):
    stats = rollups.entity_stats(c.entities, c.mentions).select("id", "type", "mention_count")
    return rollups.prominence_rank(stats)


@query("rolling_baseline", f"""WITH n AS (SELECT kind, {DAY} AS d, count(*) AS n FROM core GROUP BY 1, 2),
    g AS (SELECT k.kind, CAST(x.d AS DATE) AS d, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT kind FROM n) k CROSS JOIN {DAYS} x
      LEFT JOIN n ON n.kind = k.kind AND n.d = CAST(x.d AS DATE))
    SELECT kind, CAST(d AS STRING) AS day, n, round(avg(n) OVER w, 6) AS baseline, round(stddev_pop(n) OVER w, 6) AS deviation,
      count(*) OVER w AS baseline_n FROM g WINDOW w AS (PARTITION BY kind ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def _(c):
    b = rollups.rolling_baseline(rollups.daily_counts(c.core, "kind"), "kind", FIRST, LAST)
    return b.withColumns({"baseline": F.round("baseline", 6), "deviation": F.round("deviation", 6)})


@query("corpus_cube", f"""SELECT CAST(d AS STRING) AS day, kind, grouping_id(d, kind) AS level, count(*) AS n,
    round(avg(sentiment_score), 6) AS avg_score FROM (SELECT {DAY} AS d, kind, sentiment_score FROM core)
    GROUP BY GROUPING SETS ((d), (d, kind), (kind), ())""")
def _(c):
    return rollups.corpus_cube(c.core)


@query("quota_usage", """WITH m AS (SELECT key_id, tier, seats, date_trunc('minute', called_at) AS mi, count(*) AS n FROM usage GROUP BY ALL),
    d AS (SELECT key_id, tier, seats, CAST(mi AS DATE) AS dy, CAST(sum(n) AS BIGINT) AS calls, max(n) AS peak_minute FROM m GROUP BY ALL)
    SELECT d.key_id, d.tier, CAST(dy AS STRING) AS day, calls, peak_minute, per_day * seats AS day_limit,
      CASE WHEN per_day IS NULL THEN 'unlimited' WHEN hard_day AND calls > per_day * seats THEN 'blocked'
        WHEN NOT hard_day AND calls >= per_day * seats * 0.8 THEN 'warned' ELSE 'ok' END AS day_state,
      coalesce(peak_minute > per_minute * seats, false) AS minute_blocked FROM d LEFT JOIN tiers t ON t.tier = d.tier""")
def _(c):
    return rollups.quota_usage(c.usage, rollups.tier_table(c.spark))


@query("webhook_health", """SELECT endpoint_id, count(*) AS attempts, count_if(status_code >= 400) AS failure_count,
    CAST(max(attempted_at) FILTER (status_code < 400) AS STRING) AS last_success_at,
    CAST(max(attempted_at) FILTER (status_code >= 400) AS STRING) AS last_failure_at FROM deliv GROUP BY endpoint_id""")
def _(c):
    return rollups.webhook_health(c.deliveries)


@query("history_retention", """SELECT u.tier, count(*) AS kept FROM usage u JOIN tiers t ON t.tier = u.tier
    WHERE t.history_days IS NULL OR u.called_at >= TIMESTAMP '2024-02-14 00:00:00' - to_days(t.history_days) GROUP BY u.tier""")
def _(c):
    kept = rollups.history_retention(c.usage, rollups.tier_table(c.spark), F.lit("2024-02-14 00:00:00").cast("timestamp"))
    return kept.groupBy("tier").agg(rollups.n_rows().alias("kept"))


@query("generation_audit", """SELECT generation_model, enrichment_version, count(*) AS stories, count_if(active) AS active_stories
    FROM st GROUP BY 1, 2""")
def _(c):
    return rollups.generation_audit(c.stories)
