"""Queries: signal detectors, evidence, severity, guards and saturation states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.functions.text import tokens as word_tokens
from agorascope.operators import rollups, signals, textual, vectorial
from agorascope.operators.alerts import signal_notify
from agorascope.plans.bindings import T_AS_OF, tokens
from agorascope.plans.read_queries import S_TIME, s_as_of
from agorascope.plans.registry import _ORACLES, query
from agorascope.plans.rollup_queries import DAYS, FIRST, GROWTH, GROWTH_RATE, LAST, TOPIC_PAIRS
from agorascope.plans.search_queries import DELTA, RECORD_TEXTS, grams, record_texts
from agorascope.session import stored

TR = f"tr AS (SELECT p.topic_id, r.* FROM {TOPIC_PAIRS} p JOIN core r ON r.id = p.record_id)"
TOPIC_DAYS = f"""{TR}, td AS (SELECT topic_id, CAST(captured_at AS DATE) AS d, count(*) AS n FROM tr GROUP BY 1, 2),
    tg AS (SELECT k.topic_id, CAST(x.d AS DATE) AS d, coalesce(td.n, 0) AS n FROM (SELECT DISTINCT topic_id FROM td) k CROSS JOIN {DAYS} x
      LEFT JOIN td ON td.topic_id = k.topic_id AND td.d = CAST(x.d AS DATE))"""


def topic_daily(c):
    return rollups.daily_counts(signals.topic_rows(c.assignments, c.core, "captured_at"), "topic_id")


@query("signal_velocity", f"""WITH {TOPIC_DAYS}, b AS (SELECT *, avg(n) OVER w AS base, count(*) OVER w AS bn FROM tg
      WINDOW w AS (PARTITION BY topic_id ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    a AS (SELECT *, n / greatest(base, 1.0) AS rate, date_diff('day', DATE '{FIRST}', d) - row_number() OVER (PARTITION BY topic_id ORDER BY d) AS isl
      FROM b WHERE bn = 7 AND n / greatest(base, 1.0) >= 1.02)
    SELECT topic_id, CAST(min(d) AS STRING) AS start_day, CAST(max(d) AS STRING) AS end_day, count(*) AS run_days, round(max(rate), 6) AS score,
      CAST(sum(n) AS BIGINT) AS evidence, 'velocity' AS kind FROM a GROUP BY topic_id, isl HAVING count(*) >= 2 AND sum(n) >= 3""")
def _(c):
    return signals.velocity(topic_daily(c), FIRST, LAST, ratio=1.02)


VOLUME = f"""v0 AS (SELECT kind, CAST(captured_at AS DATE) AS d, count(*) AS n FROM core GROUP BY 1, 2),
    v1 AS (SELECT k.kind, CAST(x.d AS DATE) AS d, coalesce(v0.n, 0) AS n FROM (SELECT DISTINCT kind FROM v0) k CROSS JOIN {DAYS} x
      LEFT JOIN v0 ON v0.kind = k.kind AND v0.d = CAST(x.d AS DATE)),
    v2 AS (SELECT *, avg(n) OVER w AS base, stddev_pop(n) OVER w AS dev, count(*) OVER w AS bn FROM v1
      WINDOW w AS (PARTITION BY kind ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    vol AS (SELECT kind, CAST(d AS STRING) AS day, n, round((n - base) / nullif(dev, 0), 6) AS score FROM v2 WHERE bn = 7
      AND greatest(n, base) >= 3 AND abs(round((n - base) / nullif(dev, 0), 6)) >= 1.5)"""


def volume(c):
    return signals.volume_anomaly(rollups.daily_counts(c.core, "kind"), "kind", FIRST, LAST)


@query("signal_volume_anomaly", f"""WITH {VOLUME} SELECT kind, day, n, score, CASE WHEN score > 0 THEN 'above' ELSE 'below' END AS direction,
    'volume_anomaly' AS signal_kind FROM vol""")
def _(c):
    return volume(c)


NOV_SPLIT, NOV_END = "2024-01-01 10:00:00", "2024-01-02 00:00:00"


def distances(c):
    rows = c.vectors.select("record_id", F.col("cluster").alias("topic_id"), "vector").join(
        c.core.select(F.col("id").alias("record_id"), "captured_at"), "record_id"
    )
    return vectorial.novelty(rows, F.lit(NOV_SPLIT).cast("timestamp"), F.lit(NOV_END).cast("timestamp"))


NOVELTY = f"""nv AS (SELECT v.vec_id, v.label AS topic_id, CAST(v.embedding AS DOUBLE[]) AS e, r.captured_at FROM embeddings v JOIN core r ON r.id = v.vec_id),
    nc AS (SELECT topic_id, list(a ORDER BY i) AS c FROM (SELECT topic_id, i, avg(x) AS a FROM (SELECT topic_id, unnest(e) AS x, unnest(range(0, 64)) AS i
      FROM nv WHERE captured_at <= TIMESTAMP '{NOV_SPLIT}') GROUP BY 1, 2) GROUP BY 1),
    nf AS (SELECT * FROM nv WHERE captured_at > TIMESTAMP '{NOV_SPLIT}' AND captured_at <= TIMESTAMP '{NOV_END}'),
    np AS (SELECT a.vec_id, avg(list_cosine_similarity(a.e, b.e)) AS m FROM nf a JOIN nf b ON b.topic_id = a.topic_id AND b.vec_id <> a.vec_id GROUP BY 1),
    nd AS (SELECT f.vec_id AS record_id, f.topic_id, round(1 - list_cosine_similarity(f.e, nc.c), 6) AS centroid_distance, round(1 - np.m, 6) AS recent_distance
      FROM nf f JOIN nc ON nc.topic_id = f.topic_id LEFT JOIN np ON np.vec_id = f.vec_id)"""


@query("novelty_distances", f"WITH {NOVELTY} SELECT * FROM nd")
def _(c):
    return distances(c).drop("captured_at")


@query("signal_novelty", f"""WITH {NOVELTY} SELECT topic_id, count(*) AS evidence, round(avg(least(centroid_distance, recent_distance)), 6) AS score,
    'novelty' AS kind FROM nd WHERE least(centroid_distance, recent_distance) >= 0.5 GROUP BY 1 HAVING count(*) >= 3""")
def _(c):
    return signals.novelty_signals(distances(c))


def sentiment_rows(c):
    return signals.topic_rows(c.assignments, c.core, "kind", "captured_at", "sentiment_score", "emotional_register")


_DIV = """pk AS (SELECT topic_id, kind, avg(sentiment_score) AS m, count(*) AS n FROM {src} WHERE sentiment_score IS NOT NULL GROUP BY 1, 2
      HAVING count(*) >= 3)
    SELECT topic_id, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS evidence, round(max(m) - min(m), 6) AS score,
      arg_max(kind, (m, kind)) AS most_positive, arg_min(kind, (m, kind)) AS most_negative, 'divergence' AS kind
    FROM pk GROUP BY topic_id HAVING count(*) >= 2 AND round(max(m) - min(m), 6) >= 0.2"""


@query("signal_divergence", f"WITH {TR}, {_DIV.format(src='tr')}")
def _(c):
    return signals.divergence(sentiment_rows(c))


@query("divergence_aligned", f"""WITH {TR}, lim AS (SELECT topic_id, min(t) AS t FROM (SELECT topic_id, kind, max(captured_at) AS t FROM tr GROUP BY 1, 2) GROUP BY 1),
    al AS (SELECT tr.* FROM tr JOIN lim ON lim.topic_id = tr.topic_id AND tr.captured_at <= lim.t), {_DIV.format(src='al')}""")
def _(c):
    return signals.divergence_aligned(sentiment_rows(c))


_WIN = f"captured_at > {T_AS_OF} - INTERVAL 14 DAY AND captured_at <= {T_AS_OF}"
_REC = f"captured_at > {T_AS_OF} - INTERVAL 7 DAY"


@query("signal_sentiment_shift", f"""WITH {TR}, s AS (SELECT topic_id, avg(sentiment_score) FILTER ({_REC}) AS r, avg(sentiment_score) FILTER (NOT ({_REC})) AS p,
      count_if({_REC}) AS evidence FROM tr WHERE sentiment_score IS NOT NULL AND {_WIN} GROUP BY 1)
    SELECT topic_id, evidence, round(r, 6) AS recent_mean, round(p, 6) AS prior_mean, round(r - p, 6) AS score, 'sentiment_shift' AS kind
    FROM s WHERE abs(round(r - p, 6)) >= 0.05 AND evidence >= 3""")
def _(c):
    return signals.sentiment_shift(sentiment_rows(c), c.as_of, 7, 7)


@query("signal_entity_surge", f"""SELECT entity_id, recent_mentions, baseline_mentions, {GROWTH_RATE} AS score, 'entity_surge' AS kind FROM ({GROWTH})
    WHERE {GROWTH_RATE} >= 1.0 AND recent_mentions >= 3""")
def _(c):
    return signals.entity_surge(c.mentions, c.as_of)


@query("signal_register_shift", f"""WITH {TR}, p AS (SELECT topic_id, emotional_register AS e, count_if({_REC}) AS r, count_if(NOT ({_REC})) AS p FROM tr WHERE {_WIN} GROUP BY 1, 2),
    t AS (SELECT *, sum(r) OVER (PARTITION BY topic_id) AS tr_, sum(p) OVER (PARTITION BY topic_id) AS tp FROM p),
    m AS (SELECT *, abs(r / CAST(tr_ AS DOUBLE) - p / CAST(tp AS DOUBLE)) AS mv FROM t WHERE tr_ > 0 AND tp > 0)
    SELECT topic_id, round(sum(mv) / 2, 6) AS score, CAST(max(tr_) AS BIGINT) AS evidence, arg_max(e, (mv, e)) AS most_changed, 'emotional_register_shift' AS kind
    FROM m GROUP BY topic_id HAVING round(sum(mv) / 2, 6) >= 0.05 AND max(tr_) >= 3""")
def _(c):
    return signals.register_shift(sentiment_rows(c), c.as_of, 7, 7)


@query("signal_key_phrase", f"""WITH {RECORD_TEXTS}, {grams('rtx', 'g', (2,))}, d AS ({DELTA.format(name='g', d=0.000002, m=3)})
    SELECT ngram, recent_n, baseline_n, round((recent_n / CAST(7 AS DOUBLE)) / ((baseline_n + CAST(1.0 AS DOUBLE)) / CAST(21 AS DOUBLE)), 6) AS score, 'key_phrase_trending' AS kind FROM d
    WHERE recent_n >= 5 AND round((recent_n / CAST(7 AS DOUBLE)) / ((baseline_n + CAST(1.0 AS DOUBLE)) / CAST(21 AS DOUBLE)), 6) >= 1.08""")
def _(c):
    deltas = textual.ngram_delta(record_texts(c), 2, 2, min_delta=0.000002)
    return signals.key_phrase(deltas, 1.08, 5).select("ngram", "recent_n", "baseline_n", "score", "kind")


@query("signal_cross_topic", f"""WITH {TOPIC_DAYS}, e AS (SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, count(DISTINCT a.record_id) AS shared_records
      FROM ta a JOIN ta b ON b.record_id = a.record_id AND a.topic_id < b.topic_id GROUP BY 1, 2 HAVING count(DISTINCT a.record_id) >= 2)
    SELECT e.topic_a, e.topic_b, e.shared_records, round(corr(x.n, y.n), 6) AS score, 'cross_topic_correlation' AS kind FROM e JOIN tg x ON x.topic_id = e.topic_a
    JOIN tg y ON y.topic_id = e.topic_b AND y.d = x.d GROUP BY 1, 2, 3 HAVING abs(round(corr(x.n, y.n), 6)) >= 0.2""")
def _(c):
    return signals.cross_topic(c.assignments, topic_daily(c), FIRST, LAST)


@query("signal_trend", f"""WITH {TOPIC_DAYS} SELECT topic_id, round(regr_slope(CAST(n AS DOUBLE), CAST(date_diff('day', DATE '{FIRST}', d) AS DOUBLE)), 6) AS score,
    CAST(sum(n) AS BIGINT) AS evidence, 'trend' AS kind FROM tg GROUP BY topic_id
    HAVING round(regr_slope(CAST(n AS DOUBLE), CAST(date_diff('day', DATE '{FIRST}', d) AS DOUBLE)), 6) > 0 AND sum(n) >= 3""")
def _(c):
    return signals.trend(topic_daily(c), FIRST, LAST)


@query("signal_evidence", f"""WITH {VOLUME}, p AS (
      SELECT concat(v.kind, '|', v.day) AS signal_key, 'record' AS target, r.id AS target_id, abs(coalesce(r.sentiment_score, 0)) + 0.5 AS w
      FROM vol v JOIN core r ON r.kind = v.kind AND CAST(CAST(r.captured_at AS DATE) AS STRING) = v.day
      UNION ALL SELECT concat(v.kind, '|', v.day), 'entity', m.entity_id, 0.25 FROM vol v
      JOIN core r ON r.kind = v.kind AND CAST(CAST(r.captured_at AS DATE) AS STRING) = v.day JOIN ment m ON m.record_id = r.id),
    g AS (SELECT signal_key, target, CAST(target_id AS BIGINT) AS target_id, sum(w) AS w FROM p GROUP BY 1, 2, 3),
    t AS (SELECT *, sum(w) OVER (PARTITION BY signal_key) AS s, count(*) OVER (PARTITION BY signal_key) AS evidence_count FROM g),
    x AS (SELECT signal_key, target, target_id, evidence_count, round(w / s, 12) AS weight, round(w / s * evidence_count, 4) AS r FROM t WHERE evidence_count >= 3)
    SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY signal_key ORDER BY r DESC, target, target_id) AS rank FROM x""")
def _(c):
    found = volume(c).select("kind", "day")
    rows = c.core.select("id", "kind", F.to_date("captured_at").alias("day"), "sentiment_score").join(found, ["kind", "day"])
    key = F.concat_ws("|", "kind", "day")
    mentioned = rows.select(F.col("id").alias("record_id"), "kind", "day").join(c.mentions.select("record_id", "entity_id"), "record_id")
    return signals.assemble_evidence([
        signals.evidence_part(rows, key, "record", F.col("id"), F.abs(F.coalesce("sentiment_score", F.lit(0.0))) + 0.5),
        signals.evidence_part(mentioned, key, "entity", F.col("entity_id"), F.lit(0.25)),
    ])


@query("signal_severity", f"""WITH {VOLUME} SELECT kind, day, score, round(abs(score) / (abs(score) + 1), 6) AS strength,
    CASE WHEN round(abs(score) / (abs(score) + 1), 6) >= 0.8 THEN 'high' WHEN round(abs(score) / (abs(score) + 1), 6) >= 0.5 THEN 'medium' ELSE 'low' END AS severity,
    concat(kind, '|', day) AS dedup_key FROM vol""")
def _(c):
    return signals.with_severity(volume(c), F.col("kind"), F.col("day")).select("kind", "day", "score", "strength", "severity", "dedup_key")


def _found(key: str, kind: str, subject: str, window: str, evidence: str, topic: str = "NULL", extra: str = "") -> str:
    return f"""SELECT '{kind}' AS kind, CAST({topic} AS BIGINT) AS topic_id, CAST({subject} AS STRING) AS subject, CAST({window} AS STRING) AS win, score,
        CAST({evidence} AS BIGINT) AS evidence FROM ({_ORACLES[key]}) {extra}"""


_DAY = f"'{LAST}'"
_FLOW = " UNION ALL ".join([
    _found("signal_velocity", "velocity", "topic_id", "end_day", "evidence", "topic_id"),
    _found("signal_volume_anomaly", "volume_anomaly", "kind", "day", "n"),
    _found("signal_novelty", "novelty", "topic_id", _DAY, "evidence", "topic_id"),
    _found("signal_divergence", "divergence", "topic_id", _DAY, "evidence", "topic_id"),
    _found("divergence_aligned", "platform_divergence", "topic_id", _DAY, "evidence", "topic_id"),
    _found("signal_sentiment_shift", "sentiment_shift", "topic_id", _DAY, "evidence", "topic_id"),
    _found("signal_entity_surge", "entity_surge", "entity_id", _DAY, "recent_mentions"),
    _found("signal_register_shift", "emotional_register_shift", "topic_id", _DAY, "evidence", "topic_id"),
    _found("signal_key_phrase", "key_phrase_trending", "ngram", _DAY, "recent_n"),
    _found("signal_cross_topic", "cross_topic_correlation", "concat(topic_a, '-', topic_b)", _DAY, "shared_records", "topic_a"),
    _found("signal_trend", "trend", "topic_id", _DAY, "evidence", "topic_id"),
])


@query("signal_flow", f"""WITH f AS ({_FLOW}), g AS (SELECT *, round(abs(score) / (abs(score) + 1), 6) AS strength, concat(subject, '|', win) AS dedup_key FROM f
      WHERE evidence >= 3 AND NOT (kind = 'trend' AND topic_id % 2 = 0))
    SELECT kind, topic_id, score, evidence, strength, CASE WHEN strength >= 0.8 THEN 'high' WHEN strength >= 0.5 THEN 'medium' ELSE 'low' END AS severity,
      dedup_key, row_number() OVER (PARTITION BY kind ORDER BY strength DESC, dedup_key, topic_id NULLS FIRST) AS rank FROM g""")
def _(c):
    parts, trends = _findings(c)
    known = trends.filter("topic_id % 2 = 0").select("kind", "topic_id", F.concat_ws("|", "subject", "window").alias("dedup_key"))
    return signals.signal_flow(parts, known).select("kind", "topic_id", "score", "evidence", "strength", "severity", "dedup_key", "rank")


def _findings(c):
    """The findings of all eleven detectors, and those of the trend detector on their own."""
    daily, rows, day, topic = topic_daily(c), sentiment_rows(c), F.lit(LAST), F.col("topic_id")
    deltas = textual.ngram_delta(record_texts(c), 2, 2, min_delta=0.000002)
    shape, evidence = signals.as_signals, F.col("evidence")
    trends = shape(signals.trend(daily, FIRST, LAST), "trend", topic, day, evidence, topic)
    return [
        shape(signals.velocity(daily, FIRST, LAST, ratio=1.02), "velocity", topic, F.col("end_day"), evidence, topic),
        shape(volume(c), "volume_anomaly", F.col("kind"), F.col("day"), F.col("n")),
        shape(signals.novelty_signals(distances(c)), "novelty", topic, day, evidence, topic),
        shape(signals.divergence(rows), "divergence", topic, day, evidence, topic),
        shape(signals.divergence_aligned(rows), "platform_divergence", topic, day, evidence, topic),
        shape(signals.sentiment_shift(rows, c.as_of, 7, 7), "sentiment_shift", topic, day, evidence, topic),
        shape(signals.entity_surge(c.mentions, c.as_of), "entity_surge", F.col("entity_id"), day, F.col("recent_mentions")),
        shape(signals.register_shift(rows, c.as_of, 7, 7), "emotional_register_shift", topic, day, evidence, topic),
        shape(signals.key_phrase(deltas, 1.08, 5), "key_phrase_trending", F.col("ngram"), day, F.col("recent_n")),
        shape(
            signals.cross_topic(c.assignments, daily, FIRST, LAST), "cross_topic_correlation", F.concat_ws("-", "topic_a", "topic_b"), day,
            F.col("shared_records"), F.col("topic_a"),
        ),
        trends,
    ], trends


_SCOPES = """CASE kind WHEN 'volume_anomaly' THEN 'kind' WHEN 'entity_surge' THEN 'entity' WHEN 'key_phrase_trending' THEN 'phrase' ELSE 'topic' END"""


@query("signal_evidence_all", f"""WITH f AS ({_FLOW}), a AS (SELECT concat(kind, '|', subject, '|', win) AS signal_key, {_SCOPES} AS scope,
      unnest(CASE WHEN kind = 'cross_topic_correlation' THEN string_split(subject, '-') ELSE [subject] END) AS value, CAST(win AS DATE) AS last,
      CASE WHEN kind = 'volume_anomaly' THEN 1 ELSE 7 END AS days FROM f WHERE evidence >= 3),
    c AS (SELECT id, doc_id, kind, CAST(captured_at AS DATE) AS day FROM core), w AS (SELECT doc_id, {tokens('text')} AS w FROM documents),
    b AS (SELECT DISTINCT doc_id, concat(w[i], ' ', w[i + 1]) AS value FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
    m AS (SELECT DISTINCT 'topic' AS scope, CAST(topic_id AS STRING) AS value, c.id AS record_id, day FROM ta JOIN c ON c.id = ta.record_id
      UNION ALL SELECT 'kind', kind, id, day FROM c UNION ALL SELECT DISTINCT 'entity', CAST(entity_id AS STRING), c.id, day FROM ment JOIN c ON c.id = ment.record_id
      UNION ALL SELECT 'phrase', b.value, c.id, day FROM b JOIN c ON c.doc_id = b.doc_id WHERE b.value IN (SELECT value FROM a WHERE scope = 'phrase')),
    r AS (SELECT DISTINCT a.signal_key, m.record_id FROM a JOIN m ON m.scope = a.scope AND m.value = a.value AND m.day <= a.last AND m.day > a.last - a.days),
    p AS (SELECT signal_key, 'record' AS target, CAST(record_id AS STRING) AS target_id, CAST(0.5 AS DOUBLE) AS w FROM r
      UNION ALL SELECT signal_key, 'entity', CAST(entity_id AS STRING), 0.25 FROM r JOIN (SELECT DISTINCT record_id, entity_id FROM ment) x USING (record_id)
      UNION ALL SELECT signal_key, 'topic', CAST(topic_id AS STRING), 0.125 FROM r JOIN (SELECT DISTINCT record_id, topic_id FROM ta) x USING (record_id)
      UNION ALL SELECT signal_key, 'story', id, 0.25 FROM r JOIN (SELECT DISTINCT id, CAST(rid AS BIGINT) AS record_id FROM (SELECT id, unnest(source_record_ids) AS rid FROM st WHERE active)) x
        USING (record_id)),
    g AS (SELECT signal_key, target, target_id, sum(w) AS w FROM p GROUP BY 1, 2, 3),
    t AS (SELECT *, sum(w) OVER (PARTITION BY signal_key) AS s, count(*) OVER (PARTITION BY signal_key) AS evidence_count FROM g),
    x AS (SELECT signal_key, target, target_id, evidence_count, round(w / s, 12) AS weight, round(w / s * evidence_count, 4) AS r FROM t WHERE evidence_count >= 3)
    SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY signal_key ORDER BY r DESC, target, target_id) AS rank FROM x""")
def _(c):
    """Evidence of the signals of all eleven kinds, on records, entities, topics and stories."""
    found = stored(reduce(DataFrame.unionByName, _findings(c)[0]).filter("evidence >= 3"), "found")
    several = F.when(F.col("kind") == "cross_topic_correlation", F.split("subject", "-")).otherwise(F.array("subject"))
    asked = found.select(
        F.concat_ws("|", "kind", "subject", "window").alias("signal_key"), F.expr(_SCOPES).alias("scope"), F.explode(several).alias("value"),
        F.col("window").cast("date").alias("last"), F.when(F.col("kind") == "volume_anomaly", 1).otherwise(7).alias("days"),
    )
    core = c.core.select("id", "doc_id", "kind", F.to_date("captured_at").alias("day"))

    def linked(links, scope: str, column: str):
        own = links.select(F.col(column).cast("string").alias("value"), F.col("record_id")).distinct()
        return own.join(core.select(F.col("id").alias("record_id"), "day"), "record_id").select(F.lit(scope).alias("scope"), "value", "record_id", "day")

    phrases = asked.filter("scope = 'phrase'").select("value").distinct()
    pairs = textual.phrase_holders(c.documents, phrases, 2)
    said = pairs.join(core, "doc_id").select(F.lit("phrase").alias("scope"), "value", F.col("id").alias("record_id"), "day")
    kinds = core.select(F.lit("kind").alias("scope"), F.col("kind").alias("value"), F.col("id").alias("record_id"), "day")
    membership = kinds.union(linked(c.assignments, "topic", "topic_id")).union(linked(c.mentions, "entity", "entity_id")).union(said)
    return signals.evidence_of_signals(asked, membership, c.mentions, c.assignments, c.stories)


@query("signal_guards", """WITH w AS (SELECT p.topic_id, a.id, epoch(a.ingested_at) - epoch(a.captured_at) <= 86400 AS live, v.vec_id IS NOT NULL AS emb
      FROM (SELECT DISTINCT topic_id, record_id FROM ta) p JOIN arrivals a ON a.id = p.record_id LEFT JOIN embeddings v ON v.vec_id = a.id
      WHERE a.captured_at > TIMESTAMP '2024-01-01 00:00:00' AND a.captured_at <= TIMESTAMP '2024-01-03 00:00:00'),
    s AS (SELECT topic_id, count(*) AS records, count_if(NOT live) AS backfilled, round(count_if(live AND emb) / nullif(CAST(count_if(live) AS DOUBLE), 0), 6) AS embedded_share
      FROM w GROUP BY 1)
    SELECT *, coalesce(embedded_share >= 0.6, false) AS ready FROM s""")
def _(c):
    return signals.signal_guards(
        c.arrivals, c.assignments, c.vectors, F.lit("2024-01-03 00:00:00").cast("timestamp"), 2, min_share=0.6
    )


@query("thin_beats", f"""WITH {TR} SELECT topic_id, count(*) AS records, count(DISTINCT kind) AS kinds FROM tr WHERE captured_at > TIMESTAMP '2024-01-29 12:00:00'
    GROUP BY 1 HAVING count(*) < 500 OR count(DISTINCT kind) < 9""")
def _(c):
    recent = c.core.filter(F.col("captured_at") > F.lit("2024-01-29 12:00:00").cast("timestamp"))
    return signals.thin_beats(signals.topic_rows(c.assignments, recent, "kind"), 500, 9)


@query("signal_saturation_gate", f"""WITH rs AS (SELECT * FROM st WHERE generated_at > {S_TIME} - INTERVAL 4 DAY AND generated_at <= {S_TIME}),
    u AS (SELECT DISTINCT topic_id, CAST(unnest(source_record_ids) AS BIGINT) AS rid FROM rs),
    f AS (SELECT g.id, count(DISTINCT e.record_id) AS n FROM sig g JOIN sigev e ON e.signal_id = g.id AND e.record_id IS NOT NULL
      WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.rid = e.record_id AND u.topic_id IS NOT DISTINCT FROM g.topic_id) GROUP BY 1)
    SELECT g.id, g.topic_id, coalesce(f.n, 0) AS new_evidence, g.topic_id IN (SELECT topic_id FROM rs) IS TRUE AND coalesce(f.n, 0) = 0 AS suppressed
    FROM sig g LEFT JOIN f ON f.id = g.id""")
def _(c):
    return signals.saturation_gate(c.signals, c.evidence, c.stories, s_as_of(), 4).select("id", "topic_id", "new_evidence", "suppressed")


@query("entity_novelty_active", """SELECT id, name, id IN (SELECT e.entity_id FROM sigev e JOIN sig s ON s.id = e.signal_id WHERE e.target = 'entity'
    AND s.kind = 'novelty' AND NOT s.acknowledged) AS novelty_active FROM ent""")
def _(c):
    evidence = c.evidence
    return signals.entity_novelty_active(c.entities.select("id", "name"), c.signals, evidence)


@query("seeding_score", f"""WITH {TR}, b AS (SELECT tr.topic_id, CAST(tr.captured_at AS DATE) AS d, tr.author, md5(d.text) AS h FROM tr JOIN documents d ON d.doc_id = tr.doc_id),
    c1 AS (SELECT topic_id, d, sum(n) AS records, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS dup FROM (SELECT topic_id, d, h, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1, 2),
    a1 AS (SELECT topic_id, d, sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) AS hh FROM (SELECT topic_id, d, author, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1, 2)
    SELECT c1.topic_id, CAST(c1.d AS STRING) AS day, CAST(records AS BIGINT) AS records, round(dup / CAST(records AS DOUBLE), 6) AS copy_share,
      round(hh, 6) AS author_concentration FROM c1 JOIN a1 ON a1.topic_id = c1.topic_id AND a1.d = c1.d""")
def _(c):
    hashes = c.table("documents").select("doc_id", F.md5("text").alias("text_hash"))
    rows = signals.topic_rows(c.assignments, c.core, "doc_id", "captured_at", "author").join(hashes, "doc_id")
    return signals.seeding_score(rows.withColumn("day", F.to_date("captured_at")))


WORDS = f"""w0 AS (SELECT date_diff('day', DATE '{FIRST}', CAST(generated_at AS DATE)) AS window_no, unnest({tokens('content')}) AS token FROM st),
    w1 AS (SELECT window_no, token, count(*) AS n FROM w0 GROUP BY 1, 2),
    wt AS (SELECT *, sum(t) OVER (ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tb FROM (SELECT window_no, sum(n) AS t FROM w1 GROUP BY 1)),
    wf AS (SELECT token FROM w1 GROUP BY 1 HAVING sum(n) >= 20),
    wg AS (SELECT f.token, wt.window_no, coalesce(w1.n, 0) AS n, t, tb FROM wf f CROSS JOIN wt LEFT JOIN w1 ON w1.token = f.token AND w1.window_no = wt.window_no),
    wb AS (SELECT *, sum(n) OVER (PARTITION BY token ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
      row_number() OVER (PARTITION BY token ORDER BY window_no) AS rn FROM wg),
    wr AS (SELECT token, window_no, rn, coalesce(CASE WHEN b > 0 THEN round((n / CAST(t AS DOUBLE)) / (CAST(b AS DOUBLE) / CAST(tb AS DOUBLE)), 6) END, 0) AS r FROM wb)"""


def _step(state: str) -> str:
    return f"""CASE {state} WHEN 'untracked' THEN CASE WHEN wr.r >= 1.2 THEN 'monitored' ELSE 'untracked' END
      WHEN 'monitored' THEN CASE WHEN wr.r >= 2.0 THEN 'saturated' WHEN wr.r < 1.2 THEN 'untracked' ELSE 'monitored' END
      ELSE CASE WHEN wr.r < 2.0 THEN 'monitored' ELSE 'saturated' END END"""


def word_windows(c):
    day = F.datediff(F.to_date("generated_at"), F.lit(FIRST).cast("date"))
    return c.stories.select(day.alias("window_no"), F.explode(word_tokens(F.col("content"))).alias("token")).groupBy(
        "window_no", "token"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("saturation_states", f"""WITH RECURSIVE {WORDS},
    f AS (SELECT token, rn, window_no, {_step("'untracked'")} AS state FROM wr WHERE rn = 1
      UNION ALL SELECT wr.token, wr.rn, wr.window_no, {_step('f.state')} FROM f JOIN wr ON wr.token = f.token AND wr.rn = f.rn + 1)
    SELECT token, window_no, CASE WHEN state = 'saturated' AND token IN (SELECT unnest(keywords) FROM topics) THEN 'removed' ELSE state END AS state FROM f""")
def _(c):
    shares = signals.token_shares(word_windows(c), 20)
    return signals.saturation_states(shares, c.topics.select(F.explode("keywords").alias("token")))


@query("saturation_delta", f"""WITH RECURSIVE {WORDS}, x AS (SELECT DISTINCT token, window_no FROM wr WHERE r >= 1.2),
    lastw AS (SELECT max(window_no) AS m FROM wr), a AS (SELECT token FROM x, lastw WHERE window_no = m - 1), b AS (SELECT token FROM x, lastw WHERE window_no = m)
    SELECT coalesce(a.token, b.token) AS token, CASE WHEN a.token IS NULL THEN 'added' WHEN b.token IS NULL THEN 'removed' ELSE 'kept' END AS change
    FROM a FULL JOIN b ON a.token = b.token""")
def _(c):
    from agorascope.operators.dedup import saturation_delta

    high = signals.token_shares(word_windows(c), 20).filter(F.col("ratio") >= 1.2)
    last = c.stories.agg(F.datediff(F.to_date(F.max("generated_at")), F.lit(FIRST).cast("date"))).scalar()
    rows = high.withColumn("_last", last)
    return saturation_delta(rows, F.col("window_no") == F.col("_last") - 1, F.col("window_no") == F.col("_last"))


@query("signal_notify", """SELECT id, concat('{"signalId":', id, ',"kind":"', kind, '","severity":"', severity, '","score":', CAST(score AS STRING),
      ',"headline":"', headline, '","topicId":', coalesce(CAST(topic_id AS STRING), 'null'), ',"detectedAt":"',
      strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%gZ'), '"}') AS payload,
    CAST(strlen(concat('{"signalId":', id, ',"kind":"', kind, '","severity":"', severity, '","score":', CAST(score AS STRING),
      ',"headline":"', headline, '","topicId":', coalesce(CAST(topic_id AS STRING), 'null'), ',"detectedAt":"',
      strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%gZ'), '"}')) AS BIGINT) AS bytes, true AS fits FROM sig""")
def _(c):
    return signal_notify(c.signals)
