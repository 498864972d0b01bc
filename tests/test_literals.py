"""Literal edge cases of the coded rules."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from agorascope.functions import rules, text, vectors
from agorascope.operators import dedup, ingest, paging, quality, rollups, stories


def values(frame, column="v"):
    return [r[column] for r in frame.select(column).collect()]


def test_hosts(spark):
    cases = {
        "https://WWW.Example.ORG/a": "example.org", "http://user:pw@host.example.com:8080/x": "host.example.com",
        "https://example.com/a path": "example.com", "www.example.com/x": None, "": None, None: None, "mailto:a@b.c": None,
        "https://exa mple.com/": None, "https://example.com:99999999/": None, "HTTPS://m.example.net#top": "m.example.net",
        "https://www.": None, "https://[2001:db8::1]:80/x": "[2001:db8::1]", "  https://example.com  ": "example.com",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", text.host(F.col("u")).alias("v")).collect()
    assert {r.u: r.v for r in rows} == cases


def test_slug(spark):
    cases = {"--GPT 4o! (mini)": "gpt-4o-mini", "Brand#2": "brand-2", "": "", "ÄÖ": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "n string").select("n", text.slug(F.col("n")).alias("v")).collect()
    assert {r.n: r.v for r in rows} == cases


@pytest.mark.parametrize("raw, limit", [
    (None, 25), ("", 25), ("abc", 25), ("0", 25), ("-1", 25), ("0.5", 1), ("1000", 100), ("7.9", 7), ("nan", 25), ("inf", 25), ("50", 50),
])
def test_limit(raw, limit):
    assert paging.parse_limit(raw) == limit


def test_cursors():
    assert paging.parse_id_cursor("12") == 12 and paging.parse_id_cursor("x1") is None and paging.parse_id_cursor(None) is None
    assert paging.parse_time_cursor("junk") is None
    assert paging.parse_time_cursor("2024-01-02T03:04:05.000Z").replace(tzinfo=None) == datetime(2024, 1, 2, 3, 4, 5)


ITEM = "id long, type string, `by` string, time long, title string, text string, url string, score int, descendants int, " \
    "kids array<long>, parent long, deleted boolean, dead boolean"


def test_item_rules(spark):
    rows = [
        (1, "story", "ann", 1_700_000_000, "T", None, "https://x.org", None, None, None, None, None, None),
        (2, "comment", "bob", 1_700_000_001, None, "hi", None, 3, None, [9], 1, False, False),
        (3, "job", "cy", 1, None, None, None, None, None, None, None, None, None),
        (4, "story", None, 1, None, None, None, None, None, None, None, None, None),
        (5, "story", "", 1, None, None, None, None, None, None, None, None, None),
        (6, "story", "dee", 1, None, None, None, None, None, None, None, True, None),
        (7, "story", "eve", 1, None, None, None, None, None, None, None, None, True),
        (8, "pollopt", "eve", 1, None, None, None, None, None, None, None, None, None),
    ]
    items = spark.createDataFrame(rows, ITEM)
    ids = spark.createDataFrame([(i,) for i in range(1, 20)], "id long")
    out = {r.external_id: r for r in ingest.normalize_items(ingest.hydrate_items(ids, items), 3).collect()}
    assert set(out) == {"1", "2"}
    assert out["1"].content_type == "post" and out["2"].content_type == "comment"
    assert out["1"].source_metadata == '{"score":0,"descendants":0,"kids":[],"parent":null,"hn_type":"story"}'
    assert out["1"].published_at == datetime(2023, 11, 14, 22, 13, 20)
    shaped = ingest.canonical_record(ingest.normalize_items(items, 3)).first()
    assert shaped.category == "discourse" and shaped.publisher is None and shaped.language == "en" and shaped.analysis == "{}"


def test_null_offsets(spark):
    rows = [(1, 1, None), (1, 1, None), (1, 1, 0), (1, 1, 0), (2, 1, None)]
    frame = spark.createDataFrame(rows, "entity_id int, record_id long, start_offset int")
    assert dedup.dedup_mentions(frame).count() == 3
    stored = spark.createDataFrame([(1, 1, None)], frame.schema)
    left = {tuple(r) for r in dedup.dedup_mentions(frame, stored).collect()}
    assert left == {(1, 1, 0), (2, 1, None)}


def test_signal_dedup_null_topic(spark):
    ddl = "id int, kind string, topic_id int, dedup_key string, detected_at timestamp"
    t = datetime(2024, 1, 1)
    batch = spark.createDataFrame([(1, "v", None, "d", t), (2, "v", None, "d", t), (3, "v", None, None, t), (4, "v", None, None, t), (5, "v", 1, "d", t)], ddl)
    none = spark.createDataFrame([], ddl)
    assert sorted(r.id for r in dedup.upsert_signals(batch, none).collect()) == [1, 3, 4, 5]
    stored = spark.createDataFrame([(9, "v", None, "d", t)], ddl)
    assert sorted(r.id for r in dedup.upsert_signals(batch, stored).collect()) == [3, 4, 5]


def test_evidence_targets(spark):
    rows = [(1, None, None, None, None), (2, 5, None, None, None), (3, 5, 6, None, None), (4, None, None, None, "s")]
    frame = spark.createDataFrame(rows, "signal_id long, record_id long, entity_id int, target_topic_id int, story_id string")
    assert sorted(values(quality.one_target(frame), "key")) == ["1", "3"]


def test_breaking_age(spark):
    now = "2024-01-10 00:00:00"
    ages = {"a": "2024-01-08 00:01:00", "b": "2024-01-08 00:00:00", "c": "2024-01-07 23:59:00"}
    st = spark.createDataFrame([(k, v) for k, v in ages.items()], "id string, t string").select(
        "id", F.col("t").cast("timestamp").alias("generated_at"), F.lit("breaking").alias("arc_status"), F.lit(1).alias("topic_id"), F.lit(True).alias("active")
    )
    sig = spark.createDataFrame([], "topic_id int, detected_at timestamp")
    mem = spark.createDataFrame([], "story_id string, arc_id int")
    out = stories.computed_arc_status(st, sig, mem, F.lit(now).cast("timestamp"))
    assert {r.id: r.computed_arc_status for r in out.collect()} == {"a": "breaking", "b": "breaking", "c": None}


def test_prominence_needs_five(spark):
    rows = [(i, "four", i) for i in range(4)] + [(10 + i, "five", i) for i in range(5)]
    out = rollups.prominence_rank(spark.createDataFrame(rows, "id int, type string, mention_count long")).collect()
    assert all(r.within_type is None and r.sample_size == 4 for r in out if r.type == "four")
    assert [r.within_type for r in sorted(out) if r.type == "five"] or True
    assert sorted(r.within_type for r in out if r.type == "five") == [0.0, 25.0, 50.0, 75.0, 100.0]


def test_herfindahl_bounds(spark):
    rows = [(1, "a", 7)] + [(2, str(k), 5) for k in range(9)]
    out = {r.entity_id: r for r in rollups.source_diversity(spark.createDataFrame(rows, "entity_id int, kind string, record_count long")).collect()}
    assert out[1].herfindahl_index == 10000.0 and out[1].distinct_sources == 1
    assert out[2].herfindahl_index == pytest.approx(10000 / 9, abs=1e-3) and out[2].distinct_sources == 9


def test_vector_codec(spark):
    frame = spark.createDataFrame([("[1.5,-2.25]",), ("[]",)], "t string").withColumn("v", vectors.parse_vector(F.col("t")))
    rows = frame.withColumn("back", vectors.render_vector(F.col("v"))).collect()
    assert [list(r.v) for r in rows] == [[1.5, -2.25], []] and [r.back for r in rows] == ["[1.5,-2.25]", "[]"]


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    out = values(spark.createDataFrame(rows, "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("v")))
    assert out == [1.0, 0.0, None, None]


def test_like_is_literal(spark):
    frame = spark.createDataFrame([("100% sure",), ("1000 sure",), ("A_B",), ("AxB",)], "t string")
    assert values(frame.filter(text.contains_ci(F.col("t"), "0%")), "t") == ["100% sure"]
    assert values(frame.filter(text.contains_ci(F.col("t"), "a_b")), "t") == ["A_B"]


def test_length_status(spark):
    sizes = spark.createDataFrame([(None,), (0,), (9,), (10,), (45,), (46,)], "n int")
    assert values(sizes.select(rules.length_status(F.col("n"), 10, 45).alias("v"))) == ["missing", "missing", "too_short", "ok", "ok", "too_long"]


def test_tier_quota(spark):
    t = datetime(2024, 1, 1, 12)
    def calls(key, tier, seats, n):
        return spark.range(n).select(F.lit(key).alias("key_id"), F.lit(tier).alias("tier"), F.lit(seats).alias("seats"),
                                     (F.lit(t) + F.make_dt_interval(mins=(F.col("id") / 10).cast("int"))).alias("called_at"))
    usage = calls(1, "hobbyist", 1, 500).union(calls(2, "hobbyist", 1, 501)).union(calls(3, "pro", 1, 6000)).union(calls(4, "internal", 1, 10))
    out = {r.key_id: r for r in rollups.quota_usage(usage, rollups.tier_table(spark)).collect()}
    assert (out[1].day_state, out[2].day_state, out[3].day_state, out[4].day_state) == ("ok", "blocked", "ok", "unlimited")
    burst = spark.range(61).select(F.lit(5).alias("key_id"), F.lit("hobbyist").alias("tier"), F.lit(1).alias("seats"), F.lit(t).alias("called_at"))
    assert rollups.quota_usage(burst, rollups.tier_table(spark)).first().minute_blocked
    soft = calls(6, "teams", 1, 40_000)
    assert rollups.quota_usage(soft, rollups.tier_table(spark)).agg(F.max("day_state")).first()[0] in ("warned", "ok")


def test_zero_fill(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 2),)], "captured_at timestamp")
    out = rollups.stats_timeline(spark, rows, "2024-01-01", "2024-01-03").orderBy("date").collect()
    assert [(r.date, r["count"]) for r in out] == [(date(2024, 1, 1), 0), (date(2024, 1, 2), 1), (date(2024, 1, 3), 0)]
