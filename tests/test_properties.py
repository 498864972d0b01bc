"""Invariants, and operators against brute force on small skewed data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from agorascope.operators import asof, dedup, ingest, links, paging, positions, reads, search, signals, stories, textual, vector_index, vectorial


def test_replay_adds_nothing(spark, corpus):
    batch = ingest.canonical_record(ingest.normalize_items(corpus.items.filter("NOT deleted AND NOT dead"), 3))
    empty = spark.createDataFrame([], "kind string, external_id string")
    once = ingest.upsert_records(batch, empty, [F.col("source_metadata")], corpus.as_of).persist()
    again = ingest.upsert_records(batch, once, [F.col("source_metadata")], corpus.as_of)
    assert once.count() == once.select("kind", "external_id").distinct().count() > 0
    assert again.count() == 0


def test_ids_are_consecutive(spark):
    keys = random.Random(1).sample(range(10**7), 3000)
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    out = {r.k: r.id for r in ingest.assign_ids(frame, "k", F.lit(100)).collect()}
    assert [out[k] for k in sorted(keys)] == list(range(100, 3100))


def test_positions_with_a_hot_group(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", rnd.randrange(500), i) for i in range(3000)] + [(None, 5, 9999)]
    frame = spark.createDataFrame(rows, "g string, t int, id int")
    got = positions.bucketed_positions(frame, ["g"], F.floor(F.col("t") / 20), [F.col("t"), F.col("id")])
    expected = {}
    for g in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))):
            expected[r[2]] = i
    assert {r.id: r.position for r in got.collect()} == expected


@pytest.mark.parametrize("bucket", ["hour", "day"])
def test_asof_against_brute_force(spark, bucket):
    rnd = random.Random(3)
    base = datetime(2024, 1, 1)
    left = [(i, "hot" if i % 3 else f"k{i % 4}", base + timedelta(minutes=rnd.randrange(5000))) for i in range(400)]
    right = [(i, "hot" if i % 3 else f"k{i % 5}", base + timedelta(minutes=rnd.randrange(5000))) for i in range(300)]
    lf = spark.createDataFrame(left, "id int, key string, at timestamp")
    rf = spark.createDataFrame(right, "sid int, key string, seen timestamp")
    got = asof.latest_before(lf, rf, ["key"], "at", "seen", "sid", bucket, F.make_dt_interval(hours=F.lit(12)))
    for r in got.select("id", "key", "at", "match.sid").collect():
        best = max(((s[2], s[0]) for s in right if s[1] == r.key and s[2] < r.at and s[2] >= r.at - timedelta(hours=12)), default=None)
        # the latest earlier row must itself be inside the bound
        last = max(((s[2], s[0]) for s in right if s[1] == r.key and s[2] < r.at), default=None)
        assert r.sid == (last[1] if last and best else None)


@pytest.mark.parametrize("size", [1, 7, 100])
def test_page_walk_returns_every_row_once(spark, corpus, size):
    rows = corpus.active_stories.select("id", F.coalesce("publish_at", "generated_at").alias("at")).withColumn("at", F.date_trunc("day", "at")).persist()
    seen, cursor = [], None
    while True:
        page = paging.page(rows, ["at", "id"], size, cursor).orderBy("page_row").collect()
        seen += [r.id for r in page]
        if not page or page[0].next_cursor is None:
            break
        cursor = [page[-1]["at"], page[-1]["id"]]
    assert sorted(seen) == sorted(r.id for r in rows.collect()) and len(seen) == len(set(seen))


def test_offset_walk(spark):
    rows = spark.range(0, 3000, 7).withColumnRenamed("id", "k")
    seen, offset = [], 0
    while offset is not None:
        page = paging.offset_page(rows, "k", offset, 100).orderBy("position").collect()
        seen += [r.k for r in page]
        offset = page[0].next_offset
    assert seen == list(range(0, 3000, 7))


def test_one_active_version_after_supersede(spark, corpus):
    s = corpus.stories.select("id", "slug", "version", "active", "previous_version_id")
    drafts = corpus.active_stories.select("slug", F.concat("slug", F.lit("-x")).alias("id")).union(
        spark.createDataFrame([("brand-new", "n1")], "slug string, id string")
    )
    after = stories.supersede_story(s, drafts)
    assert after.count() == s.count() + drafts.count()
    assert stories.chain_integrity(after).count() == 0
    assert after.filter("slug = 'brand-new'").first().version == 1


def test_pending_and_blocked_are_not_published(corpus):
    rows = reads.publish_gate(corpus.stories, corpus.verdicts, "conv_id").select("gate", "published").distinct().collect()
    assert {(r.gate, r.published) for r in rows} <= {("passed", True), ("blocked", False), ("pending", False)}
    assert {r.gate for r in rows} >= {"pending"}


def test_evidence_weights_sum_to_one(spark):
    rows = [(f"s{i % 3}", "record", i, float(i % 7 + 1)) for i in range(90)] + [("thin", "record", 1, 1.0)]
    part = spark.createDataFrame(rows, "signal_key string, target string, target_id long, raw_weight double")
    out = signals.assemble_evidence([part]).collect()
    assert {r.signal_key for r in out} == {"s0", "s1", "s2"}
    for key in ("s0", "s1", "s2"):
        own = sorted((r for r in out if r.signal_key == key), key=lambda r: r["rank"])
        assert sum(r.weight for r in own) == pytest.approx(1, abs=0.01)
        assert [r["rank"] for r in own] == list(range(1, 31))
        assert all(a.weight >= b.weight for a, b in zip(own, own[1:]))


def test_second_sync_pushes_nothing(spark, corpus):
    docs = search.search_projection(corpus.stories, corpus.citations, corpus.entities, corpus.topics)
    current = docs.withColumn("content_hash", search.content_hash(F.coalesce("title", F.lit("")))).select("kind", "entity_id", "content_hash")
    none = spark.createDataFrame([], "kind string, entity_id string, content_hash string, status string, attempts int")
    nothing = spark.createDataFrame([], "kind string, entity_id string")
    first = search.next_state(search.projection_diff(current, none), nothing)
    assert first.filter("action = 'insert' AND status = 'synced'").count() == current.count()
    second = search.projection_diff(current, first)
    assert second.filter("action <> 'none'").count() == 0


def test_failed_push_is_tried_again(spark):
    current = spark.createDataFrame([("story", "1", "h2")], "kind string, entity_id string, content_hash string")
    state = spark.createDataFrame([("story", "1", "h1", "synced", 0)], "kind string, entity_id string, content_hash string, status string, attempts int")
    failed = spark.createDataFrame([("story", "1")], "kind string, entity_id string")
    none = spark.createDataFrame([], failed.schema)
    once = search.next_state(search.projection_diff(current, state), failed)
    assert tuple(once.select("content_hash", "status", "attempts").first()) == ("h1", "failed", 1)
    twice = search.next_state(search.projection_diff(current, once), none)
    assert tuple(twice.select("content_hash", "status", "attempts").first()) == ("h2", "synced", 0)


def test_saved_search_against_brute_force(spark):
    import regex

    docs = [(1, "Alpha beta gamma alpha"), (2, "beta alpha"), (3, "ALPHA  beta-gamma"), (4, ""), (5, "alphabeta gamma")]
    asks = [(1, "alpha beta"), (2, "gamma"), (3, "beta gamma alpha"), (4, "delta"), (5, "  ")]
    got = links.saved_search_matches(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(asks, "search_id int, query string"))

    def words(s):
        return " " + " ".join(regex.findall(r"[\p{L}\p{N}]+", s.lower())) + " "

    expected = {(q, d) for q, a in asks for d, t in docs if words(a).strip() and words(a) in words(t)}
    assert {(r.search_id, r.id) for r in got.collect()} == expected


def test_mentions_against_brute_force(spark):
    import regex

    texts = [(1, "Ann Lee met ann lee; Annlee, ann"), (2, "C++? ann-lee"), (3, "lee ANN LEE")]
    names = [(1, "Ann Lee"), (2, "ann"), (3, "Lee")]
    got = textual.extract_mentions(spark.createDataFrame(texts, "record_id int, text string"), spark.createDataFrame(names, "entity_id int, name string"))
    expected = set()
    for rid, t in texts:
        for eid, n in names:
            for m in regex.finditer(r"(?<![\p{L}\p{N}])" + regex.escape(n.lower()) + r"(?![\p{L}\p{N}])", t.lower()):
                expected.add((rid, eid, m.start(), m.end()))
    assert {tuple(r) for r in got.collect()} == expected


def test_entity_alerts_are_whole_under_skew(spark):
    mentions = spark.createDataFrame([(1 if i % 3 else 2, datetime(2024, 1, 1 + i % 5)) for i in range(300)], "entity_id int, captured_at timestamp")
    subs = spark.range(200).select(F.col("id").alias("subscriber_id"), F.when(F.col("id") % 3 == 0, 2).otherwise(1).alias("entity_id"))
    out = links.entity_alerts(mentions, subs)
    assert out.count() == 200 * 5 and out.select("subscriber_id", "day").distinct().count() == 1000


def test_token_may_leave_the_saturation_list(spark):
    series = [("w", i, r) for i, r in enumerate([None, 1.5, 2.5, 2.5, 1.3, 0.5])] + [("x", i, r) for i, r in enumerate([None, 3.0, 3.0, 3.0, 3.0, 3.0])]
    shares = spark.createDataFrame(series, "token string, window_no int, ratio double")
    none = spark.createDataFrame([("x",)], "token string")
    out = signals.saturation_states(shares, none).collect()
    states = {t: [r.state for r in sorted((r for r in out if r.token == t), key=lambda r: r.window_no)] for t in "wx"}
    assert states["w"] == ["untracked", "monitored", "saturated", "saturated", "monitored", "untracked"]
    assert states["x"] == ["untracked", "monitored", "removed", "removed", "removed", "removed"]


def test_delta_lists(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2)], "token string, w int")
    out = dedup.saturation_delta(rows, F.col("w") == 1, F.col("w") == 2)
    assert {r.token: r.change for r in out.collect()} == {"a": "removed", "b": "kept", "c": "added"}


def test_novelty_mean_equals_all_pairs(spark, corpus):
    import numpy as np

    rows = corpus.vectors.select("record_id", F.col("cluster").alias("topic_id"), "vector").join(
        corpus.core.select(F.col("id").alias("record_id"), "captured_at"), "record_id").persist()
    split, end = (F.lit(t).cast("timestamp") for t in ("2024-01-10", "2024-01-12"))
    got = {r.record_id: r.recent_distance for r in vectorial.novelty(rows, split, end).collect()}
    fresh = rows.filter((F.col("captured_at") > split) & (F.col("captured_at") <= end)).collect()
    unit = {r.record_id: np.array(r.vector) / np.linalg.norm(r.vector) for r in fresh}
    for r in fresh:
        others = [unit[o.record_id] @ unit[r.record_id] for o in fresh if o.topic_id == r.topic_id and o.record_id != r.record_id]
        if others:
            assert got[r.record_id] == pytest.approx(1 - np.mean(others), abs=2e-6)


def test_vector_index(corpus):
    asked = corpus.vectors.filter("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "vector")
    exact = {tuple(r) for r in vector_index.search_exact(corpus.vectors, asked, 10, block=7, rows_per_task=90).collect()}
    assert len(exact) == 250
    index = vector_index.build(corpus.vectors, bucket_rows=10)
    filed = index.rows.groupBy("record_id").agg(F.count("*").alias("n"), F.max(F.col("home") == F.col("cell")).alias("at_home")).collect()
    assert len(filed) == 500 and all(r.at_home for r in filed) and any(r.n > 1 for r in filed)
    assert index.cells.agg(F.max("buckets")).first()[0] > 1
    every = {tuple(r) for r in vector_index.search(index, asked, 10, probes=index.lists).collect()}
    assert every == exact  # all cells probed: no neighbour lost, none twice
    probes = vector_index.tune(index, corpus.vectors, asked, 10)
    some = {tuple(r)[:2] for r in vector_index.search(index, asked, 10, probes).collect()}
    assert probes < index.lists and len(some & {r[:2] for r in exact}) >= 0.95 * len(exact)


def test_vector_index_leaves_out_rows_without_a_cosine(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.2]), (5, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "record_id long, vector array<float>")
    asked = vectors.withColumnRenamed("record_id", "query_id")
    index = vector_index.build(vectors, lists=2)
    got = [tuple(r)[:2] for r in vector_index.search(index, asked, 1, probes=2).orderBy("query_id").collect()]
    assert got == [(0, 5), (1, 0), (4, 1), (5, 0)]
    assert got == [tuple(r)[:2] for r in vector_index.search_exact(vectors, asked, 1).orderBy("query_id").collect()]


def test_hybrid_search_fuses_whole_lists(spark):
    """Against plain fusion of complete rankings, with lists of many lengths."""
    import random

    rng = random.Random(12)
    for n, top, k in ((400, 5, 60), (400, 3, 2), (12, 10, 60), (60, 1, 1)):
        docs = [(i, " ".join(rng.choices(["a1", "b1", "c1", "d1"], k=rng.randrange(1, 12)))) for i in range(n)]
        vecs = [(i, [rng.gauss(0, 1), rng.gauss(0, 1), 1.0]) for i in range(n) if rng.random() < 0.9]
        d = spark.createDataFrame(docs, "record_id long, content string")
        v = spark.createDataFrame(vecs, "record_id long, vector array<double>")
        q = F.array(F.lit(1.0), F.lit(0.5), F.lit(0.2))
        words = {r.record_id: round(r.score, 9) for r in textual.fulltext_search(d, F.col("content"), "a1 b1").collect()}
        close = {r.record_id: round(r.similarity, 9) for r in vectorial.nearest(v, q, n).collect()}
        ranks = [{r: i + 1 for i, r in enumerate(sorted(x, key=lambda r: (-x[r], r)))} for x in (words, close)]
        score = {r: sum(1 / (k + x[r]) for x in ranks if r in x) for r in {*words, *close}}
        expected = sorted(score, key=lambda r: (-score[r], r))[:top]
        got = search.hybrid_search(d, "content", "a1 b1", v, q, top, rrf_k=k).collect()
        assert [r.record_id for r in got] == expected
        assert [(r.keyword_rank, r.vector_rank) for r in got] == [tuple(x.get(r) for x in ranks) for r in expected]


def test_centroid_blocks_do_not_change_the_result(corpus):
    cents = vectorial.topic_centroids(corpus.vectors.withColumnRenamed("cluster", "topic_id"))
    one = {tuple(r) for r in vectorial.assign_topics_centroid(corpus.vectors, cents, 10, 0.0).collect()}
    many = {tuple(r) for r in vectorial.assign_topics_centroid(corpus.vectors, cents, 10, 0.0, block=3).collect()}
    assert one == many


def test_recent_lists_keep_order_per_group(spark):
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"g{i % 40}", i) for i in range(2000)], "g string, v int")
    out = paging.top_per_group(rows, ["g"], [F.desc("v")], 3)
    hot = sorted(r.v for r in out.filter("g = 'hot'").collect())
    assert hot == [1992, 1995, 1998] and out.count() == out.select("g").distinct().count() * 3


def test_refresh_takes_one_row_of_repeats(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 3), ("c", 5)], "k string, v int")
    got = {tuple(r) for r in dedup.keyed_refresh(old, new, ["k"], [F.desc("v")]).collect()}
    assert got == {("a", 3), ("b", 1), ("c", 5)}
    live = old.withColumn("is_active", F.lit(True))
    rows = {tuple(r) for r in dedup.active_refresh(live, new, ["k"], [F.desc("v")]).collect()}
    assert rows == {("a", 1, False), ("a", 3, True), ("b", 1, True), ("c", 5, True)}


def test_several_drafts_of_a_slug_follow_each_other(spark):
    kept = spark.createDataFrame([("s", "1", 1, None, True)], "slug string, id string, version int, previous_version_id string, active boolean")
    drafts = spark.createDataFrame([("s", "2"), ("s", "3"), ("t", "9")], "slug string, id string")
    after = {r.id: r for r in stories.supersede_story(kept, drafts).collect()}
    assert [(after[i].version, after[i].previous_version_id, after[i].active) for i in "1239"] == [
        (1, None, False), (2, "1", False), (3, "2", True), (1, None, True),
    ]


def test_offsets_count_characters_of_the_stored_text(spark):
    texts = spark.createDataFrame([(1, "\u0130\u0130\u0130 Ann, ann")], "record_id long, text string")
    names = spark.createDataFrame([(7, "ann")], "entity_id long, name string")
    got = sorted(tuple(r) for r in textual.extract_mentions(texts, names).collect())
    assert got == [(1, 7, 4, 7), (1, 7, 9, 12)]


def test_evidence_weights_survive_many_rows(spark):
    rows = spark.range(30_000).select(F.lit("k").alias("s"), F.col("id").alias("t"), (1 + F.col("id") % 3).alias("w"))
    out = signals.assemble_evidence([signals.evidence_part(rows, F.col("s"), "record", F.col("t"), F.col("w"))])
    top = out.orderBy("rank").limit(3).collect()
    assert [r.target_id for r in top] == [2, 5, 8] and top[0].weight > 0
    assert abs(out.agg(F.sum("weight")).first()[0] - 1) < 1e-6
