"""Streams give what the batch operators give on the same rows, replays and late rows included."""

from datetime import datetime

from conftest import FOLDER
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorascope.operators import rollups
from agorascope.session import SharedFiles, fresh_dir
from agorascope.streaming import envelopes, flows
from agorascope.streaming.bound import StreamCorpus
from agorascope.streaming.rollup_store import RollupStore


def parted(spark, corpus, n=4, repeat=()):
    """The events in ``n`` files, some of them delivered twice, as a stream of one file a batch."""
    path = fresh_dir(spark, "parts")
    events = corpus.table("events").withColumn("part", (F.col("event_id") * n / 1000).cast("int"))
    for i in [*range(n), *repeat]:
        events.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


class Parts(StreamCorpus):
    def __init__(self, spark, path):
        super().__init__(spark, FOLDER)
        self.path = path

    def table(self, name):
        if name != "events":
            return super().table(name)
        static = self.spark.read.parquet(f"{FOLDER}/events.parquet")
        return flows.read_stream(self.spark, self.path, "*.parquet", static.schema, files_per_trigger=1)


def test_replayed_files_add_no_records(spark, corpus):
    stream = Parts(spark, parted(spark, corpus, repeat=(0, 2)))
    stored = flows.ingest_dedup(stream.items, 3, corpus.as_of).persist()
    items = corpus.items.filter("NOT deleted AND NOT dead AND type IN ('story', 'comment') AND `by` IS NOT NULL")
    assert stored.count() == items.select("id").distinct().count()
    assert stored.select("kind", "external_id").distinct().count() == stored.count()


def test_rollup_of_many_batches_is_the_batch_rollup(spark, corpus):
    stream = Parts(spark, parted(spark, corpus))
    got = flows.daily_rollup(stream.core.select("kind", "captured_at"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rollups.source_daily(corpus.core).collect()}


def test_closed_windows_equal_batch_windows(spark, corpus):
    stream = Parts(spark, parted(spark, corpus))
    got = {tuple(r) for r in flows.sliding_counts(stream.core.select("kind", "captured_at")).collect()}
    full = corpus.core.groupBy(F.window("captured_at", "24 hours", "1 hour").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    want = {tuple(r) for r in full.select("w.start", "w.end", "kind", "n").collect()}
    assert got and got <= want


def test_gate_reports_missing_embeddings(spark, corpus):
    stream = Parts(spark, parted(spark, corpus))
    out = flows.embedding_gate(stream.core.select(F.col("id").alias("record_id"), "captured_at"), StreamCorpus(spark, FOLDER).ready_embeddings())
    rows = out.collect()
    assert len(rows) == len({r.record_id for r in rows})
    assert {r.record_id for r in rows if r.embedded} == {i for i in range(500) if i % 3}
    times = {r.id: r.captured_at for r in corpus.core.select("id", "captured_at").collect()}
    last = max(times.values())
    gone = {i for i, t in times.items() if (i >= 500 or i % 3 == 0) and (last - t).total_seconds() > 70 * 60}
    assert {r.record_id for r in rows if not r.embedded} == gone


def stream_of(spark, schema, files):
    path = fresh_dir(spark, "late")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return flows.read_stream(spark, path, "*.parquet", T.StructType.fromDDL(schema), files_per_trigger=1)


def test_late_and_new_is_stored(spark, corpus):
    """A first delivery days behind the newest one is new all the same; a replay is not."""
    day = lambda n: datetime(2024, 1, n)
    schema = "idempotency_key string, attempted_at timestamp, n int"
    files = [[("a", day(20), 1), ("b", day(20), 1)], [("a", day(21), 2), ("c", day(17), 1)], [("d", day(10), 1), ("b", day(9), 3), ("d", day(11), 2)]]
    out = flows.webhook_dedup(stream_of(spark, schema, files)).collect()
    assert {(r.idempotency_key, r.n) for r in out} == {("a", 1), ("b", 1), ("c", 1), ("d", 1)}
    items = corpus.items.filter("NOT deleted AND NOT dead AND type IN ('story', 'comment') AND `by` IS NOT NULL").orderBy("id").limit(6).collect()
    kind = corpus.items.schema
    path = fresh_dir(spark, "items")
    for chosen, back in (((0, 1, 2), 0), ((0, 3), 3), ((4, 1, 5), 10)):
        rows = [tuple(items[i][f.name] - back * 86_400 if f.name == "time" else items[i][f.name] for f in kind) for i in chosen]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    stored = flows.ingest_dedup(flows.read_stream(spark, path, "*.parquet", kind, files_per_trigger=1), 3, corpus.as_of)
    assert sorted(r.external_id for r in stored.collect()) == sorted({str(items[i]["id"]) for i in range(6)})


def test_late_rows_are_marked(corpus):
    out = flows.late_split(corpus.arrivals)
    assert out.filter((F.col("id") % 13 == 0) != F.col("is_backfill")).count() == 0


def test_cursor_walk(spark, corpus):
    cursors = spark.createDataFrame([("t", None)], "task string, cursor string")
    seen = []
    for _ in range(20):
        rows = [r.id for r in flows.next_batch(corpus.core, cursors, "t", 300).collect()]
        if not rows:
            break
        seen += rows
        done = spark.createDataFrame([(i,) for i in rows], "id long")
        moved = flows.advance(cursors, "t", done).first()
        cursors = spark.createDataFrame([(moved.task, moved.cursor)], "task string, cursor string")
    assert sorted(seen) == sorted(r.id for r in corpus.core.select("id").collect()) and len(seen) == len(set(seen))


def test_rollup_store_opens_one_file_set_a_day(spark):
    """After 100 batches a reader opens the days and fewer open batches than one compaction folds; retries add nothing."""
    store = RollupStore(spark, fresh_dir(spark, "store"), every=10)
    expected = {}
    for i in range(100):
        day, kind = f"2024-01-{1 + i % 4:02}", "ab"[i % 2]
        expected[day, kind] = expected.get((day, kind), 0) + i
        part = spark.createDataFrame([(day, kind, i)], "d string, kind string, record_count long").selectExpr("cast(d as date) as bucket_date", "kind", "record_count")
        store.add(part, i)
        if i % 33 == 0:
            store.add(part, i)  # the same batch again
            store = RollupStore(spark, store.root, every=10)  # a restart
    assert {(str(r.bucket_date), r.kind): r.record_count for r in store.read().collect()} == expected
    assert len(store.paths()) <= 4 + 9
    before = dict(store.state["days"])
    late = spark.createDataFrame([("2024-01-02", "z", 5), (None, "a", 2)], "d string, kind string, record_count long").selectExpr("cast(d as date) as bucket_date", "kind", "record_count")
    store.add(late, 100)
    store.compact()
    assert {d for d in before if store.state["days"][d] != before[d]} == {"2024-01-02"} and "none" in store.state["days"]
    assert store.read().count() == len(expected) + 2


def test_a_crash_before_the_manifest_changes_nothing(spark):
    store = RollupStore(spark, fresh_dir(spark, "store"), every=100)
    one = spark.createDataFrame([("a", 3)], "kind string, record_count long").selectExpr("date'2024-01-01' as bucket_date", "kind", "record_count")
    store.add(one, 0)

    class Crash(Exception):
        pass

    def fail(**changes):
        raise Crash

    kept, store._commit = store._commit, fail
    for broken in (lambda: store.add(one, 1), store.compact):
        try:
            broken()
        except Crash:
            pass
    assert [r.record_count for r in RollupStore(spark, store.root).read().collect()] == [3]
    again = RollupStore(spark, store.root)
    again.add(one, 1)
    again.compact()
    assert [r.record_count for r in again.read().collect()] == [6]


def test_open_embeddings_expire(spark, monkeypatch):
    """What the gate carries on does not grow with embeddings that no record ever asks for."""
    from datetime import timedelta

    start, kept = datetime(2024, 1, 1), []
    records = [[(i * 10 + k, start + timedelta(hours=3 * i)) for k in range(2)] for i in range(6)]
    ready = [[(10_000 + i * 10 + k, start + timedelta(hours=3 * i)) for k in range(5)] + [(i * 10, start + timedelta(hours=3 * i, minutes=5))] for i in range(6)]
    roots = []
    monkeypatch.setattr(flows, "fresh_dir", lambda s, label: roots.append(fresh_dir(s, label)) or roots[-1])
    out = flows.embedding_gate(stream_of(spark, "record_id long, captured_at timestamp", records), stream_of(spark, "ready_id long, ready_at timestamp", ready))
    rows = {r.record_id: r.embedded for r in out.collect()}
    assert all(rows[i * 10] for i in range(6)) and not any(rows.get(i * 10 + 1, False) for i in range(6))
    for name in SharedFiles(spark, f"{roots[-1]}/open").names():
        if name.startswith("batch=") and name != "batch=-1":
            kept.append(spark.read.parquet(f"{roots[-1]}/open/{name}").filter("captured_at IS NULL").count())
    assert kept and max(kept) <= 10


def test_envelopes_go_to_their_sinks_once(spark):
    schema = "event_type string, payload string, sent_at timestamp"
    t = datetime(2024, 1, 1)
    good = ("topic_assigned", '{"recordId":"1","topicId":2,"method":"keyword"}', t)
    bad = [
        ("topic_assigned", '{"recordId":"1","topicId":"two","method":"keyword"}', t), ("topic_assigned", '{"recordId":"1","method":"keyword"}', t),
        ("variants_generated", '{"storyId":"1","variantTypes":[],"generationModel":"m","generatedAt":"2024-01-01T00:00:00Z"}', t),
        ("embedding_ready", None, t), (None, "{}", t), ("other", "{}", t), ("arc_updated", "not json", t),
    ]
    sinks = envelopes.route(stream_of(spark, schema, [[good, bad[0]], bad[1:4], [good, *bad[4:]]]))
    assert [tuple(r)[1:] for r in sinks.events("topic_assigned").collect()] == [("1", 2, "keyword", None)] * 2
    assert all(sinks.events(kind).count() == 0 for kind in envelopes.STREAMS if kind != "topic_assigned")
    reasons = sorted((str(r.event_type), r.reason) for r in sinks.dead.collect())
    assert reasons == sorted([
        ("topic_assigned", "payload does not parse"), ("topic_assigned", "topicId is missing"), ("variants_generated", "variantTypes empty or outside its domain"),
        ("embedding_ready", "payload does not parse"), ("None", "unknown type"), ("other", "unknown type"), ("arc_updated", "payload does not parse"),
    ])
