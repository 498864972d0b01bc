import random

from pyspark.sql import functions as F

from agorascope.llm import simhash

FOLDER = "/root/testdata/sf0.001"


def by_force(rows):
    """Components of all pairs of fingerprints, by testing every pair."""
    prints = [simhash.fingerprint(None if t is None else t.encode()) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    low = {}
    for i, (doc, _) in enumerate(rows):
        low.setdefault(top(i), []).append(doc)
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted((str(d), f"{prints[i]:016x}", ids[top(i)]) for i, (d, _) in enumerate(rows))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r[0]), r[1], r[2]) for r in simhash.components(docs).collect())
    assert got == by_force(rows)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = set(seeds)
    for s in seeds:
        for k in range(1, 7):
            values.add(s ^ sum(1 << b for b in rng.sample(range(64), k)))
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "p long")
    got = {r.p: r["class"] for r in simhash.classes(frame).collect()}
    groups = {}
    for v in values:
        groups.setdefault(got[simhash._signed(v)], []).append(v)
    name = {v: k for k, vs in groups.items() for v in vs}
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 4:
                assert name[a] == name[b]
    reach = sum(1 for vs in groups.values() for v in vs if len(vs) == 1 or any((v ^ w).bit_count() <= 4 for w in vs if w != v))
    assert reach == len(values)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "one two"), (5, "ONE two"), (5, "ONE two"), (7, "x " * 30_000), (None, "ü ß")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_print", F.lit("clash")).withColumn("class", F.lit(1))
    got = sorted((str(r[0]), r[1], r[2]) for r in simhash.components(docs).collect())
    assert got == by_force(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect())[:2] == [("1", None), ("5", "ONE two")]
    assert kept.count() == 4
    assert simhash.components(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_only_values_that_share_two_segments_are_wiped(spark):
    """Values far apart are not wiped 64 times each; of two that are one bit apart, the bits of one segment."""
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(200)]
    values += [values[0] ^ 1 << 30, values[1] ^ 1 << 63, values[1] ^ 3 << 5]
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "p long")
    wiped = {(r.p % (1 << 64), r.bit): r.rest % (1 << 64) for r in simhash.wiped(frame).collect()}
    assert all(rest == p & ~(1 << bit) for (p, bit), rest in wiped.items())
    asked = [(values[0], 21, 42), (values[200], 21, 42), (values[1], 42, 64), (values[201], 42, 64), (values[1], 0, 21), (values[202], 0, 21)]
    assert set(wiped) == {(p, bit) for p, low, high in asked for bit in range(low, high)}


def test_variants_are_dealt_not_broadcast(spark):
    """64 variants a fingerprint are not in Spark's estimate of their size: up to 10 MB of fingerprints would be broadcast as 64 times that."""
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(500)]
    frame = spark.createDataFrame([(simhash._signed(v),) for v in [*values, *(v ^ 0x8000100001 for v in values)]], "p long")
    found = simhash.links(frame)
    assert found.count() == 500 and len(found.collect()) == 500
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin [bit#" in plan and "BroadcastHashJoin [bit#" not in plan


def test_variants_are_dealt_once(spark):
    """Both sides of the join on variants are the same rows: one shuffle, read twice."""
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(500)]
    frame = spark.createDataFrame([(simhash._signed(v),) for v in [*values, *(v ^ 0x8000100001 for v in values)]], "p long")
    found = simhash.links(frame)
    assert found.count() == 500 and len(found.collect()) == 500
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("+- Exchange hashpartitioning(bit#") == 1 and plan.count("+- ReusedExchange [bit#") == 1
