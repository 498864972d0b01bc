import random
import zlib

from pyspark.sql import functions as F

from agorascope.llm import sharding as S

FOLDER = "/root/testdata/sf0.01"


def simple(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(bins) if room >= sizes[i]]
        if not fits:
            bins.append(capacity)
            fits = [(capacity, len(bins) - 1)]
        _, b = min(fits)
        bins[b] -= sizes[i]
        out[i] = b
    return out


def test_tree_packs_like_a_plain_search():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(0, 200))]
        assert S.pack(sizes, 120) == simple(sizes, 120)
    tree = None
    for k in range(2000):
        tree = S._put(tree, (k, k))
    assert tree.high <= 16
    assert S.pack([5, 5, 5], 9, 2) is None and S.pack([10], 9) is None


def laws(rows, count):
    slots, size = {}, [0] * count
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return size


def test_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = S.shards(docs, 24).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    group = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        group.setdefault(data, set()).add(r.shard)
    assert all(len(s) == 1 for s in group.values())
    size = laws(rows, 24)
    assert max(size) - min(size) <= 0.02 * max(size)


def test_edges(spark):
    rows = [(None, None), (1, None), (2, ""), (3, "x" * 5000), (3, "x" * 5000), (4, "ü")] + [(100 + i, "hot text") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("id", F.lit(1))
    got = S.shards(docs, 3).collect()
    assert len(got) == len(rows)
    size = laws(got, 3)
    assert len({r.shard for r in got if r.doc_id in (None, 1, 2)}) == 1
    assert sum(size) == sum(len((t or "").encode()) + 8 for _, t in rows)
    assert S.shards(docs.limit(0), 3).count() == 0
    many = spark.createDataFrame([(i, "hot text") for i in range(3000)], "doc_id long, text string")
    even = laws(S.shards(many, 4).collect(), 4)
    assert max(even) - min(even) <= 0.1 * max(even)
