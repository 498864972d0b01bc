import hashlib
import random

import numpy as np
import pytest
import verify

from agorascope.llm import line_dedup

FOLDER = "/root/testdata/sf0.001"
PATHS = pytest.mark.parametrize("most_bytes", [line_dedup.MOST_BYTES, 0])


def by_force(rows):
    held = {}
    for k, (_, t) in enumerate(rows):
        for key in {x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")}:
            held.setdefault(key, []).append(k)
    out = []
    for d, t in rows:
        lines, kept = (t or "").split("\n"), []
        for x in lines:
            key = x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
            ids = [rows[k][0] for k in held[key]]
            if len(key) < 20 or len(ids) < 3 or d == max((i for i in ids if i is not None), default=None):
                kept.append(x)
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as mark", "'x' as `a.b`")
    got = sorted((str(r[0]), *r[1:]) for r in line_dedup.report(docs, **options).collect())
    assert got == by_force(rows)
    return got


@PATHS
def test_every_case(spark, most_bytes):
    shared, other = "This line stands in many of these documents", "é" * 20
    rows = [
        (1, shared), (2, f"a\n  {shared.upper()}\x0b\n{shared}\n"), (3, f"{shared}\r\nb"), (3, f"c\n{shared}"), (None, shared), (None, shared + "\nown"),
        (4, None), (5, ""), (6, "\n\n"), (7, other), (8, other.upper() + "\n" + other), (9, other), (-5, "x " + other), (11, "é" * 19), (12, "é" * 19), (13, "é" * 19),
        (14, "only two hold this line of text"), (15, "only two hold this line of text"), (16, "held by nobody with an id\n"), (0, "\n".join([shared] * 50_000)),
        (21, "a long line without an end " * 50_000), (22, "nul \x00 inside a line of text"), (23, "NUL \x00 inside a line of text"), (24, "nul \x00 inside a line of text "),
    ]
    rows += [(None, "only rows without an id hold it")] * 3
    got = check(spark, rows, most_bytes=most_bytes)
    assert sum(r[2] for r in got) > 50_000 - 1


@PATHS
def test_random_texts(spark, most_bytes, monkeypatch):
    rng = random.Random(11)
    pool = [" ".join(rng.choices(["alpha", "Beta", "gamma", "delta", "eps"], k=rng.randint(1, 6))) for _ in range(400)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 30)))) for i in range(500)]
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    check(spark, rows, most_bytes=most_bytes)


def test_empty_table(spark):
    assert line_dedup.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n + n // 2, dtype=np.uint64))[:n]
    built = line_dedup.PerfectHash.build(keys)
    assert sorted(built.slots(keys).tolist()) == list(range(len(keys)))
    assert built.slots(rng.integers(0, 1 << 63, 100, dtype=np.uint64)).max(initial=-1) < max(1, len(keys))


def test_keys_listed_when_levels_end(monkeypatch):
    monkeypatch.setattr(line_dedup, "_LEVELS", 2)
    test_perfect_hash(5000)


@PATHS
def test_whole_table_by_sql(spark, most_bytes):
    frame = line_dedup.report(spark.read.parquet(f"{FOLDER}/documents.parquet"), most_bytes=most_bytes)
    rows = [tuple(r) for r in frame.collect()]
    cursor = verify.connect(FOLDER).execute(line_dedup.ORACLE)
    assert not verify.compare(frame.columns, rows, [d[0] for d in cursor.description], cursor.fetchall())
    assert sum(r[2] for r in rows) > 50
