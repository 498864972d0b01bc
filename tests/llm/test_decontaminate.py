import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from agorascope.llm import decontaminate as D
from agorascope.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_force(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    ids |= wins[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_table_and_oracle(spark):
    got = sorted(map(tuple, QUERIES["op2_decontaminate"](spark, FOLDER).collect()), key=str)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert got == sorted(con.execute(ORACLES["op2_decontaminate"]).fetchall(), key=str)
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert got == by_force(docs, con.execute("SELECT * FROM benchmark").fetchall())
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_edges(spark):
    items = [(1, "One two three"), (2, None), (3, ""), (4, "a b c d e f g h i j k l"), (4, "uno"), (5, "c d e f g h i j k l"), (6, "Ünder"), (7, "one TWO three")]
    docs = [
        (1, None), (2, "..."), (3, "zero ONE, two. three four one two"), (None, "a b c d e f g h i j k l m"), (5, "b c d e f g h i j"),
        (5, "b c d e f g h i j"), (6, "x " * 20_000 + "one two three " * 3000 + "uno"), (7, "Ünder ünder"), (8, "a b c d e f g h i j j k l"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit("x")).withColumn("row", F.lit(2))
    got = sorted(map(tuple, D.report(frame, bench).collect()), key=str)
    assert got == by_force(docs, items)
    kept = D.clean(frame, bench)
    assert kept.columns == frame.columns
    clean = {(r[0]) for r in by_force(docs, items) if not r[5]}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in docs if d in clean)
    assert D.report(frame.limit(0), bench).count() == 0
    assert D.clean(frame.limit(0), bench).count() == 0
    assert {r.n_hit for r in D.report(frame, bench.limit(0)).collect()} == {0}
    assert D.clean(frame, bench.limit(0)).count() == len(docs)
