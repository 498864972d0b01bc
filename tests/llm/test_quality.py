import re
from collections import Counter

from pyspark.sql import functions as F

from agorascope.llm import quality as Q

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_force(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = Counter(x for x in (text or "").split("\n") if WORD.search(x))
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(c - 1 for c in lines.values()), len(inside), failed


def base_of(rows):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]


def test_base_and_verdicts(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = Q.report(docs, labels).collect()
    assert base_of(got) == [by_force(texts[r.doc_id]) for r in got]
    kept = {r.doc_id: r.kept for r in got}
    assert not any(r.kept and r.base_failed for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    sound = {r.doc_id for r in got if not r.base_failed}
    good, bad = ([kept[d] for d, q in truth.items() if q == v and d in sound] for v in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_edges(spark):
    texts = [None, "", "  \n", "a b c a b c", "a b c d a b c", "x\n\nx\n x\ny\r\ny\r", "w " * 5000, "é\u00a0é \x1c # ö", " ".join(map(str, range(60))), "same line\n" * 3]
    rows = [(None if i == 2 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(4, 1), (4, 1), (None, 1), (1, None), (0, 0)], "doc_id long, quality int")
    got = Q.report(docs, labels).collect()
    assert sorted(base_of(got)) == sorted(map(by_force, texts))
    assert Q.report(docs.limit(0), labels).count() == 0
    assert sum(r.kept for r in Q.report(docs, labels.limit(0)).collect()) == sum(not by_force(t)[5] for t in texts)


def test_threshold_is_exact_and_ignores_order(spark):
    import random

    rng = random.Random(1)
    scores = [round(rng.gauss(0, 1), 6) for _ in range(3000)] + [None]
    for parts in (1, 7):
        rng.shuffle(scores)
        frame = spark.createDataFrame([(s,) for s in scores], "score double").repartition(parts)
        exact = sorted(round(s, 4) for s in scores if s is not None)[14]  # the 15th of 3000
        assert abs(Q.threshold(frame) - exact) < 1e-9
    assert Q.threshold(frame.limit(0)) == 0.0
