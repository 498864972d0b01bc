import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from agorascope.llm import toxicity as T

FOLDER = "/root/testdata/sf0.01"
SMALL = T.Setup(toxic=300, clean=600)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in T.report(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect() if not zlib.crc32(str(r.doc_id).encode()) % 5}
    right = sum(got[d].predicted == t for d, t in truth.items())
    assert right >= 0.95 * len(truth)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_a_misspelling_scores_like_the_word_it_resembles():
    rng = np.random.default_rng(3)
    plain = ["river", "stone", "morning", "letter", "window", "garden", "paper", "music"]
    texts, labels = [], []
    for i in range(400):
        words = rng.choice(plain, 30).tolist()
        if i % 2:
            words[rng.integers(30)] = "horrible"
        texts.append(" ".join(words).encode())
        labels.append(i % 2)
    model = T.train(texts, labels, T.Setup(epochs=8))
    long = b" ".join([b"river stone morning letter"] * 20_000)
    bad, near, fine, hidden, empty = T.score_texts([b"river horrible stone", b"river horribble stone", b"river stone", long + b" horrible", None], model)
    assert bad > 0.9 and near > 0.5 and fine < 0.2 and hidden > 0.9 and empty < 0.5
    one = T.score_texts([long + b" horrible"], model)
    assert abs(one[0] - hidden) < 1e-9


def test_parts_of_a_long_text_miss_no_window():
    model = T.Model(np.random.default_rng(1).normal(size=1 << 12).astype(np.float32), 0.1)
    words = [b"w%d" % (i * i % 977) for i in range(5000)]
    whole = T.worst_windows([words], model)[0][0]
    kept = T.PART_WORDS
    try:
        T.PART_WORDS = 100
        cut = T.score_texts([b" ".join(words)], model)[0]
    finally:
        T.PART_WORDS = kept
    assert abs(cut - 1 / (1 + np.exp(-whole))) < 1e-9


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "idiot words"), (4, "fine words"), (4, "fine words"), (5, "idiot " * 9), (6, "!!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_score", F.lit("x")).withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 1), (4, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = T.report(docs, labels, SMALL).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = T.clean(docs, labels, SMALL)
    assert kept.columns == docs.columns and kept.where("doc_id = 4").count() == 2
    assert T.report(docs.limit(0), labels, SMALL).count() == 0
    assert T.report(docs, labels.limit(0), SMALL).where("predicted = 1").count() == 0


def plain_score(text, model):
    """One text by plain loops: subwords of each word, repeats silenced, the worst window."""
    bits = len(model.weights).bit_length() - 1
    words = T.words_of(text.encode())
    each = []
    for i, word in enumerate(words):
        padded, weights = b" " + word + b" ", []
        for n in T.GRAMS:
            for k in range(len(padded) - n + 1):
                h = padded[k]
                for c in padded[k + 1 : k + n]:
                    h = (h * 0x01000193 ^ c) & 0xFFFFFFFF
                mixed = (h * 0x9E3779B1 + n) & 0xFFFFFFFF
                mixed ^= mixed >> 15
                weights.append(model.weights[(mixed * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - bits)])
        each.append(0.0 if word in words[max(0, i - T.WINDOW + 1) : i] else sum(weights) / max(1, len(weights)))
    windows = [sum(each[k : k + T.WINDOW]) for k in range(max(1, len(each) - T.WINDOW + 1))] if each else [0.0]
    return 1 / (1 + np.exp(-(max(windows) / T.WINDOW + model.bias)))


def test_whole_table_by_plain_loops():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    model = T.Model(np.random.default_rng(5).normal(size=1 << 12), -3.0)
    scored = T.score_texts([None if t is None else t.encode() for t in texts], model)
    for text, score in zip(texts, scored, strict=True):
        assert abs(score - plain_score(text or "", model)) < 1e-9


def test_training_holds_no_lists_of_all_words():
    texts = [b" ".join(b"%x" % (k * i % 251) for k in range(18_000)) for i in range(1, 161)]
    tracemalloc.start()
    try:
        T.train(texts, [i % 2 for i in range(160)], T.Setup(bits=10, width=2, epochs=2, least_steps=1))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 25 * sum(map(len, texts))
