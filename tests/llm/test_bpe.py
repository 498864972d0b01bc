import base64
import hashlib
import random
import sys

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from agorascope.llm import bpe, token_counts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    return bpe.Codec(*bpe.vocabulary())


@pytest.fixture(scope="module")
def library():
    lines = bpe.vocabulary()[0].splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_encodes_to_itself(coder):
    assert [t for t, r in coder.ranks.items() if coder.merge(t) != [r]] == []


def test_tree_equals_direct_merging(coder):
    rng = random.Random(1)
    for _ in range(400):
        kind = rng.choice([b"a", b"ab", b"abcdefgh ", b"\xf0\x9f\x98\x80\xe2\x80", bytes(range(256)), b"thend ing"])
        data = bytes(rng.choice(kind) for _ in range(rng.randrange(0, 300)))
        parts = coder._merge_long(data)
        assert coder.encode_bytes(data) == parts
        assert coder.merge(data[:60]) == coder._merge_long(data[:60])


def test_every_character(coder, library):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 64):
        text = "a".join(chars[k : k + 64])
        if coder.encode(text).tolist() != library.encode_ordinary(text):
            for c in chars[k : k + 64]:  # characters newer than the older of the two Unicode tables may differ
                if coder.encode(f"a{c}b").tolist() != library.encode_ordinary(f"a{c}b"):
                    assert ord(c) > 0x3000 or ord(c) < 0x100, hex(ord(c))


def test_long_texts(coder, library):
    rng = random.Random(2)
    words = ["the", " ", "  ", "\n", "it's", "123", "ünder", "...", "\x1c", "\x85", "​", "日本", "😀"]
    texts = ["", "a" * 5000, " " * 3000, "é" * 3000, "ab" * 4000]
    texts += [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(20)]
    texts += ["".join(rng.choice(words) for _ in range(2000)) for _ in range(20)]
    small = bpe.LEAF_CHARS
    try:
        bpe.LEAF_CHARS = 50
        for t in texts:
            ids = coder.encode(t).tolist()
            assert ids == library.encode_ordinary(t)
            assert coder.decode(ids) == t.encode()
            assert coder.count(t) == len(ids)
    finally:
        bpe.LEAF_CHARS = small


def test_table(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, bpe.vocabulary(), ["doc_id"]).collect()}
    counts = {}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        counts[len(ids)] = counts.get(len(ids), 0) + 1
        line = " ".join(map(str, ids))
        assert got[r.doc_id] == (len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    hist = token_counts.histogram(token_counts.lengths(docs, bpe.vocabulary()))
    rows = hist.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == counts
    for r in rows:
        assert r.docs_at_least == sum(c for n, c in counts.items() if n >= r.n_tokens)
        assert r.tokens_at_least == sum(n * c for n, c in counts.items() if n >= r.n_tokens)
        assert r.truncated_total == sum(min(n, r.n_tokens) * c for n, c in counts.items())
    cut = {r.context_limit: r.truncated_total for r in token_counts.truncated_totals(hist, [1, 777, 10**6]).collect()}
    assert cut == {x: sum(min(n, x) * c for n, c in counts.items()) for x in (1, 777, 10**6)}
    ordered = sorted(n for n, c in counts.items() for _ in range(c))
    some = {r.share: r.n_tokens for r in token_counts.quantiles(hist, [0.5, 1.0]).collect()}
    assert some == {0.5: ordered[(len(ordered) + 1) // 2 - 1], 1.0: ordered[-1]}


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "x"), (4, "x"), (4, "x"), (5, "w " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token_ids", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    got = [(r.doc_id, r.n_tokens) for r in bpe.digests(docs, bpe.vocabulary(), ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (None, 1), (4, 1), (4, 1), (5, 50_001)], key=str)
    whole = bpe.decode(bpe.encode(docs, bpe.vocabulary()), bpe.vocabulary())
    assert whole.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    assert [bytes(r.decoded).decode() for r in whole.where("doc_id = 5").collect()] == ["w " * 50_000]
    assert bpe.digests(docs.limit(0), bpe.vocabulary(), ["doc_id"]).count() == 0
    hist = token_counts.histogram(token_counts.lengths(docs, bpe.vocabulary()))
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == {0: 2, 1: 3, 50_001: 1}
    empty = token_counts.histogram(token_counts.lengths(docs.limit(0), bpe.vocabulary()))
    assert empty.count() == 0
    assert token_counts.truncated_totals(empty, [5]).first().truncated_total == 0
    assert token_counts.quantiles(empty, [0.5]).first().n_tokens is None


def test_borders_on_one_side(coder, library):
    """10 MB whose borders all stand at one end: no deep recursion, no quadratic work."""
    text = "a " * 20_000 + "b" * 10_000_000
    assert len(list(coder.leaves(text))) <= 2 + len(text) // bpe.LEAF_CHARS
    assert "".join(coder.leaves(text)) == text and "".join(coder.leaves(text[::-1])) == text[::-1]
    short = "a " * 100_000 + "b" * 70_000
    for t in (short, short[::-1]):
        ids = coder.encode(t)
        assert coder.decode(ids.tolist()) == t.encode()
    assert coder.encode("a " * 200_000 + "b").tolist() == library.encode_ordinary("a " * 200_000 + "b")


def test_kept_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two", "x", "y", "z", "u")], "doc_id long, text string, n_tokens string, token_ids string, `a.b` string, decoded string")
    got = bpe.digests(docs, bpe.vocabulary(), [c for c in docs.columns if c != "text"])
    assert got.columns == ["doc_id", "token_ids", "a.b", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]
    row = got.first()
    assert (row["token_ids"], row["a.b"], row["decoded"], row["n_tokens"]) == ("y", "z", "u", 2)
