import hashlib
import random

from pyspark.sql import functions as F

from agorascope.llm import suffix_dedup as S

FOLDER = "/root/testdata/sf0.001"


def by_force(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - S.LEAST + 1):
            k = hashlib.blake2b(t[i : i + S.LEAST], digest_size=12).digest()
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - S.LEAST + 1):
            if seen[hashlib.blake2b(t[i : i + S.LEAST], digest_size=12).digest()] > 1:
                gone[i : i + S.LEAST] = b"\1" * S.LEAST
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs):
    return sorted(map(tuple, S.report(docs).collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = by_force([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == expected
    assert sum(r[2] > 0 for r in expected) > 5


def planted(rng):
    word = lambda n: "".join(rng.choice("abcdeü ") for _ in range(n))
    shared, edge = word(900), word(450)
    texts = [None, "", "x", word(399), "a" * 399, "a" * 401, "a" * 1500, "ab" * 700, "abc" * 150, word(3000)]
    texts += [word(rng.randrange(50)) + shared + word(rng.randrange(50)) for _ in range(8)]
    texts += [word(20) + edge[: rng.randrange(380, 450)] + word(20) for _ in range(8)]
    block = word(500)
    texts += [block + word(100) + block, block[:-1] + "!" + word(60), texts[9], texts[9][:1200] + "-" + texts[9][1200:]]
    texts += ["line of text\n" * 60, "x" + "line of text\n" * 50, shared[:400], shared[1:400]]
    return texts


def test_planted(spark):
    texts = planted(random.Random(4))
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("spans", F.lit(1))
    assert got(docs) == by_force(rows)
    assert S.report(docs.limit(0)).count() == 0


def test_frequent_anchors_and_segments(spark):
    rows = list(enumerate(planted(random.Random(8))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = S.MOST_GROUP, S.MOST_SORTED, S.SEGMENT
    try:
        S.MOST_GROUP = 3
        assert got(docs) == by_force(rows)
        S.MOST_SORTED = 3
        assert got(docs) == by_force(rows)
        S.SEGMENT = 700
        whole = [S.anchors((t or "").encode()) for _, t in rows]
        S.SEGMENT = 1 << 20
        assert whole == [S.anchors((t or "").encode()) for _, t in rows]
    finally:
        S.MOST_GROUP, S.MOST_SORTED, S.SEGMENT = kept


def test_groups_are_maximal_and_whole():
    rng = random.Random(6)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(2, 7))]
        pairs = sorted((t[i:], t[:i][::-1]) for t in texts for i in [rng.randrange(len(t))])
        found = {(a, b, tuple(sorted(m))) for a, b, m in S.repeat_groups([p[0] for p in pairs], [p[1] for p in pairs], 2)}
        expected = set()
        for a in range(15):
            for b in range(15):
                strings = {}
                for i, (ahead, behind) in enumerate(pairs):
                    if len(behind) >= a and len(ahead) >= b:
                        strings.setdefault((behind[:a], ahead[:b]), []).append(i)
                for m in strings.values():
                    left = {pairs[i][1][a : a + 1] for i in m} | ({b""} if any(len(pairs[i][1]) == a for i in m) else set())
                    right = {pairs[i][0][b : b + 1] for i in m} | ({b""} if any(len(pairs[i][0]) == b for i in m) else set())
                    ends = (len(left) > 1 or b"" in left) and (len(right) > 1 or b"" in right)
                    if len(m) > 1 and a + b >= 2 and ends:
                        expected.add((a, b, tuple(m)))
        assert found == expected


def test_reaches_against_all_pairs():
    rng = random.Random(7)
    for _ in range(300):
        n, least = rng.randrange(2, 40), rng.randrange(1, 12)
        letters = rng.choice((b"a", b"ab", b"abc"))
        base = bytes(rng.choice(letters) for _ in range(16))
        pairs = []
        for _ in range(n):  # near copies of one context, or random ones
            x = bytearray(base if rng.random() < 0.6 else bytes(rng.choice(letters) for _ in range(16)))
            x[rng.randrange(16)] = rng.choice(letters)
            pairs.append((bytes(x[8 : rng.randrange(8, 17)]), bytes(x[rng.randrange(9) : 8][::-1])))
        pairs.sort()
        ahead, behind = [p[0] for p in pairs], [p[1] for p in pairs]
        expected = {}
        for i in range(n):
            for j in range(n):
                right, left = S.common(ahead[i], ahead[j]), S.common(behind[i], behind[j])
                if i != j and left + right >= least:
                    a, b = expected.get(i, (0, 0))
                    expected[i] = (max(a, left), max(b, right))
        assert {i: (a, b) for a, b, i in S.covered(ahead, behind, least)} == expected


def test_large_groups_of_near_copies_take_little_time():
    rng = random.Random(9)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(800)) for _ in range(20)]
    pairs = []
    for k in range(20_000):
        x = bytearray(base[k % 20])
        for _ in range(rng.randrange(4)):
            x[rng.randrange(800)] = rng.randrange(65, 90)
        pairs.append((bytes(x[400:]), bytes(x[:400][::-1])))
    pairs.sort()
    assert len(list(S.covered([p[0] for p in pairs], [p[1] for p in pairs]))) > 15_000
