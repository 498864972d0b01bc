import hashlib
import random
import re
import zlib

import pytest
import verify

from agorascope.llm import prefix_trie

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string"


def by_force(rows):
    """A trie of dictionaries."""
    own = {}
    for c, n, r, t in rows:
        if c is not None:
            r, t = r or "", t or ""
            key = hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
            own.setdefault(c, []).append(((n is not None, n or 0, r, key), (r, t)))
    own = {c: [x for _, x in sorted(v, key=lambda v: v[0])] for c, v in own.items()}
    members = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + v[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, len(path)))
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    out = []

    def below(p):
        kids = [below(k) for k in children.get(p, [])]
        n = len(members[p])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves, saved = sum(k[0] for k in kids) or 1, sum(k[1] for k in kids) + (n - 1) * words
        ends = ",".join(str(c) for c, length in sorted(members[p]) if length == len(p))
        low = min(members[p])[0]
        up = str(min(members[p[:-1]])[0]) if p else "None"
        out.append((low, len(p), up, n, len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        below(())
    return sorted(out)


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as path", "1 as `a.b`")
    got = sorted((r[0], r[1], str(r[2]), *r[3:]) for r in prefix_trie.report(frame).collect())
    assert got == by_force(rows)
    return got


def test_every_case(spark):
    rows = [
        (None, 0, "user", "nobody's turn"), (1, None, "user", "first of all"), (1, 3, None, None), (1, 3, "user", "tie b"), (1, 3, "user", "tie a"), (1, 3, "user", "tie a"),
        (0, 0, "user", "hello there"), (0, 1, "assistant", "hi"), (20, 0, "user", ""), (21, 0, "", "user"), (22, 0, "user", " \t "), (45, 0, "user", "no base"), (46, 7, "user", "no base"),
        (-3, 0, "user", "below zero"), (-20, 0, "user", "base below zero"),
    ]
    rows += [(c, 0, "user", "only turn") for c in range(100, 140)]  # some lose their only turn
    rows += [(200, k, "user", f"turn {k} " + "word " * (k % 5)) for k in range(400)] + [(c, k, "user", f"turn {k} " + "word " * (k % 5)) for c in (240, 280) for k in range(200)]
    rows += [(300, 0, "user", "long " * 250_000), (320, 0, "user", "long " * 250_000)]
    got = check(spark, rows)
    assert max(r[1] for r in got) == 400


@pytest.mark.parametrize("most", [1, 7, 1 << 17])
def test_runs_of_any_size(spark, most, monkeypatch):
    rng = random.Random(most)
    monkeypatch.setattr(prefix_trie, "MOST_TURNS", most)
    rows = []
    for c in range(300):
        length = rng.randint(0, 7)
        rows += [(c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "b b", "c c c"])) for k in range(length)]
    rows += [(1000 + 20 * k, t, "user", "same all over") for k in range(200) for t in range(3)]
    # the runs' limit is read by workers, so the merge is also tried here
    paths = {}
    for i in range(400):
        path = b"".join(bytes([rng.randint(0, 1)]) * 16 for _ in range(rng.randint(0, 6)))
        paths.setdefault(path, []).append(i)
    ordered = sorted((p, [int(p[16 * k] + 1) for k in range(len(p) // 16)], len(ids), min(ids)) for p, ids in paths.items())
    merge, final, cut = prefix_trie.Merge(), [], max(1, min(most, len(ordered)))
    for k in range(0, len(ordered), cut):
        done, open_ = prefix_trie.contract(ordered[k : k + cut], k)
        final += done
        for _, side, run, lowest, path, parts in open_:
            merge.add(run, side, lowest, path, parts)
    merge.shut(0)
    above = {r[8:]: r[1] for r in merge.closed if r[2] is None}
    nodes = [r for r in merge.closed if r[2] is not None] + [(*r[:3], above[r[8:]] if r[8] is not None else r[3], *r[4:]) for r in final]
    expected = {}
    for path, ids in paths.items():
        for d in range(len(path) // 16 + 1):
            expected.setdefault(path[: 16 * d], []).extend(ids)
    assert sorted((r[2], r[1], r[4]) for r in nodes) == sorted((len(p) // 16, min(v), len(v)) for p, v in expected.items())
    kids = {p: sum(len(q) == len(p) + 16 and q.startswith(p) for q in expected) for p in expected}
    leaves = {p: sum(kids[q] == 0 and q.startswith(p) for q in expected) for p in expected}
    saved = {p: sum((len(v) - 1) * (q[-1] + 1) for q, v in expected.items() if q and q.startswith(p)) for p in expected}
    ups = {p: None if not p else min(expected[p[:-16]]) for p in expected}
    assert sorted((r[2], r[1], str(r[3]), *r[4:8]) for r in nodes) == sorted((len(p) // 16, min(v), str(ups[p]), len(v), kids[p], leaves[p], saved[p]) for p, v in expected.items())
    check(spark, rows)


def test_empty_table(spark):
    assert prefix_trie.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.report(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)).collect() == []


def test_whole_table_by_sql(spark):
    frame = prefix_trie.report(spark.read.parquet(f"{FOLDER}/conversations.parquet"))
    rows = [tuple(r) for r in frame.collect()]
    cursor = verify.connect(FOLDER).execute(prefix_trie.ORACLE)
    assert not verify.compare(frame.columns, rows, [d[0] for d in cursor.description], cursor.fetchall())
    assert max(r[3] for r in rows if r[1]) > 1
