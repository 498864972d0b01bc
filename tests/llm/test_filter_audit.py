import itertools

import duckdb
import verify

from agorascope.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(60))


def by_force(rows, labels):
    """Plain loops: every order applied to every document."""
    import re

    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    flags = []
    for d, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [e for e, u, _ in rows if (u or "") == t and e is not None]
        flags.append((d, part or "", {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": any(d is None or e < d for e in same),
        }))
    out = []
    for part in {p for _, p, _ in flags}:
        mine = [x for x in flags if x[1] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if x[2][f]]
                left = [x for x in left if not x[2][f]]
                shapley[f] += len(gone)
                failing = [x for x in mine if x[2][f]]
                only = [x for x in failing if sum(x[2].values()) == 1]
                out.append((part, "".join(order), k + 1, len(left), len(gone), len(failing) - len(gone), len(only), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
        out = [(*r[:-1], shapley[r[-1]]) if r[0] == part else r for r in out]
    return sorted(out)


def check(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], DOCS).withColumnRenamed("lang", "failed")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.report(docs, marks).collect())
    assert got == by_force(rows, labels)
    return got


def test_every_case(spark):
    rows = [
        (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (None, LONG, None), (3, None, ""), (4, "", None), (5, "x " * 80, "a"),
        (6, LONG + " $", "a"), (7, LONG.upper(), "b"), (8, "é" * 10 + " A", "b"), (9, "tab\tand\x0bmore one", "b"), (None, "alone|", "c"), (None, "alone|", "c"),
        (10, "A #" + "b" * 1_200_000, "c"), (1, LONG, "a"),
    ]
    labels = [(1, 1, 0), (1, None, 1), (2, 0, 1), (None, 1, 1), (5, 1, None), (99, 1, 1), (7, 1, 1)]
    got = check(spark, rows, labels)
    assert len(got) == 4 * 600


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.report(docs, labels).collect() == []
    some = spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)
    assert filter_audit.report(some, labels).count() == 600


def test_counts_by_sql(spark):
    con = verify.connect("/root/testdata/sf0.001")
    folder = "/root/testdata/sf0.001"
    frame = filter_audit.report(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [tuple(r) for r in frame.collect()]
    cursor = con.execute(filter_audit.ORACLE)
    assert not verify.compare(frame.columns, rows, [d[0] for d in cursor.description], cursor.fetchall())
    assert any(r[4] for r in rows) and isinstance(con, duckdb.DuckDBPyConnection)
