from pyspark.sql import functions as F

from agorascope.llm import url_rules as U

FOLDER = "/root/testdata/sf0.01"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    end = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), tail[:end]


def given(host, path):
    best = None
    for kind, name, start in U.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            if best is None or len(name + start) > len(best[0]):
                best = (name + start, kind)
    return best or (None, None)


def test_table(spark):
    pages, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("pages", "labels"))
    urls = {r.page_id: r.url for r in pages.collect()}
    got = U.report(pages, labels).collect()
    assert sorted(r.page_id for r in got) == sorted(urls)
    for r in got:
        assert (r.host, r.path) == split(urls[r.page_id])
        rule, kind = given(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (kind is None or r.verdict == kind)


def planted(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'site'}{i % 2}.example.com/{'win' if i % 2 else 'x'}/{i}") for i in range(120)]
    labels = [(i, 0 if i % 6 == 3 else 1) for i in range(120)]  # bad: spam1 together with win
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_mined_rules_equal_counting(spark):
    pages, labels = planted(spark)
    setup = U.Setup(support=0.05, fewest=4, confidence=0.9)
    rules = U.mine(pages, labels, setup).collect()
    assert rules and all(r.token in r.antecedent for r in rules)
    own = {r.page_id: set(r.t) for r in pages.select("page_id", U.tokens(F.col("url")).alias("t")).collect()}
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    for r in rules:
        has = {p for p, t in own.items() if set(r.antecedent) <= t}
        assert len(has & bad) >= 0.05 * len(own) and len(has & bad) >= 0.9 * len(has)
    got = {r.page_id: r.verdict for r in U.report(pages, labels, setup, rules=()).collect()}
    caught = {p for p, t in own.items() if any(set(r.antecedent) <= t for r in rules)}
    assert {p for p, v in got.items() if v == "block"} == caught == bad


def test_edges(spark):
    urls = [None, "", "no scheme", "HTTP://A.B.NET", "http://x.NET/", "a://b://c/d?e#f", "https://www.example.com/de/?q", "https://example.net/en/", "http://Ünet/x", "http://org/fr/1#?/", "http://?q=1", "http://net/?\n"]
    rows = [(None if i == 4 else i // 2, u) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule_id", F.lit(1))
    labels = spark.createDataFrame([(1, 0), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = U.report(pages, labels).collect()
    expected = sorted(str((*split(u), given(*split(u))[0])) for u in urls)
    assert sorted(str((r.host, r.path, r.rule)) for r in got) == expected
    assert U.report(pages.limit(0), labels).count() == 0
    assert U.report(pages, labels.limit(0)).count() == len(urls)


def test_shared_segments_do_not_multiply(spark):
    """Thirty segments that always come together: one item, and one rule that any of them answers to."""
    deep = "/".join(f"s{k}" for k in range(30))
    rows = [(i, f"http://a.example.com/{deep}/{i}" if i % 2 else f"http://b.example.com/x/{i}") for i in range(100)]
    pages = spark.createDataFrame([*rows, (900, "http://c.example.com/s7/other"), (901, "http://b.example.com/y")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(100)], "doc_id long, quality int")
    rules = U.mine(pages, labels, U.Setup(support=0.05, fewest=4, confidence=0.9)).select("rule_id", "antecedent", "members").distinct().collect()
    assert len(rules) == 1 and len(rules[0].antecedent) == 1 and len(rules[0].members[0]) == 31
    got = {r.page_id: r.verdict for r in U.report(pages, labels, U.Setup(support=0.05, fewest=4, confidence=0.9), rules=()).collect()}
    assert {p for p, v in got.items() if v == "block"} == {i for i in range(100) if i % 2} | {900}
