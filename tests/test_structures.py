"""Chain audits, postings, the name trie and the set-similarity join against brute force."""

import random

import regex
from pyspark.sql import functions as F

from agorascope.operators import chains, postings, textual


def test_links_of_any_shape(spark):
    rng = random.Random(3)
    links = {f"n{i:03}": None if rng.random() < 0.1 else f"n{rng.randrange(200):03}" for i in range(200)}
    links |= {f"long{i:03}": f"long{i - 1:03}" if i else None for i in range(150)} | {f"ring{i:03}": f"ring{(i + 1) % 77:03}" for i in range(77)}
    links |= {"tail1": "ring005", "tail2": "tail1", "self": "self"}
    reached, lost = chains.follow(spark.createDataFrame(list(links.items()), "id string, up string"))
    got = {r.id: (r.root_id, r.steps) for r in reached.collect()}, {r.id: (r.cycle_id, r.in_cycle) for r in lost.collect()}
    expected = {}, {}
    for start in links:
        path, at = [start], links[start]
        while at is not None and at not in path:
            path.append(at)
            at = links[at]
        if at is None:
            expected[0][start] = (path[-1], len(path) - 1)
        else:
            ring = path[path.index(at):]
            expected[1][start] = (min(ring), start in ring)
    assert got == expected


def test_many_short_rings_take_few_rounds(spark):
    rows = spark.range(600).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(F.col("id") - 1).cast("string").alias("up"))
    _, lost = chains.follow(rows)
    assert lost.filter("in_cycle").count() == 600
    # estimated sizes of joins are products: over ever more rounds these numbers would themselves fill the driver
    assert lost._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 400


def test_audit_of_no_versions(spark):
    none = spark.createDataFrame([], "id string, slug string, version int, previous_version_id string")
    assert chains.chain_audit(none).count() == 0 and chains.faulty_chains(none).count() == 0


def test_phrases_are_found_with_one_cut_of_each_text(spark):
    docs = spark.createDataFrame([(1, "One two, ONE two three"), (2, "two three"), (3, None), (4, "one")], "doc_id long, text string")
    held = textual.phrase_holders(docs, spark.createDataFrame([("one two",), ("two three",)], "value string"), 2)
    assert sorted((r.value, r.doc_id) for r in held.collect()) == [("one two", 1), ("two three", 1), ("two three", 2)]
    runs = [line for line in held._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in line]
    assert runs and not any("regexp_extract_all" in line for line in runs)


def test_postings_score_as_the_scan_does(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["uno", "dos", "tres", "Ünder", "x", "of"], [1, 5, 20, 3, 40, 9], k=rng.randrange(0, 40)))) for i in range(600)] + [(900, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = postings.write(docs, F.col("text"), block_docs=50, buckets=8)
    for query in ("uno", "uno dos", "ünder of TRES", "absent dos", "of", ""):
        expected = {r.id: round(r.score, 9) for r in textual.fulltext_search(docs, F.col("text"), query).collect()}
        assert {r.id: round(r.score, 9) for r in postings.search(index, query).collect()} == expected
        best = sorted(expected, key=lambda i: (-expected[i], i))[:7]
        assert [r.id for r in postings.top(index, query, 7).collect()] == best
    words = {i: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()) for i, t in rows}
    for wanted in (["x", "x", "tres"], ["uno"], ["dos", "of", "dos"]):
        starts = {(i, k) for i, w in words.items() for k in range(len(w)) if w[k : k + len(wanted)] == wanted}
        assert {tuple(r) for r in postings.phrase(index, wanted).collect()} == starts


def test_postings_open_only_the_partitions_of_the_query(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "id long, text string")
    index = postings.write(docs, F.col("text"), buckets=16)
    plan = postings.of_terms(index, ["word7"])._jdf.queryExecution().executedPlan().toString()
    assert regex.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan)
    few = postings.of_terms(index, ["word7"]).select(F.input_file_name()).distinct().count()
    assert few == 1


def test_trie_equals_the_join(spark):
    rng = random.Random(6)
    pool = ["Ann", "ann", "LEE", "lee", "c++", "C", "x-y", ",", ".net", "Ünal", "a1"]
    texts = [(i, rng.choice([" ", "", "-"]).join(rng.choices(pool, k=rng.randrange(0, 25)))) for i in range(200)] + [(500, None), (501, "")]
    names = [(1, "Ann Lee"), (2, "ann"), (3, "c++"), (4, ".NET"), (5, "ünal-a1"), (6, "lee lee"), (7, ""), (8, "++"), (9, None), (2, "lee"), (None, "c")]
    t, n = spark.createDataFrame(texts, "record_id long, text string"), spark.createDataFrame(names, "entity_id int, name string")
    trie, join = textual.extract_mentions(t, n), textual.extract_mentions(t, n, most_names=0)
    assert trie.columns == join.columns
    assert sorted(map(tuple, trie.collect())) == sorted(map(tuple, join.collect()))
    assert trie.count() > 100 and textual.extract_mentions(t.limit(0), n).count() == 0


def test_longest_names_win():
    trie = textual.NameTrie([(1, "new york"), (2, "york"), (3, "new york times"), (4, "times square")])
    text = "New York Times Square, York; new york"
    assert trie.found(text, longest=True) == [(3, 0, 14), (2, 23, 27), (1, 29, 37)]
    assert [m[0] for m in trie.found(text)] == [1, 3, 2, 4, 2, 1, 2]


def test_trie_is_linear_in_hits():
    trie = textual.NameTrie([(1, "ann"), (2, "ann lee")])
    assert len(trie.found("ann lee, " * 100_000)) == 200_000


def test_saturation_join_against_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 30))
        rows.append((str(i), rng.choice([1, 1, 1, 2, None]), rng.random() < 0.9, f"2024-01-{rng.randrange(1, 29):02} 0{rng.randrange(10)}:00:00", " ".join(words)))
    stories = spark.createDataFrame(rows, "id string, topic_id int, active boolean, t string, content string").withColumn("generated_at", F.to_timestamp("t"))
    run = stories.filter("cast(id as int) % 3 = 0").select("id")
    for least in (0.05, 0.3, 0.8, 1.0):
        got = {(r.candidate_id, r.id): r.jaccard for r in textual.saturated_candidates(stories, run, least, days=5).collect()}
        expected = {}
        for x in rows:
            for y in rows:
                a, b = set(x[4].split()), set(y[4].split())
                days = (int(x[3][8:10]) * 24 + int(x[3][11:13]) - int(y[3][8:10]) * 24 - int(y[3][11:13])) / 24
                if int(x[0]) % 3 == 0 and x[0] != y[0] and x[1] is not None and x[1] == y[1] and x[2] and y[2] and 0 <= days < 5 and a | b:
                    j = round(len(a & b) / len(a | b), 6)
                    if j >= least:
                        expected[x[0], y[0]] = j
        assert got == expected


def test_evidence_of_all_kinds_and_targets(spark):
    import __spark_entry__ as entry
    from agorascope.schemas import EVIDENCE_TARGETS, SIGNAL_KINDS

    rows = entry.queries()["signal_evidence_all"](spark, "/root/testdata/sf0.001").collect()
    kinds = {r.signal_key.split("|")[0] for r in rows}
    assert kinds <= set(SIGNAL_KINDS) and len(kinds) >= 9
    assert {r.target for r in rows} == set(EVIDENCE_TARGETS)
    total = {}
    for r in rows:
        total[r.signal_key] = total.get(r.signal_key, 0) + r.weight
    assert all(abs(t - 1) < 1e-6 for t in total.values())


def _plans_written(monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, *a, **k))
    return plans


def test_postings_travel_once(spark, monkeypatch):
    """One shuffle from the words to the files; repeated ids of one length are one entry, as before."""
    rows = [(1, "b a b"), (1, "c a a"), (2, "a"), (None, "a b"), (3, ""), (4, None), (5, "é Zz é")]
    plans = _plans_written(monkeypatch)
    index = postings.write(spark.createDataFrame(rows, "id long, text string"), F.col("text"), block_docs=2, buckets=4)
    assert plans[0].split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    got = {(r.term, r.id): (r.tf, r.len, r.positions) for r in index.rows.select("term", F.inline("entries")).collect()}
    assert got == {
        ("a", 1): (3, 3, [1, 1, 2]), ("b", 1): (2, 3, [0, 2]), ("c", 1): (1, 3, [0]), ("a", 2): (1, 1, [0]), ("a", None): (1, 2, [0]), ("b", None): (1, 2, [1]),
        ("é", 5): (2, 3, [0, 2]), ("zz", 5): (1, 3, [1]),
    }
    assert index.documents == 7


def test_low_similarities_shuffle_stories_not_shared_words(spark, monkeypatch):
    rows = [(str(i), 1, True, f"2024-01-{1 + i % 28:02} 00:00:00", " ".join(f"w{(i + k) % 40}" for k in range(30))) for i in range(120)]
    stories = spark.createDataFrame(rows, "id string, topic_id int, active boolean, t string, content string").withColumn("generated_at", F.to_timestamp("t"))
    run = stories.filter("cast(id as int) % 3 = 0").select("id")
    whole = sorted(map(tuple, textual.saturated_candidates(stories, run, 0.05).collect()))
    assert "Generate explode(_w" not in textual.saturated_candidates(stories, run, 0.05)._jdf.queryExecution().toString()
    monkeypatch.setattr(textual, "CELL_STORIES", 7)
    assert sorted(map(tuple, textual.saturated_candidates(stories, run, 0.05).collect())) == whole
    plans = _plans_written(monkeypatch)
    textual.saturated_candidates(stories, run, 0.05).collect()
    assert len(plans) == 2 and len(whole) > 500
    monkeypatch.setattr(textual, "LOW_JACCARD", 0.0)
    assert sorted(map(tuple, textual.saturated_candidates(stories, run, 0.05).collect())) == whole


def test_ngram_totals_come_from_the_counts(spark):
    texts = spark.createDataFrame([("a b a b", 2, 1), ("a b", 3, 0), ("c", 5, 5), (None, 1, 1), ("b c d", 0, 4)], "text string, recent long, baseline long")
    delta = textual.ngram_delta(texts, 1, 2, min_delta=-1.0, min_count=1)
    assert delta._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2  # once a use of the one shuffle, never for word counts
    got = {(r.n, r.ngram): (r.recent_n, r.baseline_n, round(r.delta, 6)) for r in delta.collect()}
    assert got[2, "a b"] == (7, 2, round(7 / 9 - 2 / 11, 6)) and got[1, "c"] == (5, 9, round(5 / 19 - 9 / 21, 6))


def test_shared_words_of_a_cell_are_counted_as_matrices(spark):
    """Frequent and rare words alike; low similarities intersect no arrays pair by pair, and repeated ids, null ids and dates are as before."""
    import pyarrow as pa

    from agorascope.operators.set_pairs import common_words

    rng = random.Random(5)
    lists = [[sorted({f"w{int(rng.paretovariate(0.4)) % 4000}" for _ in range(rng.randrange(90))}) for _ in range(n)] for n in (200, 130)]
    found = common_words(*(pa.array(x, pa.list_(pa.string())) for x in lists))
    assert [[int(x) for x in row] for row in found] == [[len({*a} & {*b}) for b in lists[1]] for a in lists[0]]
    rows = [("1", 1, "2024-01-05", "a b"), ("2", 1, "2024-01-06", "b c"), ("2", 1, "2024-01-06", "b c"), (None, 1, "2024-01-05", "a b"), ("3", 1, None, "a b"), ("4", None, "2024-01-06", "b"), ("5", 1, "2024-01-06", "")]
    stories = spark.createDataFrame(rows, "id string, topic_id int, t string, content string").withColumn("active", F.lit(True)).withColumn("generated_at", F.to_timestamp("t"))
    near = textual.saturated_candidates(stories, stories.select("id"), 0.05)
    assert sorted(map(tuple, near.collect())) == [(1, "2", "1", 0.333333)] * 2
    assert "array_intersect" not in near._jdf.queryExecution().optimizedPlan().toString()
