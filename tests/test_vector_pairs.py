"""All-against-all neighbours in cells, against every pair by the column helpers."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorascope.functions.vectors import cosine
from agorascope.operators import vectorial


@pytest.mark.parametrize("cells", [(7, 5), (1000, 1000)])
def test_best_pairs_are_those_of_all_pairs(spark, cells):
    from agorascope.operators.vector_pairs import best_pairs

    rng = random.Random(4)
    rows = [(f"s{i:02}", i % 3, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(60)]  # small numbers: many equal scores
    rows += [("zero", 1, [0.0] * 3), ("none", 1, None), ("gap", 1, [1.0, None, 2.0]), ("short", 1, [1.0]), ("lone", 9, [1.0, 2.0, 3.0]), ("s01", 1, [1.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "record_id string, g int, vector array<float>")
    asked = frame.filter("record_id < 's30' OR record_id IN ('zero', 'short', 'lone')").withColumnRenamed("record_id", "query_id")
    got = best_pairs(frame, asked, 4, 3, True, "g", True, *cells)
    every = asked.withColumnRenamed("vector", "q").join(frame, "g").filter("record_id <> query_id").withColumn("score", cosine(F.col("vector"), F.col("q")))

    def best(pairs):
        order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 3)), "record_id")
        top = pairs.withColumn("rank", F.row_number().over(order)).filter("rank <= 4")
        return sorted((r.query_id, r.rank, r.record_id, -2 if r.s is None else r.s) for r in top.select("query_id", "rank", "record_id", F.round("score", 3).alias("s")).collect())

    assert best(got) == best(every)


def test_related_stories_meet_in_cells_not_as_pairs(spark):
    stories = spark.createDataFrame([(f"s{i}", 1) for i in range(30)], "id string, topic_id int")
    vectors = spark.createDataFrame([(f"s{i}", [float(i), 1.0]) for i in range(30)], "id string, vector array<float>")
    got = vectorial.related_stories(stories, vectors, stories.filter("id IN ('s3', 's7')").select("id"), 2)
    assert got.groupBy("story_id").count().filter("count = 2").count() == 2
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_scored_as_matrices(spark):
    from agorascope.operators import vector_index

    centres = spark.createDataFrame([(2, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0])], "cell int, centre array<double>")
    units = spark.createDataFrame([(5, [0.6, 0.8]), (6, [1.0, 0.0]), (7, [1.0])], "record_id long, unit array<double>")
    near = vector_index.with_nearest_cells(units, centres, 2)
    assert {r.record_id: [(c.s, -c.m) for c in r.near] for r in near.collect()} == {5: [(0.8, 2), (0.6, 0)], 6: [(1.0, 0), (1.0, 1)], 7: [(None, 0), (None, 1)]}
    assert "MapInArrow" in near._jdf.queryExecution().optimizedPlan().toString()
