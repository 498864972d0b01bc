"""Cosine neighbours, centroids and cells over ``array<float>`` vectors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.functions.vectors import cosine, dot, norm, unit
from agorascope.operators.paging import top_per_group
from agorascope.operators.positions import salted_join
from agorascope.operators.vector_pairs import best_pairs
from agorascope.params import P
from agorascope.session import stored


def mean_vector(vector: str) -> Column:
    """Element-wise mean as an aggregate, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vector))))


def nearest(vectors: DataFrame, query: Column, k: int, exclude: int | None = None) -> DataFrame:
    """The ``k`` rows most similar to one vector (a constant or scalar subquery)."""
    rows = vectors if exclude is None else vectors.filter(F.col("record_id") != exclude)
    scored = rows.withColumn("_q", query).withColumn("similarity", cosine(F.col("vector"), F.col("_q"))).drop("_q")
    return scored.filter(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), "record_id").limit(k)


def vector_of(vectors: DataFrame, record_id: int) -> Column:
    """One record's vector as a scalar subquery (``record_id`` is unique)."""
    return vectors.filter(F.col("record_id") == record_id).select("vector").scalar()


def similar_records(vectors: DataFrame, record_id: int, k: int) -> DataFrame:
    """Exact neighbours of a stored record, itself left out."""
    return nearest(vectors, vector_of(vectors, record_id), k, exclude=record_id).select("record_id", "similarity")


def build_cells(vectors: DataFrame, lists: int = P.ann_lists, seed: int = 7, iterations: int = 10):
    """K-means cells: rows with ``cell``, and the (at most ``lists``) centres.

    Training and assignment run on Spark; only the centres come to the driver.
    """
    features = vectors.withColumn("features", array_to_vector(unit(F.col("vector"))))
    model = KMeans(k=lists, seed=seed, maxIter=iterations, featuresCol="features", predictionCol="cell").fit(features)
    return model.transform(features).drop("features"), np.array(model.clusterCenters())


def topic_centroids(vectors: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Mean vector and size of each topic."""
    return vectors.groupBy(topic).agg(mean_vector("vector").alias("centroid"), F.count(F.lit(1)).alias("n"))


def assign_topics_centroid(
    vectors: DataFrame, centroids: DataFrame, topics: int, min_similarity: float, block: int = 500
) -> DataFrame:
    """Nearest centroid per record; similarity is the confidence, ties go to the lower topic.

    ``topics`` is the number of centroids. They travel as array values of about ``block`` centroids,
    so each record is scored where it lies and the size of what travels is bounded however many
    topics there are.
    """
    blocks = max(1, -(-topics // block))
    best = []
    scored = vectors
    for i in range(blocks):
        part = centroids if blocks == 1 else centroids.filter(F.pmod(F.xxhash64("topic_id"), F.lit(blocks)) == i)
        packed = part.agg(F.collect_list(F.struct("topic_id", "centroid"))).scalar()
        scored = scored.withColumn("_c", packed).withColumn(f"_b{i}", F.array_max(F.transform("_c", _scored_centroid))).drop("_c")
        best.append(F.col(f"_b{i}"))
    top = best[0] if blocks == 1 else F.greatest(*best)
    scored = scored.withColumn("_best", top).filter(F.col("_best.s") >= min_similarity)
    return scored.select(
        "record_id", (-F.col("_best.t")).alias("topic_id"), F.lit("cluster").alias("method"), F.col("_best.s").alias("confidence")
    )


def _scored_centroid(c: Column) -> Column:
    return F.struct(F.round(cosine(F.col("vector"), c["centroid"]), 6).alias("s"), (-c["topic_id"]).alias("t"))


def assign_topics_cluster(vectors: DataFrame, clusters: int, seed: int = 7) -> DataFrame:
    """Topics from k-means clusters, with the cosine to the cluster's centre as confidence."""
    cells, centres = build_cells(vectors, clusters, seed)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in centres])
    own = cells.withColumn("_centre", F.get(table, F.col("cell")))
    return own.select(
        "record_id", F.col("cell").alias("topic_id"), F.lit("cluster").alias("method"),
        F.round(cosine(F.col("vector"), F.col("_centre")), 3).alias("confidence"),
        F.to_json(F.struct(F.col("cell").alias("cluster_id"))).alias("metadata"),
    )


def related_stories(stories: DataFrame, vectors: DataFrame, run: DataFrame, top: int) -> DataFrame:
    """Edges from every story of this ``run`` (column ``id``) to its ``top`` nearest in the topic.

    ``stories`` has ``id, topic_id`` and ``vector`` comes by ``id``. Only the run's stories ask, each once against the
    stories of its topic, which are dealt over several cells and scored as matrices. The reverse edge is not implied.
    """
    rows = stored(stories.join(vectors, "id").select("topic_id", F.col("id").alias("record_id"), "vector"), "story-vectors")
    focal = rows.join(run.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_semi")
    focal = stored(focal.select("topic_id", F.col("record_id").alias("query_id"), "vector"), "run-vectors")
    pairs = best_pairs(rows, focal, top, 3, True, group="topic_id", unmeasured=True)
    scored = pairs.select(F.col("query_id").alias("story_id"), F.col("record_id").alias("related_id"), F.round("score", 3).alias("similarity_score"))
    return top_per_group(scored, ["story_id"], [F.desc("similarity_score"), F.asc("related_id")], top)


def model_overlap(embeddings: DataFrame, a: str, b: str, record_id: int, k: int) -> DataFrame:
    """Coverage of two models, and how many of a record's ``k`` neighbours they share."""

    def one(model: str) -> DataFrame:
        return embeddings.filter(F.col("model_name") == model)

    left = similar_records(one(a), record_id, k).select("record_id")
    right = similar_records(one(b), record_id, k).select("record_id")
    shared = left.join(right, "record_id").agg(F.count(F.lit(1)).alias("shared")).scalar()
    return embeddings.filter(F.col("model_name").isin(a, b)).groupBy("model_name").agg(
        F.countDistinct("record_id").alias("records"), F.max("dimensions").alias("dimensions")
    ).withColumn("shared_neighbours", shared)


def novelty(vectors: DataFrame, split: Column, as_of: Column) -> DataFrame:
    """Distance of each new record to its topic's earlier centroid and to the other new records.

    ``vectors`` has ``record_id, topic_id, captured_at, vector``. The mean cosine to all other new
    records is the dot product with the sum of their unit vectors, so no pairs are formed.
    """
    t = F.col("captured_at")
    base = topic_centroids(vectors.filter(t <= split)).select("topic_id", "centroid")
    fresh = vectors.filter((t > split) & (t <= as_of)).withColumn("_u", unit(F.col("vector")))
    pooled = fresh.groupBy("topic_id").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("_u")))).alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    known = base.join(pooled, "topic_id")  # one row a topic
    rows = salted_join(fresh, known, ["topic_id"], ["record_id"])
    to_centroid = 1 - dot(F.col("_u"), F.col("centroid")) / norm(F.col("centroid"))
    to_recent = F.when(F.col("_n") > 1, 1 - (dot(F.col("_u"), F.col("_sum")) - 1) / (F.col("_n") - 1))
    return rows.select(
        "record_id", "topic_id", "captured_at", F.round(to_centroid, 6).alias("centroid_distance"),
        F.round(to_recent, 6).alias("recent_distance"),
    )
