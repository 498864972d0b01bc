"""An inverted-file index for cosine neighbours: a table of vectors filed by cell, and joins that route many queries to it.

Cells are k-means centres, fitted on a bounded sample (``SAMPLE`` rows, by hash of the id); every row is filed. A vector that
lies almost as near to a second centre is filed there too (a spill row), so that a query on either side of the border
meets it. Cells are split into buckets by their counted size, so a cell that holds a third of all rows is many join
keys. The table is written once, partitioned by cell; a query reads the cells it probes.

Rows without a cosine (null, empty or all-zero vectors) are nobody's neighbours and are not filed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agorascope.functions.vectors import dot, unit
from agorascope.operators.paging import top_per_group
from agorascope.operators.vector_pairs import CELL_QUERIES, CELL_ROWS, best_of_cells, best_pairs, by_length
from agorascope.session import stored

MOST_LISTS = 4096  # centres travel with the tasks: at 512 dimensions 16 MB
SAMPLE = 100_000  # rows that fit the centres
BUCKET_ROWS = 50_000
TUNED = 256  # queries that set the number of probes
SPILL = 0.05  # a second centre this close in cosine gets the row too


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` (record_id, unit, home, bucket, cell), ``centres`` (cell, centre) and ``cells`` (cell, rows, buckets)."""

    rows: DataFrame
    centres: DataFrame
    cells: DataFrame
    lists: int


def lists_for(rows: int) -> int:
    return max(1, min(MOST_LISTS, round(math.sqrt(rows))))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(record_id, unit) of the rows that have a cosine."""
    return vectors.select("record_id", unit(F.col("vector")).alias("unit")).filter(F.col("unit").isNotNull())


def train(units: DataFrame, lists: int, seed: int = 7, iterations: int = 8) -> DataFrame:
    """(cell, centre): at most ``lists`` unit centres, from a sample taken by hash."""
    place = F.pmod(F.xxhash64("record_id", F.lit(seed)), F.lit(1 << 30))
    share = min(1.0, SAMPLE / max(1, units.count()))
    some = units.filter(place < int(share * (1 << 30))).select(array_to_vector("unit").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=iterations).fit(some)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centres = units.sparkSession.createDataFrame(rows, "cell int, centre array<double>")
    return centres.withColumn("centre", unit(F.col("centre"))).filter(F.col("centre").isNotNull())


def with_nearest_cells(units: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """``units`` and ``near``: the ``n`` cells nearest to ``unit``, best first, as structs (s, m) of cosine and negated cell.

    The centres, at most ``MOST_LISTS`` rows, go to the tasks, which score a slice of rows at once.
    """
    table = sorted((r.cell, r.centre) for r in centres.collect())
    cells, matrix = np.array([c for c, _ in table], np.int32), np.array([v for _, v in table], np.float64)
    schema = StructType([*units.schema.fields, *StructType.fromDDL("near array<struct<s: double, m: int>>").fields])
    at, first = units.columns.index("unit"), min(n, len(cells))

    def score(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                rows = batch.slice(k, 1024)
                s = np.full((rows.num_rows, len(cells)), np.nan)
                for d, (own, vectors, _) in by_length(pa.chunked_array([rows.column(at)]), False).items():
                    if d == matrix.shape[-1]:
                        s[own] = np.round(vectors @ matrix.T, 12)
                order = np.argsort(-s, axis=1, kind="stable")[:, :first]  # equal ones by cell
                best = pa.StructArray.from_arrays([pa.array(np.take_along_axis(s, order, 1).ravel(), from_pandas=True), pa.array(-cells[order].ravel())], ["s", "m"])
                near = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * first), best)
                yield pa.RecordBatch.from_arrays([*rows.columns, near], [*rows.schema.names, "near"])

    return units.mapInArrow(score, schema)


def build(vectors: DataFrame, lists: int | None = None, spill: float = SPILL, bucket_rows: int = BUCKET_ROWS, seed: int = 7) -> VectorIndex:
    """The index of all ``vectors`` (record_id, vector), written below the shared folder."""
    units = stored(unit_vectors(vectors), "units")
    lists = lists or lists_for(units.count())
    centres = train(units, lists, seed)
    near = with_nearest_cells(units, centres, 2).withColumn("home", -F.get("near", F.lit(0))["m"])
    taken = F.filter("near", lambda c: c["s"] >= F.get("near", F.lit(0))["s"] - spill)
    filed = near.select("record_id", "unit", "home", F.explode(F.transform(taken, lambda c: -c["m"])).alias("cell"))
    filed = stored(filed, "filed")
    cells = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).withColumn("buckets", F.ceil(F.col("rows") / bucket_rows).cast("int"))
    cells = stored(cells, "cells")
    place = F.pmod(F.xxhash64("record_id"), F.col("buckets")).cast("int")
    rows = filed.join(cells.select("cell", "buckets"), "cell").withColumn("bucket", place).drop("buckets")
    return VectorIndex(stored(rows.repartition("cell", "bucket"), "vector-index", "cell"), centres, cells, lists)


def tune(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int, target: float = 0.95) -> int:
    """The fewest probes that find the share ``target`` of the exact neighbours of a sample of ``queries``.

    About ``TUNED`` queries, by hash of their id, are answered exactly. Each of their neighbours tells how far down the query's
    list of cells its own cells stand; the counts of that are summed up.
    """
    place = F.pmod(F.xxhash64("query_id", F.lit(11)), F.lit(1 << 30))
    some = queries.filter(place < int(min(1.0, TUNED / max(1, queries.count())) * (1 << 30)))
    exact = stored(search_exact(vectors, some, k).select("query_id", "record_id"), "tuning")
    asked = some.select("query_id", unit(F.col("vector")).alias("unit")).filter(F.col("unit").isNotNull())
    order = with_nearest_cells(asked, index.centres, index.lists).select("query_id", F.posexplode(F.transform("near", lambda c: -c["m"])).alias("at", "cell"))
    needed = exact.join(index.rows.select("record_id", "cell"), "record_id").join(order, ["query_id", "cell"])
    counts = needed.groupBy("query_id", "record_id").agg((F.min("at") + 1).alias("p")).groupBy("p").count().orderBy("p").collect()  # a row a cell at most
    total, found = sum(r["count"] for r in counts), 0
    for r in counts:
        found += r["count"]
        if found >= target * total:
            return r.p
    return index.lists


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, record_id, similarity, rank): the ``k`` nearest of each of many ``queries`` (query_id, vector) in the cells it probes.

    A record never answers itself. A spill row counts only where its home cell is not probed as well, so no pair comes twice.
    The rows of a bucket are scored against the queries that probe it as matrices.
    """
    u = F.col("unit")
    asked = queries.select("query_id", unit(F.col("vector")).alias("unit")).filter(u.isNotNull())
    near = with_nearest_cells(asked, index.centres, probes)
    routed = near.select("query_id", u.alias("q"), F.transform("near", lambda c: -c["m"]).alias("probed")).withColumn("cell", F.explode("probed"))
    routed = routed.join(index.cells.select("cell", "buckets"), "cell").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).drop("buckets")
    rows = index.rows.select("record_id", "unit", "home", "cell", "bucket").filter("record_id IS NOT NULL")
    asks = routed.select("query_id", "q", "probed", "cell", "bucket").filter("query_id IS NOT NULL")
    kinds = dict(rows.dtypes)["record_id"], dict(asks.dtypes)["query_id"]
    met = best_of_cells(rows, asks, k, ["cell", "bucket"], kinds, 9, False)
    scored = met.select("query_id", "record_id", F.round("score", 9).alias("similarity"))
    return top_per_group(scored, ["query_id"], [F.desc("similarity"), F.asc("record_id")], k)


def search_exact(vectors: DataFrame, queries: DataFrame, k: int, block: int = CELL_QUERIES, rows_per_task: int = CELL_ROWS) -> DataFrame:
    """The same over all rows: queries in blocks of about ``block``, each block against every row.

    Blocks are copied to one cell for each ``rows_per_task`` rows, and scored there as matrices.
    """
    units = stored(unit_vectors(vectors), "units")
    asked = queries.select("query_id", unit(F.col("vector")).alias("vector")).filter(F.col("vector").isNotNull())
    pairs = best_pairs(units.withColumnRenamed("unit", "vector"), stored(asked, "asked"), k, 9, False, cell_rows=rows_per_task, cell_queries=block)
    scored = pairs.select("query_id", "record_id", F.round("score", 9).alias("similarity"))
    return top_per_group(scored, ["query_id"], [F.desc("similarity"), F.asc("record_id")], k)


def recall(found: DataFrame, exact: DataFrame) -> Column:
    """The share of exact neighbours that were found, as a scalar subquery."""
    hits = exact.select("query_id", "record_id").join(found.select("query_id", "record_id", F.lit(1).alias("hit")), ["query_id", "record_id"], "left")
    return hits.agg((F.count("hit") / F.count(F.lit(1))).alias("r")).scalar()
