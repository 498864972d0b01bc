"""Stored postings for full-text search: written once, read by term.

One row per (term, block of documents) holds the term's documents in that block with frequency, length and positions, and
two bounds, the largest frequency and the smallest length. Blocks are a hash of the document id, the same for all terms,
so the rows of several terms meet by block. The table is partitioned by a hash of the term: a query opens the
partitions of its own terms only. A frequent term is many rows, none larger than a block.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.functions.text import tokens
from agorascope.operators.textual import query_terms
from agorascope.params import P
from agorascope.session import stored

BLOCK_DOCS = 4096


@dataclass(frozen=True)
class Postings:
    """``rows`` (term, block, n, max_tf, min_len, entries, bucket) and the corpus's size and mean length."""

    rows: DataFrame
    documents: int
    mean_length: float
    buckets: int


def write(documents: DataFrame, text: Column, block_docs: int = BLOCK_DOCS, buckets: int | None = None) -> Postings:
    """The postings of ``documents`` (``id`` and what ``text`` needs), below the shared folder."""
    words = documents.select("id", tokens(text).alias("w"))
    total = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean")).first()
    n, blocks = total.n, max(1, math.ceil(total.n / block_docs))
    buckets = buckets or max(16, min(4096, math.ceil(n / 100_000)))
    # a document's words are grouped where it lies; rows travel once, to the task that writes their bucket
    placed = words.select("id", F.size("w").alias("len"), F.sort_array(F.transform("w", lambda t, i: F.struct(t.alias("t"), i.alias("p")))).alias("s"))
    starts = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda i: (i == 0) | (F.get("s", i)["t"] != F.get("s", i - 1)["t"]))
    ruled = placed.where("len > 0").select("id", "len", "s", starts.alias("a")).withColumn("z", F.concat(F.slice("a", F.lit(2), F.size("a")), F.array("len")))
    run = lambda a, z: F.struct(F.get("s", a)["t"].alias("term"), F.slice("s", a + 1, z - a)["p"].alias("positions"))
    each = ruled.select("id", "len", F.inline(F.zip_with("a", "z", run)))
    spots = each.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
    spots = spots.withColumn("part", F.col("block") % 16).repartition("bucket", "part")
    place = ["bucket", "part", "term", "block"]
    held = spots.groupBy(*place, "id", "len").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")).withColumn("tf", F.size("positions"))
    entry = F.struct("id", "tf", "len", "positions")
    rows = held.groupBy(*place).agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.sort_array(F.collect_list(entry)).alias("entries")
    )
    laid = rows.select("term", "block", "n", "max_tf", "min_len", "entries", "bucket").sortWithinPartitions("bucket", "term", "block")
    return Postings(stored(laid, "postings", "bucket"), n, float(total.mean or 0.0), buckets)


def of_terms(index: Postings, terms: list[str]) -> DataFrame:
    """The rows of these terms; only their partitions are opened."""
    mine = sorted({zlib.crc32(t.encode()) % index.buckets for t in terms})
    return index.rows.filter(F.col("bucket").isin(mine) & F.col("term").isin(terms))


def _weights(index: Postings, terms: list[str]) -> DataFrame:
    """(term, idf): a row for each term that occurs."""
    df = of_terms(index, terms).groupBy("term").agg(F.sum("n").alias("df"))
    return df.select("term", F.log(1.0 + (index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _saturation(index: Postings, tf: Column, length: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(index.mean_length)))


def _scored(index: Postings, rows: DataFrame, terms: list[str], k1: float, b: float) -> DataFrame:
    each = rows.join(F.broadcast(_weights(index, terms)), "term").select("term", "idf", F.inline("entries"))  # a row a term of the query
    parts = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("idf") * _saturation(index, F.col("tf"), F.col("len"), k1, b)).alias("s")))).alias("p"))
    whole = parts.filter(F.size("p") == len(terms))
    return whole.select("id", F.aggregate("p", F.lit(0.0), lambda s, x: s + x["s"]).alias("score"))


def search(index: Postings, query: str, k1: float = P.bm25_k1, b: float = P.bm25_b) -> DataFrame:
    """(id, score) of the documents that hold every term of the query, as ``textual.fulltext_search`` scores them."""
    terms = query_terms(query)
    return _scored(index, of_terms(index, terms), terms, k1, b)


def top(index: Postings, query: str, n: int, k1: float = P.bm25_k1, b: float = P.bm25_b) -> DataFrame:
    """The ``n`` best (id, score). Blocks whose bounds cannot reach the n-th score found in the most promising ones are not read.

    The bounds are read without the entries. Equal scores are ordered by id.
    """
    terms = query_terms(query)
    rows = of_terms(index, terms)
    most = F.col("idf") * _saturation(index, F.col("max_tf"), F.col("min_len"), k1, b)
    bounds = rows.select("term", "block", "max_tf", "min_len").join(F.broadcast(_weights(index, terms)), "term")
    bounds = bounds.groupBy("block").agg(F.count(F.lit(1)).alias("t"), F.sum(most).alias("bound")).filter(F.col("t") == len(terms)).select("block", "bound")
    bounds = stored(bounds, "bounds")
    first = bounds.orderBy(F.desc("bound"), "block").limit(max(4, n // 4))
    head = stored(_scored(index, rows.join(F.broadcast(first.select("block")), "block", "left_semi"), terms, k1, b), "head")
    least = head.orderBy(F.desc("score"), "id").limit(n).agg(F.when(F.count(F.lit(1)) == n, F.min("score")).alias("s")).scalar()
    rest = bounds.join(F.broadcast(first.select("block")), "block", "left_anti").filter(F.col("bound") >= F.coalesce(least, F.lit(0.0)) - 1e-9)
    tail = _scored(index, rows.join(rest.select("block"), "block", "left_semi"), terms, k1, b)
    return head.union(tail).orderBy(F.desc("score"), "id").limit(n)


def phrase(index: Postings, words: list[str]) -> DataFrame:
    """(id, start): where ``words`` stand one after another, by their stored positions."""
    wanted = list(dict.fromkeys(words))
    each = of_terms(index, wanted).select("term", F.inline("entries"))
    starts = [
        each.filter(F.col("term") == w).select("id", F.explode("positions").alias("p")).select("id", (F.col("p") - i).alias("start"))
        for i, w in enumerate(words)
    ]
    return reduce(lambda x, y: x.join(y, ["id", "start"]), starts).distinct()
