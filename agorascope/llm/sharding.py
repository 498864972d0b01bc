"""Shards by best-fit-decreasing bin packing of indivisible groups.

Documents of equal text are a group. Groups sorted by size enter the bin with the tightest room that holds them,
found in a balanced tree of the bins' remaining capacities; a new bin is opened if none has room. For a given
number of shards the smallest capacity that needs no further bin is found by bisection, which leaves the bins
nearly equal.

Packing is sequential, so what is packed is bounded: groups larger than a 2**-GRAIN_BITS share of all bytes are
items of their own (there are at most 2**GRAIN_BITS), the rest are put together by hash into at most as many
bundles, each of whole groups. A group too large for any bin of an even split can't stay whole in bins near
equal in size; it is cut into at most PIECES parts by a hash of doc_id, which are packed like groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.llm.common import digest, landed, text_or_empty
from agorascope.operators.positions import bucketed_positions

GRAIN_BITS = 14
PIECES = 256
SLOT_ROWS, MOST_SLOT_GROUPS = 1000, 1 << 16  # rows of a shard numbered together, and groups of them in a shard


class _Node:
    __slots__ = ("key", "high", "left", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.high, self.left, self.right = key, 1, None, None


def _high(node: _Node | None) -> int:
    return node.high if node else 0


def _turn(node: _Node, side: str, other: str) -> _Node:
    up = getattr(node, side)
    setattr(node, side, getattr(up, other))
    setattr(up, other, node)
    for x in (node, up):
        x.high = 1 + max(_high(x.left), _high(x.right))
    return up


def _even(node: _Node) -> _Node:
    node.high = 1 + max(_high(node.left), _high(node.right))
    lean = _high(node.left) - _high(node.right)
    if abs(lean) < 2:
        return node
    side, other = ("left", "right") if lean > 1 else ("right", "left")
    child = getattr(node, side)
    if _high(getattr(child, other)) > _high(getattr(child, side)):
        setattr(node, side, _turn(child, other, side))
    return _turn(node, side, other)


def _put(node: _Node | None, key: tuple[int, int]) -> _Node:
    if node is None:
        return _Node(key)
    side = "left" if key < node.key else "right"
    setattr(node, side, _put(getattr(node, side), key))
    return _even(node)


def _take(node: _Node, key: tuple[int, int]) -> _Node | None:
    if key != node.key:
        side = "left" if key < node.key else "right"
        setattr(node, side, _take(getattr(node, side), key))
        return _even(node)
    if node.left is None or node.right is None:
        return node.left or node.right
    next_up = node.right
    while next_up.left:
        next_up = next_up.left
    node.key, node.right = next_up.key, _take(node.right, next_up.key)
    return _even(node)


def _tightest(node: _Node | None, size: int) -> tuple[int, int] | None:
    """The smallest (room, bin) with room for ``size``."""
    best = None
    while node:
        if node.key[0] >= size:
            best, node = node.key, node.left
        else:
            node = node.right
    return best


def pack(sizes: Iterable[int], capacity: int, most_bins: int | None = None) -> list[int] | None:
    """The bin of each size (best fit, decreasing order, ties by place); None if more than ``most_bins`` are needed."""
    sizes = list(sizes)
    bins, tree, n = [0] * len(sizes), None, 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = _tightest(tree, sizes[i])
        if found is None:
            if n == most_bins or sizes[i] > capacity:
                return None
            found, n = (capacity, n), n + 1
        else:
            tree = _take(tree, found)
        bins[i] = found[1]
        tree = _put(tree, (found[0] - sizes[i], found[1]))
    return bins


def pack_evenly(sizes: list[int], shards: int) -> list[int]:
    """Bins 0 to shards - 1 by the smallest capacity, to a 10,000th of an even share, that needs no more."""
    low = max([1, -(-sum(sizes) // shards), *sizes])
    high, step = low, max(1, sum(sizes) // shards // 10_000)
    while (found := pack(sizes, high, shards)) is None:
        low, high = high, 2 * high
    while high - low > step:
        middle = (low + high) // 2
        if (now := pack(sizes, middle, shards)) is None:
            low = middle
        else:
            high, found = middle, now
    return found


def shards(docs: DataFrame, count: int) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law ``bytes``, shard, slot, grown_shard (null).

    A row's size is its text's UTF-8 bytes plus 8; null and empty texts are one group of rows of 8 bytes. Rows of
    equal text share a shard unless their group is larger than an even share. Repeated rows each get a row and
    a slot; slots count from 0 within a shard without gaps. A null doc_id is an id like others.
    """
    spark = docs.sparkSession
    size = (F.octet_length(text_or_empty()) + 8).cast("long")
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).cast("int")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), digest().alias("id"), piece.alias("piece"))
    rows = landed(rows, "sizes")

    parts = landed(rows.groupBy("id", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "parts")
    groups = parts.groupBy("id").agg(F.sum("bytes").alias("bytes"))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    share, grain = math.ceil(total / count), total / (1 << GRAIN_BITS)
    bundle: Column = F.pmod(F.xxhash64("id"), F.lit(1 << GRAIN_BITS)).cast("int")
    none = F.lit(None)

    large = groups.where(F.col("bytes") > grain).select("id", (F.col("bytes") > share).alias("cut"))  # 2**GRAIN_BITS rows at most
    cut = parts.join(F.broadcast(large.where("cut")), "id").select("id", "piece", none.cast("int").alias("bundle"), "bytes")
    whole = groups.where((F.col("bytes") > grain) & (F.col("bytes") <= share)).select("id", none.cast("int").alias("piece"), none.cast("int").alias("bundle"), "bytes")
    small = groups.where(F.col("bytes") <= grain).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    items = whole.union(cut).union(small.select(none.cast("binary").alias("id"), none.cast("int").alias("piece"), "bundle", "bytes"))
    listed = sorted(map(tuple, items.collect()), key=lambda r: (r[0] or b"", r[1] or 0, r[2] or 0))
    chosen = pack_evenly([r[3] for r in listed], count)
    schema = "id binary, piece int, bundle int, shard int"
    placed = [(bytes(r[0]) if r[0] is not None else None, r[1], r[2], b) for r, b in zip(listed, chosen, strict=True)]
    of = {k: F.broadcast(spark.createDataFrame([p for p in placed if kind(p)], schema)) for k, kind in (
        ("whole", lambda p: p[0] is not None and p[1] is None), ("cut", lambda p: p[1] is not None), ("small", lambda p: p[2] is not None)
    )}

    found = (
        rows.withColumn("bundle", bundle)
        .join(of["whole"].select("id", F.col("shard").alias("s1")), "id", "left")
        .join(of["cut"].select("id", "piece", F.col("shard").alias("s2")), ["id", "piece"], "left")
        .join(of["small"].select("bundle", F.col("shard").alias("s3")), "bundle", "left")
        .withColumn("shard", F.coalesce("s1", "s2", "s3"))
    )
    buckets = max(1, min(MOST_SLOT_GROUPS, rows.count() // SLOT_ROWS))
    bucket = F.pmod(F.xxhash64("id", "doc_id"), F.lit(buckets))
    numbered = bucketed_positions(found, ["shard"], bucket, [F.col("id"), F.col("doc_id")], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
