"""Near-duplicates by SimHash: one-wildcard variants of few segments, equality join, exact verification.

A fingerprint has 64 bits. Cut into three segments, two fingerprints that differ in at most four bits
differ in at most one bit of some segment, and two segments that differ in at most one bit share a
variant with one bit wiped out (a wildcard). So each distinct fingerprint is indexed under its 64 variants
(one per wiped bit), equal variants are joined, and the join condition counts the differing bits of the
whole fingerprint. No link is lost; nothing is sampled or capped.

Groups of copies are handled before that join. Equal fingerprints are one node. Fingerprints one bit apart
are linked through the value they share once that bit is wiped: such a value has two owners at most, so
this step is linear however dense a group is. Only fingerprints that share two segments with another one are
wiped, in the third. The join then only emits pairs of different one-bit
components, one row per pair of components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agorascope.llm.common import stable, task_count, utf8, with_fields
from agorascope.llm.components import connected_components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # (first bit, width)
BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text's UTF-8 bytes; zero for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(whole[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _add_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t) for t in utf8(batch.column("_text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(values)],
            [*batch.schema.names[1:], "_print"],
        )


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``_print``, the fingerprint as a signed long."""
    rows = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    kept = with_fields(rows.drop("_text").schema, "_print long")
    return rows.mapInArrow(_add_fingerprints, kept)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def wiped(prints: DataFrame) -> DataFrame:
    """(p, bit, rest): distinct long column ``p`` with one bit wiped, where another value may give the same rest.

    Values one bit apart are equal outside the segment of that bit, so only values that share the two other
    segments with another one are wiped, and only in this segment.
    """
    outside = [
        F.struct(F.lit(first).alias("first"), F.lit(first + width - 1).alias("last"), F.col("p").bitwiseAND(F.lit(_signed(~(((1 << width) - 1) << first) % (1 << 64)))).alias("same"))
        for first, width in SEGMENTS
    ]
    keys = prints.select("p", F.inline(F.array(*outside)))
    several = keys.groupBy("first", "same").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("first", "same")
    bits = keys.join(several, ["first", "same"], "left_semi").select("p", F.explode(F.sequence("first", "last")).alias("bit"))
    return bits.select("p", "bit", F.col("p").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)"))).alias("rest"))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): for distinct long column ``p``, pairs whose components are those of all links of at most 4 bits."""
    near = wiped(prints).groupBy("bit", "rest").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("a", "b")
    one_bit = stable(connected_components(near))
    nodes = stable(prints.join(one_bit, prints.p == one_bit.node, "left").select("p", F.coalesce("root", "p").alias("c")))
    nodes = nodes.repartition(task_count(prints.sparkSession), "p")  # small until the variants are made

    bit, flag = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"), F.expr("shiftleft(1L, bit)")
    masks = [_signed(((1 << width) - 1) << first) for first, width in SEGMENTS]
    mask = F.lit(masks[2])
    for (first, width), m in zip(SEGMENTS[:2][::-1], masks[:2][::-1], strict=True):
        mask = F.when(F.col("bit") < first + width, F.lit(m)).otherwise(mask)
    variants = nodes.select("p", "c", bit).withColumn("v", F.col("p").bitwiseAND(mask).bitwiseAND(F.bitwise_not(flag)))
    left = variants.select("bit", "v", F.col("p").alias("p1"), F.col("c").alias("c1"))
    right = variants.select("bit", "v", F.col("p").alias("p2"), F.col("c").alias("c2"))
    both = F.col("p1").bitwiseXOR(F.col("p2"))
    apart = [F.bit_count(both.bitwiseAND(F.lit(m))) for m in masks]
    # of the variants that a pair shares only the first one counts: that of the first segment that differs in one bit at most, at the wiped
    # bit that differs or, in equal segments, the first. No part of this is about one side alone, so both sides are the same and are dealt once
    (second, _), (third, _) = SEGMENTS[1:]
    segment = F.when(F.col("bit") < second, 0).when(F.col("bit") < third, second).otherwise(third)
    first_near = F.when(apart[0] <= 1, 0).when(apart[1] <= 1, second).otherwise(third)
    own = F.when(F.col("bit") < second, apart[0]).when(F.col("bit") < third, apart[1]).otherwise(apart[2])
    once = (segment == first_near) & ((F.col("bit") == segment) | (own == 1))
    close = (F.col("c1") > F.col("c2")) & (F.bit_count(both) <= MAX_BITS) & once
    # sizes are estimated without the variants, so by size either side may be taken for one to broadcast
    met = left.hint("merge").join(right, ["bit", "v"]).where(close)
    across = met.select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct()
    return across.union(one_bit.select(F.col("node").alias("a"), F.col("root").alias("b")))


def classes(prints: DataFrame) -> DataFrame:
    """(p, class): every distinct fingerprint with the smallest fingerprint that it is linked to, directly or not."""
    joined = connected_components(links(prints))
    return prints.join(joined, prints.p == joined.node, "left").select("p", F.coalesce("root", "p").alias("class"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    Fingerprints: words of the text in lower case (A-Z), shingles of four with repeats, XXH64 with seed 42,
    majority per bit. A null or empty text, or one without words, has fingerprint zero and links like any
    other. A text of fewer than four words is one shingle. Repeated rows each get a row. A null doc_id
    counts as larger than all others: a component of null ids only has a null component_id.
    """
    rows = stable(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]))
    prints = rows.groupBy(F.col("_print").alias("p")).agg(F.min("doc_id").alias("least"))
    named = stable(prints)
    found = stable(classes(named.select("p")))
    ids = named.join(found, "p").groupBy("class").agg(F.min("least").alias("component_id"))
    by_print = found.join(ids, "class").select(F.col("p").alias("_print"), "component_id")
    return rows.join(by_print, "_print").select(
        "doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with its own columns, that have the smallest doc_id of their component.

    A null doc_id is the largest. Rows with the same doc_id and fingerprint count as repeats: the one with the
    smallest text stays. Other columns play no part and may have any name.
    """
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("id"), "text")
    rows = with_fingerprints(held, ["row", "id"])
    found = stable(rows.groupBy(F.col("_print").alias("p")).agg(F.min("id").alias("least")))
    named = found.join(stable(classes(found.select("p"))), "p")
    first = named.groupBy("class").agg(F.min(F.struct(F.col("least").isNull(), "least", "p")).alias("m"))
    wanted = first.select(F.col("m.least").alias("w"), F.col("m.p").alias("p"))
    same = (rows["_print"] == wanted.p) & rows["id"].eqNullSafe(wanted.w)
    order = Window.partitionBy("_print", "id").orderBy("row.text")
    best = rows.join(wanted, same).withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select(*[F.col("row").getField(c).alias(c) for c in names])
