"""Benchmark decontamination by a prefix-filtered containment join.

A window is ten consecutive words of a benchmark item, or the whole of a shorter item; its tokens are its
shingles of five words (the whole window if shorter). A window can only occur in a document that has all its
tokens, so for exact containment the necessary prefix is one token: the rarest, by occurrences in the whole
corpus. Document shingles meet windows by equality on that token only; its place in the window fixes where
the window would start (the positional bound), the document's length must reach its end (the length bound),
and the words found there are compared one by one.

Two passes over the documents: one counts the benchmark's tokens (summed within each batch before the
shuffle), one emits the occurrences of prefix tokens with the few words around them. Both skip other
shingles by a bitmap of at most 2**27 bits (16 MB), whatever the benchmark's size: a bit set by
chance only lets through a row that the join then drops.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agorascope.llm.common import digest, in_batches, stable, utf8, with_fields

WINDOW, SHINGLE = 10, 5
MOST_BITS = 27
CACHED_WORDS = 1 << 18

#: Word bytes are 0-9, a-z and all of 0x80 and above; A-Z become lower case, other bytes separate.
WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    n = len(words) - size + 1
    each = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    found = each[:n] + np.uint64(size)
    for i in range(1, size):
        found = found * np.uint64(0x9E3779B97F4A7C15) + each[i : n + i]
        found ^= found >> np.uint64(31)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(32))


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
        words = words_of(text)
        n = min(WINDOW, len(words))
        if not n:
            continue
        size = min(SHINGLE, n)
        hashes = shingle_hashes(words, size).view(np.int64)
        for i in range(len(words) - n + 1):
            rows.append((item, b" ".join(words[i : i + n]).decode(), n, size, hashes[i : i + n - size + 1]))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "words", "n", "size", "hashes"])


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n, size, hashes): all windows of all items; items without words have none."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return items.mapInArrow(in_batches(lambda: _windows), "item_id string, words string, n int, size int, hashes array<long>")


def _bitmap(hashes: DataFrame) -> tuple[bytes, int]:
    """Bits of the distinct values of the long column h: 32 a value, between 2**16 and 2**MOST_BITS in all."""
    n = hashes.select(F.approx_count_distinct("h")).first()[0]
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(32 * n + 1))))
    at = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("x"))
    parts = at.groupBy(F.shiftright("x", 15).alias("w")).agg(F.bitmap_construct_agg(F.col("x").bitwiseAND(F.lit(32767))).alias("b"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for w, b in parts.collect():  # parts of 32,768 bits: what comes to the driver is never more than the bitmap
        out[w << 12 : (w + 1) << 12] = np.frombuffer(b, np.uint8)
    return out.tobytes(), bits


def _known(words: list[bytes], sizes: list[int], bitmap: np.ndarray, bits: int):
    """(hash, position) of the shingles whose bit is set, for each size."""
    for size in sizes:
        if len(words) >= size:
            hashes = shingle_hashes(words, size)
            at = hashes >> np.uint64(64 - bits)
            where = np.flatnonzero((bitmap[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & 1)
            yield hashes[where].view(np.int64), where


def _count(shared, bits: int, sizes: list[int]):
    bitmap = np.frombuffer(shared.value, np.uint32)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        met = [h for t in utf8(batch.column(0)) for h, _ in _known(words_of(t), sizes, bitmap, bits)]
        values, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *met]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["h", "c"])

    return step


_FOUND = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("around", pa.string())]))


def _scan(shared, bits: int, sizes: list[int]):
    bitmap = np.frombuffer(shared.value, np.uint32)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals, found = [], []
        for text in utf8(batch.column(0)):
            words = words_of(text)
            rows = []
            for hashes, where in _known(words, sizes, bitmap, bits):
                for h, at in zip(hashes.tolist(), where.tolist(), strict=True):
                    first = max(0, at - WINDOW + 1)
                    rows.append({"h": h, "at": at, "first": first, "around": b" ".join(words[first : at + WINDOW]).decode()})
            totals.append(len(words))
            found.append(rows)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(totals, pa.int64()), pa.array(found, _FOUND)], [*batch.schema.names[1:], "n_words", "found"]
        )

    return step


def _matches(docs: DataFrame, benchmark: DataFrame, keep: list) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``docs`` (_row, the columns ``keep``, n_words), windows found (_row, start, n, words), all windows."""
    context = docs.sparkSession.sparkContext
    every = stable(windows(benchmark))
    sizes = [r.size for r in every.select("size").distinct().collect()]
    texts = docs.select(F.col("text").cast("string"))

    bits_of_all = _bitmap(every.select(F.explode("hashes").alias("h")))
    counting = functools.partial(_count, context.broadcast(bits_of_all[0]), bits_of_all[1], sizes)
    counts = texts.mapInArrow(in_batches(counting), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    tokens = every.select("words", "n", F.posexplode("hashes").alias("off", "h")).distinct()
    rarest = F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h", "off")).alias("m")
    prefix = tokens.join(counts, "h", "left").groupBy("words", "n").agg(rarest).where("m.c > 0").select("words", "n", "m.h", "m.off")
    prefix = stable(prefix)

    bits_of_prefix = _bitmap(prefix.select("h"))
    scanning = functools.partial(_scan, context.broadcast(bits_of_prefix[0]), bits_of_prefix[1], sizes)
    rows = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    out = with_fields(rows.drop("_text").schema, "n_words long, found array<struct<h:long,at:int,first:int,around:string>>")
    rows = stable(rows.mapInArrow(in_batches(scanning), out).withColumn("_row", F.monotonically_increasing_id()))

    start = F.col("at") - F.col("off")
    there = F.array_join(F.slice(F.split("around", " "), start - F.col("first") + 1, F.col("n")), " ")
    met = rows.select("_row", "n_words", F.inline("found")).join(prefix, "h")
    met = met.where((start >= 0) & (start >= F.col("first")) & (start + F.col("n") <= F.col("n_words"))).where(there == F.col("words"))
    return rows.drop("found"), met.select("_row", start.alias("start"), "n", "words").distinct(), every


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts and texts without words have no words and no hits. Items without words are never found. Items
    of one id count once; a null item_id adds hits but no item. Repeated rows each get a row; extra columns
    and null doc_ids play no part.
    """
    rows, met, every = _matches(docs, benchmark, [F.col("doc_id")])
    before = Window.partitionBy("_row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = met.select("_row", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    fresh = F.col("stop") - F.greatest("start", F.least(F.coalesce(F.max("stop").over(before), F.lit(0)), "stop"))
    hit = spans.withColumn("fresh", fresh).groupBy("_row").agg(F.sum("fresh").alias("n_hit"))
    owners = every.select("words", "item_id").distinct()
    items = met.select("_row", "words").distinct().join(owners, "words").groupBy("_row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return (
        rows.join(hit, "_row", "left").join(items, "_row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` with no word inside a benchmark window, with all their columns."""
    rows, met, _ = _matches(docs, benchmark, [digest().alias("_text_id")])
    bad = rows.join(met.select("_row").distinct(), "_row", "left_semi").select("_text_id").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest().alias("_text_id"))
    return packed.join(bad, "_text_id", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
met AS (SELECT DISTINCT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM place) JOIN win USING (words, n)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
