"""Lines repeated across documents, found by a sharded minimal perfect hash instead of a join of lines.

A line's key is the line without white space at its ends, in lower case. Each task sends one row for each distinct key
of a few MB of documents, so a line that a third of all documents hold reaches the count as one row a slice. Keys
that enough documents hold are dealt to shards by their hash, about ``SHARD_KEYS`` to each; a task builds the minimal perfect
hash of one shard: levels of bits in which a key owns the bit that no other key of its level hashes to, its
slot being the number of set bits before it. The slot indexes three flat arrays: a 64-bit fingerprint (independent of the
hash that picks the slot, so a line outside the index matches with a chance of 2**-64), the count, and the largest
doc_id, some 21 bytes a key in all. All other lines of the corpus need no entry: they fail the fingerprint.

Documents probe the arrays, a slice of lines at once. Arrays of at most ``MOST_BYTES`` in all are sent to every task and
documents stay where they are. Larger ones are never gathered: each shard is copied to ``COPIES`` tasks, the keys of
lines are dealt to (shard, copy) by hash and document, so a hot line spreads over the copies, and only the
keys to drop return to their documents.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm.common import in_batches, landed, stable, task_count, utf8

LEAST_CHARS, LEAST_DOCS = 20, 3
SHARD_KEYS = 1 << 16
MOST_BYTES = 64 << 20  # arrays sent to every task
COPIES = 16  # of a shard, beyond that
_SPARE = 2  # bits a key at each level
_LEVELS = 24  # keys without a bit of their own by then are listed
SPACES = b"\t\n\x0b\f\r "
NO_ID = -(1 << 63)  # a null doc_id: below all others


def keys_of(text: bytes, least: int = LEAST_CHARS) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has at least ``least`` code points."""
    found = []
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= least:
            key = line.strip(SPACES).lower()
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                found.append((i, key))
    return found


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each key, as rows (h, print)."""
    both = b"".join(map(xxhash.xxh3_128_digest, keys))
    return np.frombuffer(both, "<i8").reshape(-1, 2)


def _id(value: int | None) -> int:
    return NO_ID if value is None else value


def _count_keys(least: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        held: dict[bytes, list[int]] = {}
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            doc = _id(doc)
            for key in {k for _, k in keys_of(text, least)}:
                entry = held.setdefault(key, [0, doc])
                entry[0] += 1
                entry[1] = max(entry[1], doc)
        hashed = _hashes(list(held))
        counted = np.array(list(held.values()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (*hashed.T, *counted.T)], ["h", "mark", "n", "top"])

    return step


def repeated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h, mark, n, top): 128 bits, number of documents and largest doc_id of each key that enough documents hold."""
    rows = docs.mapInArrow(in_batches(functools.partial(_count_keys, least_chars)), "h long, mark long, n long, top long")
    return rows.groupBy("h", "mark").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(F.col("n") >= least_docs)


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Each key's bit among ``size`` at a level."""
    x = h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: slot 0 to n - 1 for each, any slot or -1 for other values."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left) and len(sizes) < _LEVELS:
            size = -(-_SPARE * len(left) // 64) * 64
            at = _place(left, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate([np.zeros(0, np.uint64), *levels]), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = _place(keys[open_], level, size) + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (self.bits[word] >> bit) & np.uint64(1) == 1
            lower = self.bits[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[open_[here]] = self.before[word[here]] + np.bitwise_count(lower)
            open_, base = open_[~here], base + size
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            listed = self.rest[at] == keys[open_]
            out[open_[listed]] = self.before[-1] + at[listed]
        return out


class Shard:
    """The arrays of one shard, indexed by its perfect hash."""

    def __init__(self, slots: PerfectHash, mark: np.ndarray, n: np.ndarray, top: np.ndarray):
        self.slots, self.mark, self.n, self.top = slots, mark, n, top

    @classmethod
    def build(cls, h: np.ndarray, mark: np.ndarray, n: np.ndarray, top: np.ndarray) -> Shard:
        """Keys that share all of h, a rare chance, are told apart by a list: the slot is of h with the mark mixed in."""
        slots = PerfectHash.build(_mixed(h, mark))
        order = np.argsort(slots.slots(_mixed(h, mark)))
        return cls(slots, mark[order], n[order], top[order])

    def found(self, h: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, top) per key; n is zero for a key that is not in the shard."""
        at = self.slots.slots(_mixed(h, mark))
        known = at >= 0
        known[known] = self.mark[at[known]] == mark[known]
        n, top = np.zeros(len(h), np.int64), np.full(len(h), NO_ID, np.int64)
        n[known], top[known] = self.n[at[known]], self.top[at[known]]
        return n, top

    def packed(self) -> dict[str, bytes]:
        s = self.slots
        arrays = {"sizes": np.array(s.sizes, np.int64), "bits": s.bits, "rest": s.rest, "mark": self.mark, "n": self.n.astype("<u4" if len(self.n) and self.n.max() < 1 << 32 else "<u8"), "top": self.top}
        return {k: v.tobytes() for k, v in arrays.items()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> Shard:
        words = {k: np.frombuffer(row[k], np.int64) for k in ("sizes", "mark", "top")}
        bits, rest = (np.frombuffer(row[k], np.uint64) for k in ("bits", "rest"))
        n = np.frombuffer(row["n"], "<u4" if len(row["n"]) == 4 * len(words["mark"]) else "<u8")
        return cls(PerfectHash(words["sizes"].tolist(), bits, rest), words["mark"], n, words["top"])


def _mixed(h: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return h.view(np.uint64) ^ (mark.view(np.uint64) >> np.uint64(32))


_PACKED = "shard int, sizes binary, bits binary, rest binary, mark binary, n binary, top binary"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    columns = [rows[c].to_numpy(np.int64) for c in ("h", "mark", "n", "top")]
    return pd.DataFrame([{"shard": rows["shard"].iloc[0], **Shard.build(*columns).packed()}])


def shard_bits(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n) / SHARD_KEYS)))


def shard_of(bits: int):
    """The shard of a hash: its highest bits."""
    return (F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)).cast("int")


def index(found: DataFrame) -> tuple[DataFrame, int]:
    """(one packed shard a row, bits of the shard number) for the rows of ``repeated``."""
    bits = shard_bits(found.count())
    return found.withColumn("shard", shard_of(bits)).groupBy("shard").applyInPandas(_build, _PACKED), bits


class Index:
    """All shards, for tasks that hold them whole."""

    def __init__(self, rows: list[dict], bits: int):
        self.bits, self.shards = bits, {r["shard"]: Shard.unpacked(r) for r in rows}

    def found(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, mark = (np.ascontiguousarray(c) for c in hashed.T)
        n, top = np.zeros(len(h), np.int64), np.full(len(h), NO_ID, np.int64)
        where = h.view(np.uint64) >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(h), np.uint64)
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for shard, held in self.shards.items():
            rows = order[edges[shard] : edges[shard + 1]]
            n[rows], top[rows] = held.found(h[rows], mark[rows])
        return n, top


_DONE = ["doc_id", "n_lines", "n_dropped", "kept"]
_DONE_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _without(text: bytes, dropped: set[int]) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    kept = text if not dropped else b"\n".join([x for i, x in enumerate(lines) if i not in dropped])
    return len(lines), len(dropped), kept


def _done(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _DONE_KINDS, strict=True)], _DONE)


def _probe(shared, bits: int, least: int):
    held = Index(shared.value, bits)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
        lines = [(row, i, key) for row, text in enumerate(texts) for i, key in keys_of(text, least)]
        n, top = held.found(_hashes([key for _, _, key in lines]))
        doc = np.array([_id(ids[row]) for row, _, _ in lines], np.int64)
        drop: list[set[int]] = [set() for _ in texts]
        for k in np.flatnonzero((n > 0) & (top != doc)).tolist():
            drop[lines[k][0]].add(lines[k][1])
        return _done([(d, *_without(t, gone)) for d, t, gone in zip(ids, texts, drop, strict=True)])

    return step


_KEY = "part int, shard int, kind int, h long, mark long, doc long, id binary, packed struct<sizes:binary,bits:binary,rest:binary,mark:binary,n:binary,top:binary>"


def _emit_keys(bits: int, copies: int, least: int):
    """One row for each distinct key of each document, dealt to a copy of the key's shard."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, ids, keys = [], [], []
        for doc, text, name in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            own = {k for _, k in keys_of(text, least)}
            keys += own
            docs += [_id(doc)] * len(own)
            ids += [name] * len(own)
        h, mark = (np.ascontiguousarray(c) for c in _hashes(keys).T)
        shard = (h.view(np.uint64) >> np.uint64(64 - bits) if bits else np.zeros(len(h))).astype(np.int32)
        copy = np.fromiter((x[0] % copies for x in ids), np.int32, len(ids))
        return pa.RecordBatch.from_arrays(
            [pa.array(shard * copies + copy, pa.int32()), pa.array(shard), pa.array(np.ones(len(h), np.int32)), pa.array(h), pa.array(mark), pa.array(docs, pa.int64()), pa.array(ids, pa.binary())],
            ["part", "shard", "kind", "h", "mark", "doc", "id"],
        )

    return step


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that each part starts with its shard: the keys to drop."""
    held, now = None, None
    for batch in batches:
        kinds, parts = batch.column("kind").to_numpy(), batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(kinds)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if kinds[a] == 0:
                held, now = Shard.unpacked(batch.column("packed")[a].as_py()), parts[a]
            elif now == parts[a]:
                h, mark, doc = (batch.column(c).slice(a, b - a).to_numpy() for c in ("h", "mark", "doc"))  # no nulls here
                n, top = held.found(h, mark)
                gone = pa.array((n > 0) & (top != doc))
                ids = batch.column("id").slice(a, b - a).filter(gone)
                yield pa.RecordBatch.from_arrays([ids, batch.column("mark").slice(a, b - a).filter(gone)], ["id", "mark"])


def _drop_listed(least: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, marks in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            gone = set()
            if marks:
                listed, lines = set(marks), keys_of(text, least)
                own = _hashes([k for _, k in lines])[:, 1].tolist()
                gone = {i for (i, _), m in zip(lines, own, strict=True) if m in listed}
            rows.append((doc, *_without(text, gone)))
        return _done(rows)

    return step


def _routed(rows: DataFrame, shards: DataFrame, bits: int, copies: int, least: int) -> DataFrame:
    named = rows.withColumn("id", F.substring(F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256)), 1, 16))
    emitting = functools.partial(_emit_keys, bits, copies, least)
    keys = named.mapInArrow(in_batches(emitting), "part int, shard int, kind int, h long, mark long, doc long, id binary")
    copied = shards.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "shard", F.struct(*shards.columns[1:]).alias("packed"))
    first = copied.select((F.col("shard") * copies + F.col("copy")).alias("part"), "shard", F.lit(0).alias("kind"), "packed")
    met = keys.unionByName(first, allowMissingColumns=True).repartition(task_count(rows.sparkSession), "part").sortWithinPartitions("part", "kind")
    met = met.select("part", "kind", "h", "mark", "doc", "id", "packed")
    gone = met.mapInArrow(_meet, "id binary, mark long").groupBy("id").agg(F.collect_set("mark").alias("marks"))
    return named.join(gone.hint("merge"), "id", "left").select("doc_id", "text", "marks").mapInArrow(in_batches(functools.partial(_drop_listed, least)), "doc_id long, n_lines long, n_dropped long, kept binary")


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most_bytes: int = MOST_BYTES, copies: int = COPIES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) per row of ``docs``: the bytes of its text without the repeated lines.

    A line goes if at least ``least_docs`` rows hold its key, the key has at least ``least_chars`` code points, and the row's
    doc_id is not the largest that holds it. A null text is one empty line; a null doc_id is smaller than all others; rows
    that share the largest doc_id all keep the line; repeated rows count each. Other columns play no part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    packed, bits = index(stable(repeated(rows, least_chars, least_docs)))
    shards = landed(packed, "shards")
    size = shards.select(F.sum(sum(F.length(c) for c in shards.columns[1:]))).first()[0] or 0
    if size > most_bytes:
        return _routed(rows, shards, bits, copies, least_chars)
    held = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in shards.collect()])
    return rows.mapInArrow(in_batches(functools.partial(_probe, held, bits, least_chars)), "doc_id long, n_lines long, n_dropped long, kept binary")


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    kept = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(3)]
    return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept)], [*_DONE[:3], "kept_sha256"])


def report(docs: DataFrame, **options: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256; ``dedup`` tells which lines go."""
    digests: Callable = in_batches(lambda: _digest)
    return dedup(docs, **options).mapInArrow(digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.top <> k.doc_id) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.top IS NULL OR g.top = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key GROUP BY k.doc_id
"""
