"""Byte-level BPE as a monoid: halves are encoded on their own, then joined at their common border.

Why a border can be settled locally: a token sequence is the encoding of its bytes exactly when each pair of
neighbours is the encoding of that pair's bytes, given that each token's own bytes encode to it (a test
checks this for the vocabulary). All neighbours inside either half are such pairs already. A window around
the border is encoded anew and grown until its first and last token are those that stood there before; then
every pair outside it is an old one, every pair inside comes from one encoding, and the whole is the encoding.

Two levels use this. A text is halved at a space between two other characters, which no match of the
pre-tokenizer's pattern can span, so texts of any length join by concatenation; a match is halved at any
byte and joined by windows. Decoding concatenates the parts up the same kind of tree.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm.common import in_batches, with_fields

LEAF_BYTES = 24  # a piece up to this length is merged directly
LEAF_CHARS = 1 << 18  # a text up to this length is one leaf
LEAF_IDS = 1 << 16  # ids decoded by one leaf
CACHE_PIECES = 1 << 18
CACHED_CHARS = 40


class Codec(dict):
    """Encodes and decodes by the lines of a rank file; the dict itself holds pieces already encoded."""

    def __init__(self, lines: bytes, pattern: str):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.parts = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.parts[rank] = token
        # the installed engine counts \x1c-\x1f as space; the pattern means Unicode white space
        white = r"\p{White_Space}"
        exact = pattern.replace(r"[^\s", f"[^{white}").replace(r"\S", rf"\P{{White_Space}}").replace(r"\s", white)
        self.matches = regex.compile(exact).findall
        border = rf"(?<=\P{{White_Space}}) (?=\P{{White_Space}})"
        self.border_after, self.border_before = regex.compile(border), regex.compile(f"(?r){border}")

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost first among equals."""
        ranks = self.ranks
        n = len(data)
        if n > 4 * LEAF_BYTES:
            return self._merge_long(data)
        find, none = ranks.get, len(self.parts)
        parts = [data[i : i + 1] for i in range(n)]
        pairs = [find(data[i : i + 2], none) for i in range(n - 1)]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            parts[i] = joined = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = find(joined + parts[i + 1], none)
            if i:
                pairs[i - 1] = find(parts[i - 1] + joined, none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for long windows: a heap of mergeable pairs over a linked list of parts."""
        ranks, n = self.ranks, len(data)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue  # a part of this pair has grown since
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(data[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : end[i]]])
            i = after[i]
        return ids

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two neighbouring encodings."""
        parts, reach = self.parts, 2
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.merge(b"".join([parts[t] for t in chain(left[i:], right[:j])]))
            if (not i or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            reach *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def __missing__(self, piece: str) -> list[int]:
        data = piece.encode()
        rank = self.ranks.get(data)
        ids = self.encode_bytes(data) if rank is None else [rank]
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def leaves(self, text: str) -> Iterator[str]:
        """The text in parts whose encodings concatenate to its own, halved until they are short.

        A part is cut at its border nearest to the middle. With all borders on one side of the middle, the other side is
        a leaf at once, so parts with borders halve each time.
        """
        waiting = [(0, len(text))]
        while waiting:
            start, end = waiting.pop()
            if end - start > LEAF_CHARS:
                middle = (start + end) // 2
                around = [self.border_after.search(text, middle, end), self.border_before.search(text, start, middle)]
                cuts = [m.start() for m in around if m and start < m.start()]
                if cuts:
                    cut = min(cuts, key=lambda c: abs(c - middle))
                    waiting += [(cut, end), (start, cut)]
                    continue
            yield text[start:end]

    def encode(self, text: str) -> array:
        ids = array("i")
        for leaf in self.leaves(text):
            ids.extend(array("i", list(chain.from_iterable(map(self.__getitem__, self.matches(leaf))))))
        return ids

    def count(self, text: str) -> int:
        return sum(sum(map(len, map(self.__getitem__, self.matches(leaf)))) for leaf in self.leaves(text))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.parts.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(maxsize=2)
def codec(lines: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(lines, pattern)


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The rank file's lines (under 1 MB, sent with the tasks) and the pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), pattern or public_tokenizers.PATTERN


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def _id_lists(coder: Codec, texts: pa.Array) -> pa.ListArray:
    found = [coder.encode(t or "") for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.frombuffer(x, np.int32) for x in found])))


def _byte_strings(coder: Codec, ids: pa.ListArray) -> pa.Array:
    return pa.array([coder.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in ids], pa.binary())


def _encode(lines: bytes, pattern: str):
    coder = codec(lines, pattern)
    return lambda batch: _with_column(batch, "token_ids", _id_lists(coder, batch.column("text")))


def _decode(lines: bytes, pattern: str):
    coder = codec(lines, pattern)
    return lambda batch: _with_column(batch, "decoded", _byte_strings(coder, batch.column("token_ids")))


def _both(lines: bytes, pattern: str):
    """Encoding, and decoding of the ids it gave, in one worker."""
    coder = codec(lines, pattern)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _id_lists(coder, batch.column("text"))
        return _with_column(_with_column(batch, "token_ids", ids), "decoded", _byte_strings(coder, ids))

    return step


def encode(docs: DataFrame, vocab: tuple[bytes, str]) -> DataFrame:
    """``docs`` and ``token_ids``: array of ints, the encoding of the whole ``text`` without special tokens.

    A null or empty text has no ids. Rows are independent: repeats, nulls elsewhere and extra columns pass
    through; a column of the name ``token_ids`` is replaced.
    """
    rows = docs.drop("token_ids")
    out = with_fields(rows.schema, "token_ids array<int>")
    return rows.mapInArrow(in_batches(functools.partial(_encode, *vocab)), out)


def decode(frame: DataFrame, vocab: tuple[bytes, str]) -> DataFrame:
    """``frame`` and ``decoded``: the bytes that its ``token_ids`` stand for; none for null or no ids."""
    rows = frame.drop("decoded")
    out = with_fields(rows.schema, "decoded binary")
    return rows.mapInArrow(in_batches(functools.partial(_decode, *vocab)), out)


def round_trip(docs: DataFrame, vocab: tuple[bytes, str]) -> DataFrame:
    """``docs``, ``token_ids`` of its ``text`` and ``decoded``, the bytes of these ids: encode and decode in one pass."""
    rows = docs.drop("token_ids", "decoded")
    out = with_fields(rows.schema, "token_ids array<int>, decoded binary")
    return rows.mapInArrow(in_batches(functools.partial(_both, *vocab)), out)


def digests(docs: DataFrame, vocab: tuple[bytes, str], keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``.

    Kept columns may have any name; one named like a new column is replaced by it.
    """
    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in keep if c.lower() not in new]
    packed = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    coded = round_trip(docs.select(packed, F.col("text").cast("string").alias("text")), vocab)
    listed = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select(
        *[F.col("row").getField(c).alias(c) for c in kept], F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
