"""Repeated passages by common-prefix interval trees over a sparse, distributed suffix array.

Sampling suffixes. Each string of LEAST bytes picks the start of its smallest-hashed GRAM-byte piece as its anchor
(the leftmost if equal). Equal strings pick the same anchor hash at the same offset, so only suffixes at anchors
have to be compared, and only those with an equal anchor hash; about one byte in 160 is an anchor. An anchor
carries the bytes to its left (reversed) and right that the strings picking it cover, so no string is lost.

Suffix array. Spark deals anchors by hash and sorts each part by (hash, bytes to the right): a suffix array of
these suffixes. A task streams over it, and a stack scan of the common-prefix lengths of neighbours yields the
intervals of the common-prefix tree. Within an interval, its suffixes are sorted by the bytes to the left and
scanned the same way: where left extensions stay equal for d bytes and differ beyond, d plus the prefix length
of at least LEAST is a repeat that can be extended neither way by all its occurrences, and every suffix of
the group is reported, not just neighbours.

Groups of copies. A whole text is handled once: tasks skip texts they have seen, and further copies are known to
be covered. Anchors that repeat at a short distance within a text (periodic text) are compared in place and only
the first one travels. In an interval tree of more than MOST_GROUP suffixes the nested intervals are not sorted anew
each: the tree is walked from its leaves, and where two intervals merge, the smaller one's suffixes look up the
larger one in the order of the bytes to the left; that gives each suffix the furthest bytes on either side that some repeat
covers, in about n log(n)**2 steps (``reaches``). An anchor hash with more than MOST_SORTED occurrences isn't sorted in one
task: equal contexts are counted as one class, and what is left is compared by 128-bit hashes dealt evenly, in blocks
of strings first and string by string only where a block is neither unique nor repeated as a whole. The result is the same.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm.common import digest, in_batches, landed, utf8

LEAST, GRAM = 400, 80
MOST_GROUP = 256  # suffixes whose maximal repeats are listed group by group
MOST_SORTED = 1 << 16  # suffixes of one anchor sorted in a task, some 50 MB
BLOCKS = (64, 8, 1)  # strings compared at once under frequent anchors
SEGMENT = 1 << 20  # starts handled at once in a long text
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    both = [np.full(n, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    for x in both:
        x[0] = 1
    return np.cumprod(both[0]), np.cumprod(both[1])


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` bytes."""
    n = len(data)
    power, inverse = _powers(max(n, SEGMENT + LEAST))
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power[:n], dtype=np.uint64)])
    m = n - size + 1
    found = (summed[size:] - summed[:m]) * inverse[:m]  # every run brought to the same power
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(32))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` keys, by block-wise prefix and suffix minima."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()[:n]
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(behind[: n - width + 1], ahead[width - 1 :])


def anchors(text: bytes) -> list[tuple[int, int, int, int]]:
    """(hash, position, first start, last start) for each anchor and the run of string starts that pick it."""
    found = []
    for base in range(0, max(0, len(text) - LEAST + 1), SEGMENT):
        data = np.frombuffer(text, np.uint8, min(len(text) - base, SEGMENT + LEAST - 1), base)
        hashes = rolling(data, GRAM)
        keys = (hashes & np.uint64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        at = (_smallest(keys, LEAST - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        edges = np.flatnonzero(np.diff(at)) + 1
        firsts, lasts = np.concatenate([[0], edges]), np.concatenate([edges, [len(at)]]) - 1
        place = at[firsts]
        for row in zip(hashes[place].view(np.int64).tolist(), (place + base).tolist(), (firsts + base).tolist(), (lasts + base).tolist(), strict=True):
            if found and found[-1][:2] == row[:2]:  # a run cut by the end of a segment
                row = (*row[:2], found.pop()[2], row[3])
            found.append(row)
    return found


def _anchor_rows(text: bytes) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Anchors to compare with other texts, and spans found to repeat at a short distance in this one."""
    rows, spans, last = [], [], None
    for row in anchors(text):
        if last and row[0] == last[0] and (d := row[1] - last[1]) <= LEAST and row[2] >= d and (
            text[row[2] : row[3] + LEAST] == text[row[2] - d : row[3] + LEAST - d]
        ):
            spans.append((row[2] - d, row[3] + LEAST))  # the strings of this anchor are those of the one before
        else:
            rows.append(row)
        last = row
    return rows, spans


_ANCHOR = "id binary, h long, at long, first long, last long"


def _find_anchors():
    seen: set[bytes] = set()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            if key in seen:
                continue
            seen.add(key)
            rows, spans = _anchor_rows(text)
            out += [(key, *r) for r in rows]
            out += [(key, None, None, a, b) for a, b in spans]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.binary(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["id", "h", "at", "first", "last"])

    return step


_CONTEXT = "id binary, h long, at long, first long, hot boolean, ahead binary, behind binary"
_KINDS = [pa.binary(), *[pa.int64()] * 3, pa.bool_(), pa.binary(), pa.binary()]


def _contexts():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, text, rows in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for r in rows:
                at, first = r["at"], r["first"]
                out.append((key, r["h"], at, first, r["hot"], text[at : r["last"] + LEAST], text[first:at][::-1]))
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)], ["id", "h", "at", "first", "hot", "ahead", "behind"])

    return step


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 16:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    while low < n and a[low] == b[low]:
        low += 1
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix tree of sorted strings; lcp[i] is that of strings i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, n in enumerate([*lcp, -1]):
        left = i
        while stack and stack[-1][0] > n:
            length, left = stack.pop()
            yield length, left, i
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, left))


def repeat_groups(ahead: list[bytes], behind: list[bytes], least: int = LEAST) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of the maximal repeats of at least ``least`` bytes.

    ``ahead`` is sorted; ``behind`` holds the bytes to the left, reversed.
    """
    lcp = [common(a, b) for a, b in zip(ahead, ahead[1:])]
    for right, first, last in intervals(lcp):
        if right + max(map(len, behind[first : last + 1])) < least:
            continue
        order = sorted(range(first, last + 1), key=behind.__getitem__)
        left_lcp = [common(behind[i], behind[j]) for i, j in zip(order, order[1:])]
        for left, i, j in intervals(left_lcp):
            members = order[i : j + 1]
            # differing to the right at once: else a deeper interval has the same members
            if left + right >= least and min(lcp[min(members) : max(members)]) == right:
                yield left, right, members


def reaches(ahead: list[bytes], behind: list[bytes], least: int = LEAST) -> list[int]:
    """For each context the most bytes of ``ahead`` that it shares with another one which shares, with the bytes behind,
    ``least`` in all; zero if there is none. ``ahead`` is sorted.

    Intervals of the common-prefix tree merge in descending depth. Each knows its members' places in the order of
    ``behind``; contexts that share enough behind them stand side by side there. A context is settled at its first,
    deepest, merge with a partner, and is not looked at again.
    """
    n, longest = len(ahead), max(map(len, behind))
    order = sorted(range(n), key=behind.__getitem__)
    place = [0] * n
    for k, i in enumerate(order):
        place[i] = k
    shared = [common(a, b) for a, b in zip(ahead, ahead[1:])]
    levels = [[common(behind[i], behind[j]) for i, j in zip(order, order[1:])]]
    while len(levels[-1]) > 1 << len(levels) - 1:  # minima of 2**level neighbours
        low, step = levels[-1], 1 << len(levels) - 1
        levels.append([min(x, y) for x, y in zip(low, low[step:])])
    steps = [(1 << k, level) for k, level in enumerate(levels)][::-1]

    def stretch(k: int, need: int) -> tuple[int, int]:
        first = last = k
        for step, level in steps:
            if first >= step and level[first - step] >= need:
                first -= step
            if last + step < n and level[last] >= need:
                last += step
        return first, last

    group, members, unsettled = list(range(n)), [[k] for k in place], [[k] for k in place]
    best = [0] * n

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for edge in sorted(range(n - 1), key=lambda i: -shared[i]):
        depth = shared[edge]
        if least - depth > longest:
            break
        small, large = sorted((find(edge), find(edge + 1)), key=lambda g: len(members[g]))
        others, waiting = members[large], unsettled[large]
        for k in members[small]:
            first, last = stretch(k, least - depth)
            at = bisect_left(others, first)
            if at < len(others) and others[at] <= last:
                best[order[k]] = best[order[k]] or depth
                a, b = bisect_left(waiting, first), bisect_right(waiting, last)
                for other in waiting[a:b]:
                    best[order[other]] = depth
                del waiting[a:b]
        left = [k for k in unsettled[small] if not best[order[k]]]
        for mine, theirs in ((members[small], others), (left, waiting)):
            if 8 * len(mine) < len(theirs):
                for k in mine:
                    insort(theirs, k)
            else:
                theirs += mine
                theirs.sort()
        group[small], members[small], unsettled[small] = large, [], []
    return best


def covered(ahead: list[bytes], behind: list[bytes], least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """(bytes to the left, bytes to the right, context) that repeats cover, of those contexts that have one."""
    right = reaches(ahead, behind, least)
    order = sorted(range(len(ahead)), key=behind.__getitem__)
    left = reaches([behind[i] for i in order], [ahead[i] for i in order], least)
    for i, reach in zip(order, left, strict=True):
        if reach or right[i]:
            yield reach, right[i], i


_REPEAT = "h long, number int, length long, id binary, start long"


def _scan_sorted(most_group: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over the sorted suffixes, one anchor hash at a time."""
    now, rows, out = None, [], []

    def close() -> None:
        if len(rows) > most_group:
            found = covered([r[2] for r in rows], [r[3] for r in rows])
            out.extend((now, k, left + right, rows[i][0], rows[i][1] - left) for k, (left, right, i) in enumerate(found))
        elif len(rows) > 1:
            for k, (left, right, members) in enumerate(repeat_groups([r[2] for r in rows], [r[3] for r in rows])):
                out.extend((now, k, left + right, rows[i][0], rows[i][1] - left) for i in members)

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["h", "number", "length", "id", "start"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("h", "id", "at", "ahead", "behind")]
        for h, *row in zip(*columns, strict=True):
            if h != now:
                close()
                now, rows = h, []
            rows.append(row)
        if out:
            yield batch_of()
    close()
    if out:
        yield batch_of()


_HOT = "id binary, h long, first long, back int, n int, whole binary, text binary"


def _hot_contexts():
    """Contexts with their hash, and with their bytes only where this task meets the context first."""
    seen: set[bytes] = set()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("id", "h", "first", "ahead", "behind")]
        for key, h, first, ahead, behind in zip(*columns, strict=True):
            text = behind[::-1] + ahead
            whole = hashlib.blake2b(text, digest_size=16, salt=len(behind).to_bytes(8, "big")).digest()
            out.append((key, h, first, len(behind), len(text) - LEAST + 1, whole, None if whole in seen else text))
            seen.add(whole)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["id", "h", "first", "back", "n", "whole", "text"])

    return step


_BLOCK = "whole binary, c long, back int, block int, core binary, span binary"


def _block_keys(size: int, parent: int):
    """Hashes of each block of ``size`` offsets from the anchor: of the bytes all its strings share, and of all its bytes.

    The latter is null for a block that the context's own strings fill only in part.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("whole", "c", "h", "back", "n", "text", "blocks")]
        for whole, c, h, back, n, text, parents in zip(*columns, strict=True):
            low = back - n + 1
            wanted = range(low // size, back // size + 1)
            if parents is not None:
                wanted = [b for p in parents for b in range(p * parent // size, (p + 1) * parent // size) if low // size <= b <= back // size]
            for b in wanted:
                near, far = b * size, b * size + size - 1
                place = h.to_bytes(8, "big", signed=True) + near.to_bytes(8, "big")
                core = hashlib.blake2b(text[back - near : back - far + LEAST], digest_size=16, salt=place).digest()
                full = near >= low and far <= back
                span = hashlib.blake2b(text[back - far : back - near + LEAST], digest_size=16, salt=place).digest() if full else None
                out.append((whole, c, back, b, core, span))
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["whole", "c", "back", "block", "core", "span"])

    return step


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """(id, start, stop) of the strings of frequent anchors that occur twice or more."""
    rows = landed(contexts.mapInArrow(in_batches(_hot_contexts), _HOT), "hot")
    counts = rows.groupBy("whole").agg(F.count(F.lit(1)).alias("c"))
    texts = rows.where("text is not null").dropDuplicates(["whole"]).select("whole", "h", "back", "n", "text")
    classes = landed(texts.join(counts, "whole"), "classes")
    asked, parent, found = classes.withColumn("blocks", F.lit(None).cast("array<int>")), 0, []
    for size in BLOCKS:
        keys = landed(asked.mapInArrow(in_batches(functools.partial(_block_keys, size, parent)), _BLOCK), "blocks")
        same = keys.where("span is not null").groupBy("span").agg(F.sum("c").alias("spans")).where("spans > 1")
        told = keys.join(same, "span", "left").withColumn("sure", F.col("spans").isNotNull())
        found.append(told.where("sure").select("whole", (F.col("back") - (F.col("block") + 1) * size + 1).alias("a"), (F.col("back") - F.col("block") * size).alias("b")))
        shared = told.groupBy("core").agg(F.sum("c").alias("cores"), F.bool_and("sure").alias("done")).where("cores > 1 and not done")
        left = keys.join(shared, "core", "left_semi").groupBy("whole").agg(F.collect_list("block").alias("blocks"))
        asked, parent = classes.join(left, "whole"), size
    several = rows.join(counts.where("c > 1"), "whole", "left_semi").select("id", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + LEAST).alias("stop"))
    # the strings of one anchor overlap, so the outermost repeated ones bound what is covered
    bounds = functools.reduce(DataFrame.union, found).groupBy("whole").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    inside = rows.join(bounds, "whole").select("id", (F.col("first") + F.col("a")).alias("start"), (F.col("first") + F.col("b") + LEAST).alias("stop"))
    return several.union(inside)


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): distinct texts (id, text, n copies), and (id, start, stop), byte spans that occur elsewhere too."""
    source = docs.select(digest().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = landed(source.mapInArrow(in_batches(_find_anchors), _ANCHOR), "anchors")
    texts = source.groupBy("id").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))

    near = found.where("h is null").select("id", F.col("first").alias("start"), F.col("last").alias("stop")).distinct()
    marks = found.where("h is not null").groupBy("h", "id", "at").agg(F.first("first").alias("first"), F.first("last").alias("last"))
    often = marks.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    wanted = marks.join(often, "h").groupBy("id").agg(F.collect_list(F.struct("h", "at", "first", "last", (F.col("c") > MOST_SORTED).alias("hot"))).alias("rows"))
    around = landed(texts.join(wanted, "id").select("id", "text", "rows").mapInArrow(in_batches(_contexts), _CONTEXT), "contexts")

    parts = around.where("not hot").select("h", "id", "at", "ahead", "behind").repartition("h").sortWithinPartitions("h", "ahead")
    groups = parts.mapInArrow(functools.partial(_scan_sorted, MOST_GROUP), _REPEAT)
    spans = groups.select("id", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    return texts, spans.union(near).union(_hot_spans(around.where("hot").select("id", "h", "first", "ahead", "behind")))


def _strip():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, text, n, spans in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if n > 1 and len(text) >= LEAST:
                spans = [{"start": 0, "stop": len(text)}]
            kept, end, runs = [], 0, 0
            for s in sorted(spans or [], key=lambda s: s["start"]):
                if s["start"] > end or not runs:
                    kept.append(text[end : s["start"]])
                    runs += 1
                end = max(end, s["stop"])
            kept.append(text[end:])
            out.append((key, len(text), runs, b"".join(kept)))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["id", "n_bytes", "n_spans", "kept"])

    return step


def strip(docs: DataFrame) -> DataFrame:
    """(id, n_bytes, n_spans, kept) per distinct text: what is left once all repeated bytes are gone."""
    texts, spans = repeats(docs)
    listed = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(listed, "id", "left").select("id", "text", "n", "spans").mapInArrow(
        in_batches(_strip), "id binary, n_bytes long, n_spans long, kept binary"
    )


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes; texts shorter than LEAST lose none. Copies of a text of LEAST bytes or more
    lose all of theirs. Repeated rows each get a row and count as copies; ids and extra columns play no part.
    """
    done = strip(docs).select("id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", digest().alias("id")).join(done, "id").drop("id")
