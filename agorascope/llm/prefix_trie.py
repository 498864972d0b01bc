"""The prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

A turn becomes a 16-byte digest of its role and text, a conversation the string of these digests, so conversations that share
turns share a prefix and stand together once sorted. Equal conversations are one string with a count.

Forests. Spark deals the distinct strings by range and sorts each part. A task takes a run of them (``MOST_TURNS`` turns
or one conversation), measures the common prefix of each two neighbours, and joins the neighbours'
components by union-find in descending order of that depth. A merge of two components makes a branching node at the
depth of the edge, or adds to the node of that depth that a component already has on top. Between
two such nodes the trie doesn't branch; the nodes on the way are written out from the one below.

Boundaries. Only prefixes of a run's first or last string can go on in another run. Their counts are
partial, so a run contracts its forest to the paths of these two strings, with what is complete below each of
their nodes summed up, and all else is final. One streaming pass over the runs' pairs of paths, in order, merges the forests: a
stack holds the open path, and what the next string does not share with it is closed. It reads two strings a run
and never a conversation more.

The conversation ids that end at a node are listed in order by ranges of ids first; a node's digest is then made from
its ranges in turn, so no task holds all ids of a frequent conversation. A single conversation is held whole, at 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agorascope.llm.common import landed, stable, task_count

GROUP = 20  # conversations that borrow the first turns of the first of them
MOST_SHARED = 4  # less than so many turns are borrowed
TOKEN = 16  # bytes of a turn's digest
MOST_TURNS = 1 << 17  # of a run
RANGE_TURNS = 32  # the parts are dealt by so many first turns
ID_RANGE = 1 << 12  # conversation ids listed together
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, token, words): the turns of each conversation in order, from 0.

    Null turns come first; equal ones are ordered by role, then by the digest. Null roles and texts are empty. Rows without
    a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TOKEN)
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), token.alias("token"), words.alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "token")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "token", "words")


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its group."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(MOST_SHARED)).cast("int")


def rebuilt(listed: DataFrame) -> DataFrame:
    """(conv_id, path, words) per conversation of ``turns``: its own turns after those that it borrows."""
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))).alias("base")
    every = listed.select("conv_id").distinct().select("conv_id", base, borrowed(F.col("conv_id")).alias("h"))
    heads = listed.where(F.col("pos") < MOST_SHARED - 1).select(F.col("conv_id").alias("base"), "pos", "token", "words")
    lent = every.join(heads.hint("merge"), "base").where("pos < h").select("conv_id", "pos", "token", "words")
    own = listed.where(F.col("pos") >= borrowed(F.col("conv_id")))
    # a borrowed turn stands before position h, an own one at h or after it
    sequence = lent.union(own).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "words"))).alias("s"))
    path = F.unhex(F.array_join(F.transform("s.token", F.hex), ""))
    found = sequence.select("conv_id", path.alias("path"), F.col("s.words").alias("words"))
    missing = every.join(found.select("conv_id").hint("merge"), "conv_id", "left_anti")
    return found.union(missing.select("conv_id", F.lit(b"").alias("path"), F.array().cast("array<int>").alias("words")))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns at the start that two paths share."""
    n = min(len(a), len(b)) // TOKEN
    if a[: n * TOKEN] == b[: n * TOKEN]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low * TOKEN : mid * TOKEN] == b[low * TOKEN : mid * TOKEN]:
            low = mid
        else:
            n = mid
    return low


class Forest:
    """The branching and ending nodes of sorted distinct paths, by union-find over neighbours in descending depth.

    Node i < n is where path i ends; ``depth``, ``above`` (the node above, -1 for a top) and ``member`` (a path through it).
    """

    def __init__(self, lengths: list[int], shared: list[int]):
        n = len(lengths)
        self.depth, self.above, self.member = list(lengths), [-1] * n, list(range(n))
        group, top = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while group[i] != i:
                group[i] = group[group[i]]
                i = group[i]
            return i

        for edge in sorted(range(n - 1), key=lambda i: (-shared[i], i)):
            a, b = find(edge), find(edge + 1)
            u, v, at = top[a], top[b], shared[edge]
            # edges of one depth go from left to right, so only the left component can have that depth already
            if self.depth[u] == at:
                node = u
                self.above[v] = u
            else:
                node = len(self.depth)
                self.depth.append(at)
                self.above.append(-1)
                self.member.append(self.member[u])
                self.above[u] = self.above[v] = node
            group[b] = a
            top[a] = node


_NODE = "id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, run long, side int, at long"
_FIELDS = [f.split()[0] for f in _NODE.split(", ")]
#: Per node of a path: members, smallest member, complete children, leaves and tokens below, words, and whether conversations end there.
_PATH = "first binary, side int, run long, lowest long, path binary, parts array<struct<n:long,low:long,children:long,leaves:long,saved:long,words:long,ends:boolean>>"
_OUT = f"{_NODE}, {_PATH.replace('run long, ', '').replace('side int, ', '')}"


def _id_of(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: depth * TOKEN]).digest()[:TOKEN]


def contract(rows: list[tuple[bytes, list[int], int, int]], run: int) -> tuple[list[tuple], list[tuple]]:
    """(final nodes, the two open paths) of a run of sorted rows (path, words, conversations that end there, smallest of them)."""
    n = len(rows)
    lengths = [len(r[0]) // TOKEN for r in rows]
    forest = Forest(lengths, [common_turns(a[0], b[0]) for a, b in pairwise(rows)])
    size = len(forest.depth)
    count, low, ends = [0] * size, [None] * size, [False] * size
    for i, (_, _, c, least) in enumerate(rows):
        count[i], low[i], ends[i] = c, least, True
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    open_ = [0] * size  # bit 0: on the path of the first row, bit 1: of the last
    for bit, i in ((1, 0), (2, n - 1)):
        while i >= 0 and not open_[i] & bit:
            open_[i] |= bit
            i = forest.above[i]
    meet = common_turns(rows[0][0], rows[-1][0])
    sums: list[dict[int, list]] = [{}, {}]  # per side: depth -> children, leaves and tokens that are complete
    partial: list[dict[int, list]] = [{}, {}]
    done = []
    for v in sorted(range(size), key=lambda i: -forest.depth[i]):
        u, depth = forest.above[v], forest.depth[v]
        path, words, _, _ = rows[forest.member[v]]
        upper = forest.depth[u] if u >= 0 else -1
        if u >= 0:
            count[u] += count[v]
            low[u] = low[v] if low[u] is None else min(low[u], low[v])
        if open_[v]:
            side = 0 if open_[v] & 1 else 1
            for d in range(upper + 1, depth + 1):
                partial[side][d] = [count[v], low[v], ends[v] and d == depth]
            continue
        leaf, total = leaves[v] or 1, saved[v]
        for d in range(depth, upper, -1):
            total += (count[v] - 1) * words[d - 1]
            stop = d == depth
            first = d == upper + 1
            loose = first and bool(open_[u])
            above = low[v] if not first else None if loose else u
            side = None if not loose else 0 if open_[u] & 1 else 1
            done.append([_id_of(path, d) if stop and ends[v] else None, v, d, above, count[v], children[v] if stop else 1, leaf, total, run if loose else None, side, upper if loose else None, first and not loose])
        if open_[u]:
            held = sums[0 if open_[u] & 1 else 1].setdefault(upper, [0, 0, 0])
            for k, x in enumerate((1, leaf, total)):
                held[k] += x
        else:
            children[u] += 1
            leaves[u] += leaf
            saved[u] += total
    final = [(r[0], low[r[1]], r[2], low[r[3]] if r[11] else r[3], *r[4:11]) for r in done]
    paths = []
    for side, i in ((0, 0), (1, n - 1)):
        start = 0 if side == 0 else meet + 1
        path, words, _, _ = rows[i]
        if side and not partial[1]:
            break
        parts = []
        for d in range(start, lengths[i] + 1):
            c, least, end = partial[side][d]
            kids, leaf, total = sums[side].get(d, (0, 0, 0))
            parts.append({"n": c, "low": least, "children": kids, "leaves": leaf, "saved": total, "words": words[d - 1] if d else 0, "ends": end})
        paths.append((rows[0][0], side, run, start, path, parts))
    return final, paths


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, run = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        final, paths = contract(rows, part << 32 | run)
        empty = (None,) * 4
        lines = [(*r, *empty) for r in final]
        for first, side, number, lowest, path, parts in paths:
            lines.append((*(None,) * 8, number, side, None, first, lowest, path, parts))
        return _batch(lines)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and held + len(row[1]) > MOST_TURNS:
                yield out()
                rows, held, run = [], 0, run + 1
            rows.append(row)
            held += len(row[1]) + 1
    if rows:
        yield out()


_PART = pa.struct([("n", pa.int64()), ("low", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("ends", pa.bool_())])
_NODE_KINDS = [pa.binary(), *[pa.int64()] * 8, pa.int32(), pa.int64()]
_OUT_KINDS = [*_NODE_KINDS, pa.binary(), pa.int64(), pa.binary(), pa.list_(_PART)]


def _batch(lines: list[tuple], kinds: list = _OUT_KINDS) -> pa.RecordBatch:
    columns = list(zip(*lines, strict=True)) or [()] * len(kinds)
    names = [*_FIELDS, "first", "lowest", "path", "parts"][: len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


class Merge:
    """Merges the open paths of runs, in order; ``closed`` gets the nodes that are complete.

    Each open node holds its sums, the runs whose forests end in it, and its closed children, which wait for its smallest member.
    """

    def __init__(self) -> None:
        self.path, self.open, self.closed = b"", [], []

    def add(self, run: int, side: int, lowest: int, path: bytes, parts: list[dict]) -> None:
        shared = common_turns(self.path, path)
        self.shut(shared + 1 if self.open else 0)
        self.path = path
        while len(self.open) <= len(path) // TOKEN:
            self.open.append({"n": 0, "low": None, "children": 0, "leaves": 0, "saved": 0, "words": 0, "ends": False, "runs": [], "below": []})
        for d, part in enumerate(parts, lowest):
            node = self.open[d]
            for k in ("n", "children", "leaves", "saved"):
                node[k] += part[k]
            node["low"] = part["low"] if node["low"] is None else min(node["low"], part["low"])
            node["words"], node["ends"] = part["words"], node["ends"] or part["ends"]
            if part["children"]:
                node["runs"].append((run, side))

    def shut(self, least: int) -> None:
        """Closes the open nodes of at least this depth, the deepest first."""
        while len(self.open) > least:
            node, d = self.open.pop(), len(self.open)
            leaves = node["leaves"] or 1
            saved = node["saved"] + (node["n"] - 1) * node["words"]
            row = [_id_of(self.path, d) if node["ends"] else None, node["low"], d, None, node["n"], node["children"], leaves, saved, None, None, None]
            for child in node["below"]:
                child[3] = node["low"]
                self.closed.append(tuple(child))
            # what the runs' forests need to know of the node above them
            self.closed += [(None, node["low"], None, None, None, None, None, None, run, side, d) for run, side in node["runs"]]
            if self.open:
                above = self.open[-1]
                above["below"].append(row)
                above["children"] += 1
                above["leaves"] += leaves
                above["saved"] += saved
            else:
                self.closed.append(tuple(row))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merge = Merge()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("run", "side", "lowest", "path", "parts")), strict=True):
            merge.add(*row)
        if merge.closed:
            yield _batch(merge.closed, _NODE_KINDS)
            merge.closed = []
    merge.shut(0)
    if merge.closed:
        yield _batch(merge.closed, _NODE_KINDS)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over sorted (id, pieces of lists of ids): the digest of each whole list."""
    now, state = None, None
    for batch in batches:
        out = []
        for key, piece in zip(batch.column("id").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["id", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends_sha256"])


def ends(named: DataFrame) -> DataFrame:
    """(id, ends_sha256) for the rows (id, conv_id): the digest of each id's conv_ids, ascending and joined by commas."""
    block = F.floor(F.col("conv_id") / ID_RANGE).alias("block")
    pieces = named.groupBy("id", block).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("piece"))
    dealt = pieces.repartition(task_count(named.sparkSession), "id").sortWithinPartitions("id", "block")
    return dealt.select("id", "piece").mapInArrow(_ends, "id binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``rows`` (conv_id, path, words), one row a conversation."""
    texts = F.substring(F.unhex(F.sha2("path", 256)), 1, TOKEN).alias("id")
    held = stable(rows.select("conv_id", "path", "words", texts))
    whole = held.groupBy("path").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    parts = whole.repartitionByRange(task_count(rows.sparkSession), F.substring("path", 1, RANGE_TURNS * TOKEN)).sortWithinPartitions("path")
    runs = landed(parts.mapInArrow(_runs, _OUT), "runs")
    paths = runs.where("path is not null").select("first", "side", "run", "lowest", "path", "parts")
    merged = paths.repartition(1).sortWithinPartitions("first", "side").select("run", "side", "lowest", "path", "parts").mapInArrow(_merge, _NODE)
    merged = landed(merged, "merged")
    final = runs.where("path is null").select(*_FIELDS)
    above = merged.where("depth is null").select("run", "side", "at", F.col("conv_id").alias("found"))
    loose = final.where("run is not null").drop("parent_conv_id").join(above.hint("merge"), ["run", "side", "at"]).withColumnRenamed("found", "parent_conv_id")
    nodes = final.where("run is null").unionByName(loose).unionByName(merged.where("depth is not null")).drop("run", "side", "at")
    listed = ends(held.select("id", "conv_id"))
    ended = nodes.where("id is not null").join(listed.hint("merge"), "id")
    return nodes.where("id is null").withColumn("ends_sha256", F.lit(EMPTY)).unionByName(ended).drop("id")


def report(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id and its counts.

    Without any conversation there is no node. Repeated rows are turns of their own. Other columns play no part.
    """
    return trie(rebuilt(stable(turns(conversations))))


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, 0 AS k, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, list(sha256(strlen(role) || ':' || role || text)) OVER w AS path,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY k, pos)),
every AS (SELECT conv_id, depth, path, words FROM p UNION ALL SELECT conv_id, 0, [], 0 FROM c),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM every GROUP BY depth, path),
full_path AS (SELECT conv_id, max_by(path, depth) AS path FROM every GROUP BY conv_id),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM full_path GROUP BY path),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
own AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, path)),
up AS (SELECT path[1:d] AS path, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
    FROM (SELECT path, n_children, n_convs, words, unnest(range(0, depth + 1)) AS d FROM own) GROUP BY 1, 2)
SELECT own.conv_id, own.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, own.n_convs, own.n_children, up.n_leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens,
    sha256(coalesce(e.ids, '')) AS ends_sha256
FROM own JOIN up USING (depth, path) LEFT JOIN e ON e.path = own.path LEFT JOIN n above ON above.depth = own.depth - 1 AND above.path = own.path[1:own.depth - 1]
"""
