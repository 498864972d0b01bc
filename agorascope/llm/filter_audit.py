"""Filter interaction audit: contingency tensors per part, contracted by einsum for every order of the filters.

Each document fails some of five filters. Per part, the documents are counted by their 2x2x2x2x2 pattern of passed
(0) and failed (1) filters: that tensor holds all that any order of the filters can show. A step of an order contracts
each axis with one of three vectors: ``PASS`` for the filters before it, ``FAIL`` for its own, ``ALL`` for those after it.
The same tensor of the documents with a good or a toxic label gives what the step loses.

The tensors have 32 cells a part, so only counts leave the documents; a task contracts one part at a time.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm.common import in_batches, utf8

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # distinct words in a hundred
MOST_CAPITALS = 5  # capitals in a hundred code points
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
PASS, FAIL, ALL = (np.array(v, np.int64) for v in ([1, 0], [0, 1], [1, 1]))
MEASURES = ("n", "good", "toxic")


def own_failures(text: bytes, points: int) -> int:
    """Bits 0 to 3: the filters A to D that a text of so many code points fails."""
    words = text.split()
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * points,
        len(text.translate(None, MARKS)) < len(text),
    )
    return sum(f << i for i, f in enumerate(failed))


def _judge():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = pc.utf8_length(batch.column(0)).to_pylist()
        texts = utf8(batch.column(0))
        failed = [own_failures(t, n) for t, n in zip(texts, points, strict=True)]
        ids = [hashlib.sha256(t).digest() for t in texts]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(failed, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "part", "failed", "text_id"])

    return step


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) per row of ``docs``: bit i of ``failed`` is set if it fails filter i.

    E fails for every row whose text also stands under a smaller doc_id. A null doc_id is larger than all others. Rows
    that share the smallest doc_id of their text all pass it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    judged = rows.mapInArrow(in_batches(_judge), "doc_id long, part string, failed int, text_id binary")
    # one row a text and map task reaches the minimum; the join's key holds the doc_id too, so copies spread
    first = judged.groupBy("text_id").agg(F.min("doc_id").alias("first")).select(F.col("text_id").alias("t"), "first")
    same = (judged.text_id == first.t) & judged.doc_id.eqNullSafe(first["first"])
    late = F.when(F.col("t").isNull(), 1 << 4).otherwise(0)
    return judged.join(first.hint("merge"), same, "left").select("doc_id", "part", F.col("failed").bitwiseOR(late).alias("failed"))


def tensors(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): per part the counts (failed, n, good, toxic) of each pattern that occurs.

    A document is good or toxic if any row of ``labels`` with its doc_id says so; a null label or doc_id says nothing.
    """
    said = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(c) for c in ("quality", "toxic")]
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("d")).agg(*said)
    counted = judged.join(marks.hint("merge"), judged.doc_id == marks.d, "left").groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("lost")
    )
    return counted.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", F.col("lost").alias("toxic"))).alias("cells"))


def contract(tensor: np.ndarray, *axes: np.ndarray) -> int:
    """The sum over all cells of the 2x2x2x2x2 tensor, each axis weighted by its vector."""
    return int(np.einsum("abcde,a,b,c,d,e->", tensor, *axes))


def audit(tensor: dict[str, np.ndarray]) -> Iterator[tuple[str, int, dict[str, int]]]:
    """(order, step, counts) for each step of each order, of one part's tensors."""
    count = tensor["n"]
    one = {f: [FAIL if g == f else ALL for g in FILTERS] for f in FILTERS}
    only = {f: [FAIL if g == f else PASS for g in FILTERS] for f in FILTERS}
    failing = {f: contract(count, *one[f]) for f in FILTERS}
    unique = {f: contract(count, *only[f]) for f in FILTERS}
    seen: dict[tuple[frozenset, str], dict[str, int]] = {}
    rows = []
    for order in itertools.permutations(FILTERS):
        for k, f in enumerate(order):
            before = frozenset(order[:k])
            if (before, f) not in seen:
                axes = [PASS if g in before else FAIL if g == f else ALL for g in FILTERS]
                after = [PASS if g in before or g == f else ALL for g in FILTERS]
                removed = contract(count, *axes)
                seen[before, f] = {
                    "kept": contract(count, *after), "removed": removed, "redundant": failing[f] - removed, "unique_fails": unique[f],
                    "good_lost": contract(tensor["good"], *axes), "toxic_lost": contract(tensor["toxic"], *axes),
                }
            rows.append(("".join(order), k + 1, f, seen[before, f]))
    shapley = dict.fromkeys(FILTERS, 0)
    for _, _, f, counts in rows:
        shapley[f] += counts["removed"]
    for order, step, f, counts in rows:
        yield order, step, counts | {"shapley": shapley[f]}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def tensor_of(cells: list[dict]) -> dict[str, np.ndarray]:
    """The tensors of a part, axis i for filter i, from its counted patterns."""
    flat = {m: np.zeros(32, np.int64) for m in MEASURES}
    for cell in cells:
        for m in MEASURES:
            flat[m][cell["failed"]] += cell[m]
    return {m: v.reshape(2, 2, 2, 2, 2).transpose(4, 3, 2, 1, 0) for m, v in flat.items()}


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = list(audit(tensor_of(cells)))
            columns = [pa.array([part] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32())]
            columns += [pa.array([r[2][c] for r in rows], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: what the step keeps, removes, repeats and loses.

    The filters: A under 50 words; B distinct words under 65 in 100; C capitals over 5 in 100 code points; D any of
    ``#$%&*|``; E a copy of a smaller doc_id's text. A null text is empty, a null source the part of the empty string;
    repeated rows count each; an empty table has no parts and no rows. Other columns play no part.
    """
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return tensors(failures(docs), labels).mapInArrow(_audit, schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
least_id AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
flags AS (SELECT d.part, coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic, [
        len(d.w) < 50, 100 * len(list_distinct(d.w)) < 65 * len(d.w),
        100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t), regexp_matches(d.t, '[#$%&*|]'),
        d.doc_id IS DISTINCT FROM least_id.low] AS f
    FROM d JOIN least_id ON d.t = least_id.t LEFT JOIN lab ON d.doc_id = lab.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, o, s AS step, o[s] AS own, o[1:s - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
patterns AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, f),
counted AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE NOT f[own] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false)), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE f[own] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false)), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE f[own] AND coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false)), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE f[own] AND len(list_filter(f, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE f[own] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE f[own] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: f[i])), false)), 0) AS toxic_lost
    FROM patterns, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
