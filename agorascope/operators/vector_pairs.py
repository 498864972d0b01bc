"""The nearest rows of many queries, all against all: rows and queries are dealt into cells of bounded size that are scored as matrices.

Every query meets every row (of its group) in one cell. A cell is a block of rows and a block of queries, so its memory does not
grow with the table, and its matrix product only says which pairs may be among the best; these are scored again, term by
term, as ``functions.vectors`` does. The number of pairs is quadratic by nature; what is shuffled is a row a block of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_ROWS = 16_384
CELL_QUERIES = 16_384
AT_ONCE = 256  # queries of one matrix product


def by_length(column: pa.ChunkedArray, scaled: bool) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length to (positions, vectors, norms); vectors without a cosine (null, empty, zero, with a null or NaN in them) are left out."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        m = flat[starts[at][:, None] + np.arange(d)]
        norms = np.sqrt(_dots(m, m)) if scaled else np.ones(len(m))
        fine = norms > 0 if scaled else ~np.isnan(m).any(axis=1)
        found[d] = at[fine], m[fine], norms[fine]
    return found


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in order as ``functions.vectors.dot`` sums."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _first_of_each(k: int, *keys: np.ndarray) -> np.ndarray:
    """Positions of the first ``k`` of each run of equal keys; the last key only orders."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([key[order][1:] != key[order][:-1] for key in keys[:-1]])
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


def _scorer(k: int, digits: int, scaled: bool, unmeasured: bool, names: list[str]):
    margin, step = 2.0 * 10.0**-digits, 10.0**digits

    def score(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        apart = _met_elsewhere(key[0].as_py(), rows.column("home"), asked.column("probed")) if "home" in rows.column_names else []
        rows, asked = rows.select([0, 1]), asked.select([0, 1])
        ids, queries = (t.column(0).to_numpy(zero_copy_only=False) for t in (rows, asked))
        rank = np.unique(ids, return_inverse=True)[1]  # ids in their order, as numbers
        near, far, measured = by_length(rows.column(1), scaled), by_length(asked.column(1), scaled), np.zeros(len(queries), np.int64)
        qs, rs, ss = [], [], []
        for d, (q_at, q, q_norm) in far.items():
            r_at, m, m_norm = near.get(d, (np.zeros(0, np.int64), np.zeros((0, d)), np.zeros(0)))
            scaled_m = (m / m_norm[:, None]).T
            for a in range(0, len(q_at) if len(r_at) else 0, AT_ONCE):
                part = slice(a, a + AT_ONCE)
                s = (q[part] / q_norm[part][:, None]) @ scaled_m
                s[queries[q_at[part]][:, None] == ids[r_at][None, :]] = -np.inf
                for meets, stands in apart:
                    s[np.ix_(meets[q_at[part]], stands[r_at])] = -np.inf
                measured[q_at[part]] = np.count_nonzero(s > -np.inf, axis=1)
                least = np.partition(s, len(r_at) - k, axis=1)[:, len(r_at) - k] if len(r_at) > k else np.full(len(s), -np.inf)
                i, j = np.nonzero((s >= least[:, None] - margin) & (s > -np.inf))
                exact = _dots(q[part][i], m[j]) / (q_norm[part][i] * m_norm[j])
                # pairs that round to one value are ordered by id; near the middle of two values each score stands for itself
                place = exact * step
                halfway = np.abs(place - np.floor(place) - 0.5) < 1e-4
                value = np.where(halfway, exact, np.floor(place + 0.5))
                best = _first_of_each(k, i, halfway, value, rank[r_at[j]])
                qs.append(q_at[part][i[best]]), rs.append(r_at[j[best]]), ss.append(exact[best])
        if unmeasured:  # pairs without a cosine come after all others, in order of the rows' ids
            lacking = np.flatnonzero(measured < k)
            held = {d: set(at.tolist()) for d, (at, _, _) in near.items()}
            own = {p: d for d, (at, _, _) in far.items() for p in at.tolist()}
            order = np.argsort(rank, kind="stable").tolist() if len(lacking) else []
            for p in lacking.tolist():
                measures, added = held.get(own.get(p), ()), 0
                for r in order:
                    if added == k:
                        break
                    if r not in measures and ids[r] != queries[p]:
                        qs.append(np.array([p])), rs.append(np.array([r])), ss.append(np.array([np.nan]))
                        added += 1
        q, r, s = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((qs, np.int64), (rs, np.int64), (ss, np.float64)))
        return pa.table([asked.column(0).take(pa.array(q)), rows.column(0).take(pa.array(r)), pa.array(s, from_pandas=True)], names)

    return score


def _met_elsewhere(cell: int, homes: pa.ChunkedArray, probed: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each home other than ``cell``: which queries probe it, and which rows of this cell have it."""
    home, lists = homes.to_numpy(zero_copy_only=False), probed.to_pylist()
    others = {h: np.zeros(len(lists), bool) for h in np.unique(home).tolist() if h != cell}
    for i, cells in enumerate(lists):
        for h in cells:
            if h in others:
                others[h][i] = True
    return [(meets, home == h) for h, meets in others.items()]


def best_of_cells(rows: DataFrame, asked: DataFrame, k: int, cell: list[str], kinds: tuple[str, str], digits: int, scaled: bool, unmeasured: bool = False) -> DataFrame:
    """(query_id, record_id, score) of the best pairs of each cell (columns ``cell``).

    The first two columns of ``rows`` and ``asked`` are id and vector. A third one, the row's home and the cells a query probes,
    leaves out pairs that meet in the row's home, of the cells' first column, as well.
    """
    return rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(
        _scorer(k, digits, scaled, unmeasured, ["query_id", "record_id", "score"]), f"query_id {kinds[1]}, record_id {kinds[0]}, score double"
    )


def best_pairs(
    rows: DataFrame, asked: DataFrame, k: int, digits: int, scaled: bool, group: str | None = None, unmeasured: bool = False,
    cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES,
) -> DataFrame:
    """(query_id, record_id, score): pairs of a query and a row of its ``group``, among them each query's ``k`` best by the score at ``digits``.

    ``rows`` has ``record_id, vector``, ``asked`` ``query_id, vector``, and both the ``group`` if one is given. The score is the
    cosine, or with ``scaled`` off, for unit vectors, the dot product, which is not rounded; equal rounded scores are ordered by
    record_id. A row never answers a query of its own id. With ``unmeasured``, pairs without a cosine may fill up what is missing
    to ``k``, with NULL for the score. Both frames are counted, so they should be stored ones.
    """
    rows, asked = rows.filter("record_id IS NOT NULL"), asked.filter("query_id IS NOT NULL")
    shares, blocks = max(1, math.ceil(rows.count() / cell_rows)), max(1, math.ceil(asked.count() / cell_queries))
    key = F.lit(0) if group is None else F.col(group)
    share, block = F.pmod(F.xxhash64("record_id"), F.lit(shares)).cast("int"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    dealt_rows = rows.select("record_id", "vector", key.alias("_g"), share.alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    dealt_asked = asked.select("query_id", F.col("vector").alias("_q"), key.alias("_g"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_t"), block.alias("_b"))
    if group is not None:
        dealt_rows, dealt_asked = dealt_rows.filter("_g IS NOT NULL"), dealt_asked.filter("_g IS NOT NULL")
    kinds = dict(rows.dtypes)["record_id"], dict(asked.dtypes)["query_id"]
    return best_of_cells(dealt_rows, dealt_asked, k, ["_g", "_t", "_b"], kinds, digits, scaled, unmeasured)
