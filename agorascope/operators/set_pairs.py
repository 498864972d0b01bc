"""Word-set similarity of all stories of a cell with all candidates that meet there, counted as matrix products."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

AT_ONCE = 512  # stories and candidates of one matrix
WORDS_AT_ONCE = 1024
MEETINGS_AT_ONCE = 1 << 20


def _whole(column: pa.ChunkedArray) -> pa.Array:
    array = column.combine_chunks()
    return pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array


def common_words(rows: pa.Array, asked: pa.Array) -> np.ndarray:
    """How many words each of ``rows`` shares with each of ``asked``; both are lists of distinct strings.

    Words of many pairs are columns of two 0/1 matrices, whose product counts them; a rarer word adds one to each of its pairs.
    """
    shape = len(rows), len(asked)
    flat = [lists.flatten().cast(pa.large_string()) for lists in (rows, asked)]
    words = pa.concat_arrays(flat).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    sides = code[: len(flat[0])], code[len(flat[0]) :]
    owners = [np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)) for lists in (rows, asked)]
    held = [np.bincount(side, minlength=len(words.dictionary)) for side in sides]
    pairs = held[0] * held[1]
    often = np.flatnonzero(pairs * 64 > shape[0] * shape[1])
    found = np.zeros(shape, np.float32)  # exact: no list has 2**24 words
    for k in range(0, len(often), WORDS_AT_ONCE):
        place = np.full(len(pairs), -1)
        place[often[k : k + WORDS_AT_ONCE]] = np.arange(len(often[k : k + WORDS_AT_ONCE]))
        matrices = []
        for side, owner, n in zip(sides, owners, shape, strict=True):
            at = place[side]
            matrices.append(np.zeros((n, place.max() + 1), np.float32))
            matrices[-1][owner[at >= 0], at[at >= 0]] = 1
        found += matrices[0] @ matrices[1].T
    pairs[often] = 0
    by_word = np.argsort(sides[1], kind="stable")
    starts = np.cumsum(held[1]) - held[1]
    mine = np.flatnonzero(pairs[sides[0]])
    many = held[1][sides[0][mine]]
    ends = np.cumsum(many)
    a = 0
    while a < len(mine):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MEETINGS_AT_ONCE)))
        k, some = many[a:b], mine[a:b]
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        other = owners[1][by_word[np.repeat(starts[sides[0][some]], k) + step]]
        found += np.bincount(np.repeat(owners[0][some], k) * shape[1] + other, minlength=shape[0] * shape[1]).reshape(shape)
        a = b
    return found


def in_cell(least: float, micros: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows (topic_id, candidate_id, id, _i, _s): pairs of a story and a later candidate by less than ``micros``, the words they share and
    the sum of their sizes, where shared words are at least ``least`` of all.

    Stories are (topic_id, id, _t, _w), candidates (topic_id, candidate_id, _t, _w). A story is not paired with its own id.
    """

    def pairs(stories: pa.Table, asked: pa.Table) -> pa.Table:
        made = [pa.table([stories["topic_id"][:0], asked["candidate_id"][:0], stories["id"][:0], pa.array([], pa.int64()), pa.array([], pa.int64())], ["topic_id", "candidate_id", "id", "_i", "_s"])]
        for a in range(0, asked.num_rows, AT_ONCE):
            there = asked.slice(a, AT_ONCE)
            own, at, far = _whole(there["candidate_id"]), there["_t"].to_numpy(), _whole(there["_w"])
            m = far.value_lengths().to_numpy(zero_copy_only=False)
            for r in range(0, stories.num_rows, AT_ONCE):
                here = stories.slice(r, AT_ONCE)
                ids, t, words = _whole(here["id"]), here["_t"].to_numpy(), _whole(here["_w"])
                n = words.value_lengths().to_numpy(zero_copy_only=False)
                names = pa.concat_arrays([ids, own]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                common, both = common_words(words, far), n[:, None] + m[None, :]
                near = (common >= least * (both - common)) & (t[:, None] <= at[None, :]) & (t[:, None] > at[None, :] - micros)
                i, j = np.nonzero(near & (names[: len(ids)][:, None] != names[len(ids) :][None, :]))
                kept = here["topic_id"].take(pa.array(i)), own.take(pa.array(j)), ids.take(pa.array(i))
                made.append(pa.table([*kept, pa.array(common[i, j].astype(np.int64)), pa.array(both[i, j].astype(np.int64))], made[0].column_names))
        return pa.concat_tables(made)

    return pairs
