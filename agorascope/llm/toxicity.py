"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's subwords are its byte n-grams of 3 to 5, with a space as border on either side, hashed into buckets
with a vector each. A word is the mean of its subwords' vectors, so an unseen misspelling shares most of a known
word's vectors; a window is the mean of its 64 words (a shorter text is padded with zero vectors), and a linear
softmax turns that mean into the probability of label 1. A text's score is that of its worst window, so one
passage counts the same in a text of ten words or ten million.

Vectors and softmax weights are trained together by Adagrad (the bias is a fixed prior) on one window of each sampled document:
random windows at first, then the worst under the model so far (which also mines hard clean windows). Only
that sample is bounded; every whole text is scored, one vectorised pass over its bytes. As both averages and
the logits are linear, scoring needs one number per bucket, which is what tasks are sent (1 MB).
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm.common import in_batches, utf8, with_fields

GRAMS = (3, 4, 5)
WINDOW = 64
SPACE = 0x20
#: ASCII letters (in lower case), digits and all bytes of other characters are word bytes.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else SPACE for b in range(256))
CHUNK_BYTES = 1 << 20  # bytes scored at once
CHUNK_WORDS = 1 << 14  # words whose subwords are held at once
BATCH_DOCS, BATCH_BYTES = 256, 1 << 21  # sampled texts whose worst windows are sought at once
PART_WORDS = 1 << 16  # words of a long text scored at once


@dataclass(frozen=True)
class Setup:
    """Training parameters. At most about ``toxic`` + ``clean`` labelled rows are sampled, by a hash of doc_id;
    of these only texts of up to ``most_chars`` characters train."""

    toxic: int = 1500
    clean: int = 3500
    most_chars: int = 200_000
    bits: int = 18
    width: int = 16
    prior: float = -3.0  # log-odds of a text without words, fixed: few words are no evidence of label 1
    balance: float = 1.0  # 1: both labels weigh the same in sum; 0: each document does
    epochs: int = 6
    least_steps: int = 500  # a small sample gets more epochs, to take this many steps
    batch: int = 64
    rate: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # the logit of label 1 less that of label 0, per bucket
    bias: float


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(WORD_BYTES).split()


def subwords(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of every subword of ``words``."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    gap = data == SPACE
    word = np.cumsum(gap) - 1
    values = data.astype(np.uint32)
    buckets, owners = [], []
    prefix, inside = values[:-1] * np.uint32(0x01000193) ^ values[1:], np.ones(len(data) - 1, bool)
    for n in range(3, max(GRAMS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        inside = inside[:m] & ~gap[n - 2 : n - 2 + m]  # no border but at either end
        prefix = (prefix[:m] * np.uint32(0x01000193)) ^ values[n - 1 :]
        where = np.flatnonzero(inside)
        mixed = prefix[where] * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed ^= mixed >> np.uint32(15)
        buckets.append((mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits))
        owners.append(word[where + 1])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def word_scores(words: list[bytes], model: Model) -> np.ndarray:
    bits = len(model.weights).bit_length() - 1
    found = np.zeros(len(words))
    for k in range(0, len(words), CHUNK_WORDS):
        some = words[k : k + CHUNK_WORDS]
        bucket, owner = subwords(some, bits)
        total = np.bincount(owner, model.weights[bucket], len(some))
        found[k : k + CHUNK_WORDS] = total / np.maximum(1, np.bincount(owner, minlength=len(some)))
    return found


def repeats(words: list) -> np.ndarray:
    """True for words that stand among the WINDOW - 1 words before."""
    keys = np.fromiter(map(hash, words), np.int64, len(words))
    order = np.argsort(keys, kind="stable")
    near = (keys[order[1:]] == keys[order[:-1]]) & (order[1:] - order[:-1] < WINDOW)
    found = np.zeros(len(words), bool)
    found[order[1:][near]] = True
    return found


def worst_windows(texts: list[list[bytes]], model: Model, leads: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(logit, first word) of each text's worst window; the bias alone for texts without words.

    ``leads``: so many first words of each text only tell which later words are repeats; no window starts there.
    """
    sizes = np.array([len(t) for t in texts])
    logit, first = np.full(len(texts), model.bias), np.zeros(len(texts), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        words = [w for t in texts for w in t]
        each = word_scores(words, model)
        stops = np.cumsum(sizes[full])
        own = np.repeat(np.arange(len(full)), sizes[full])
        each[repeats([(w, i) for w, i in zip(words, own.tolist(), strict=True)])] = 0
        summed = np.concatenate([[0.0], np.cumsum(each)])
        starts = stops - sizes[full]
        at = np.arange(stops[-1])
        stop, place = np.repeat(stops, sizes[full]), at - np.repeat(starts, sizes[full])
        lead = np.repeat(np.array(leads or [0] * len(texts))[full], sizes[full])
        whole = (place >= lead) & (at + WINDOW <= stop) | (place == 0) & (lead == 0)
        each = np.where(whole, summed[np.minimum(at + WINDOW, stop)] - summed[at], -np.inf)
        best = np.maximum.reduceat(each, starts)
        logit[full] = best / WINDOW + model.bias
        hit = np.flatnonzero(each == np.repeat(best, sizes[full]))
        first[full] = hit[np.searchsorted(hit, starts)] - starts
    return logit, first


def score_texts(texts: list[bytes | None], model: Model) -> np.ndarray:
    """The score of each whole text."""
    parts, leads, owner = [], [], []
    for i, text in enumerate(texts):
        words = words_of(text)
        for k in range(0, max(1, len(words)), PART_WORDS):  # with the words around that its windows depend on
            leads.append(min(k, WINDOW - 1))
            parts.append(words[k - leads[-1] : k + PART_WORDS + WINDOW - 1])
            owner.append(i)
    logit, k, held = np.full(len(texts), -np.inf), 0, 0
    for j in range(len(parts) + 1):
        if j == len(parts) or held >= CHUNK_BYTES:
            np.maximum.at(logit, owner[k:j], worst_windows(parts[k:j], model, leads[k:j])[0])
            k, held = j, 0
        if j < len(parts):
            held += sum(map(len, parts[j])) + len(parts[j])
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def worst_starts(docs: list[bytes], model: Model) -> np.ndarray:
    """The first word of each text's worst window. Texts are given as joined words and cut a batch at a time."""
    found, batch, held = [], [], 0
    for i, doc in enumerate(docs, 1):
        batch.append(doc.split())
        held += len(doc)
        if i == len(docs) or len(batch) == BATCH_DOCS or held >= BATCH_BYTES:
            found.append(worst_windows(batch, model)[1])
            batch, held = [], 0
    return np.concatenate(found)


def train(texts: Iterable[bytes | None], labels: list[int], setup: Setup = Setup()) -> Model:
    """Bucket vectors and softmax weights, jointly. Without both labels every text scores the prior.

    Texts are held as joined words, not as lists of words, which take some ten times the memory.
    """
    rng = np.random.default_rng(setup.seed)
    docs, truth = [b" ".join(words_of(t)) for t in texts], np.array(labels, np.int64)
    n_words = [d.count(b" ") + 1 if d else 0 for d in docs]
    vectors = rng.uniform(-1, 1, (1 << setup.bits, setup.width))
    vectors /= setup.width
    softmax, bias = rng.normal(0, 0.1, (setup.width, 2)), np.array([-setup.prior, setup.prior]) / 2
    seen, seen_softmax = np.full(len(vectors), 1e-8), np.full(softmax.shape, 1e-8)
    model = Model(np.zeros(len(vectors)), setup.prior)
    weight = (max(1, (truth == 0).sum()) / max(1, (truth == 1).sum())) ** setup.balance  # of a toxic document
    epochs = max(setup.epochs, setup.least_steps * setup.batch // max(1, len(docs)))
    for epoch in range(epochs if len(set(labels)) == 2 else 0):
        if epoch < epochs // 2:
            first = np.array([rng.integers(0, max(1, n - WINDOW + 1)) for n in n_words])
        else:
            first = worst_starts(docs, model)
        order = rng.permutation(len(docs))
        rate = setup.rate * (1 - epoch / epochs)
        for k in range(0, len(order), setup.batch):
            some = order[k : k + setup.batch]
            taken = [[*dict.fromkeys(docs[i].split(None, first[i] + WINDOW)[first[i] : first[i] + WINDOW])] for i in some]
            sizes = np.array([len(t) for t in taken])
            bucket, owner = subwords([w for t in taken for w in t], setup.bits)
            share = 1 / (WINDOW * np.maximum(1, np.bincount(owner, minlength=sizes.sum())))[owner]
            window = np.repeat(np.arange(len(some)), sizes)[owner]
            used, place = np.unique(bucket, return_inverse=True)
            mean = np.stack([np.bincount(window, share * vectors[bucket, j], len(some)) for j in range(setup.width)], 1)
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), truth[some]] -= 1
            p *= np.where(truth[some] == 1, weight, 1.0)[:, None]
            back = p @ softmax.T
            step = np.stack([np.bincount(place, share * back[window, j], len(used)) for j in range(setup.width)], 1)
            seen[used] += (step**2).mean(1)
            vectors[used] -= rate * step / np.sqrt(seen[used])[:, None]
            change = mean.T @ p
            seen_softmax += change**2
            softmax -= rate * change / np.sqrt(seen_softmax)
        model = Model(vectors @ (softmax[:, 1] - softmax[:, 0]), setup.prior)
    return Model(model.weights.astype(np.float32), model.bias)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> Model:
    """A model from labelled documents that are not held out. Rows with null ids, labels or texts do not train."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in named.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(setup.seed)), F.lit(1 << 30))
    share = {t: min(1.0, most / max(1, sizes.get(t, 0))) for t, most in ((1, setup.toxic), (0, setup.clean))}
    limit = F.when(F.col("toxic") == 1, F.lit(int(share[1] * (1 << 30)))).otherwise(F.lit(int(share[0] * (1 << 30))))
    some = F.broadcast(named.where(place < limit))  # about setup.toxic + setup.clean rows
    short = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= setup.most_chars)
    rows = short.join(some, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow()
    return train((t for c in rows.column("text").chunks for t in utf8(c)), rows.column("toxic").to_pylist(), setup)


def _score(model: Model):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(score_texts(utf8(batch.column(0)), model))], [*batch.schema.names[1:], "_score"]
        )

    return step


def with_scores(docs: DataFrame, model: Model, keep: list) -> DataFrame:
    """The columns ``keep`` and ``_score`` (0 to 1) of every row; nulls and empty texts score as a text without words."""
    rows = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    return rows.mapInArrow(in_batches(functools.partial(_score, model)), with_fields(rows.drop("_text").schema, "_score double"))


def report(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; repeated rows each get a row, an empty table none."""
    scored = with_scores(docs, fit(docs, labels, setup), [F.col("doc_id")])
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """The rows of ``docs``, with its own columns, that score below 0.5."""
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = with_scores(docs, fit(docs, labels, setup), [packed]).where("_score < 0.5")
    return scored.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
