"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over hashed n-grams are counted: one over the trusted target (documents labelled of good quality),
one over the whole raw corpus. A document's verdict is the mean, over its n-grams, of the log ratio of the two,
compared with a fixed threshold: no sampling, so a document always gets the same verdict. The n-grams are
single words, pairs of neighbours and the last two characters of words, which tell mark-up junk from prose
even where the words themselves are new. The threshold is the score that a small share of the trusted
documents (LOST) stays below.

Counts take one pass: summed into 2**BITS buckets before the shuffle; the ratios (one number a bucket) go into
the second pass as a constant. Base rules are array functions within each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agorascope.llm.common import landed, text_or_empty

BITS = 14
LOST = 0.005
DIGITS = 4  # of a score, for the threshold
PRIOR = 32  # pseudo-counts that pull rare buckets' ratios to 1
FEWEST_WORDS, MOST_REPEATED = 50, 50  # words; per cent
GAPS = r"[ \t-\r]+"
SYMBOLS = r"[^#*$%&|<>]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def _bucket(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def grams(w: Column) -> Column:
    """Buckets of the words, endings and pairs of the array ``w`` (a text's last word pairs with nothing)."""
    single = F.transform(w, lambda x: _bucket(x))
    ends = F.transform(w, lambda x: _bucket(F.substring(x, -2, 2), F.lit(2)))
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: _bucket(a, b))
    return F.concat(single, ends, pairs)


def repeated_words(w: Column, triples: Column) -> Column:
    """Words that lie in windows of three words found twice or more; windows are told apart by 64-bit hashes."""
    ordered = F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda j, k: F.get(s, j).getField("h") == F.get(s, k).getField("h")
        twice = F.filter(s, lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x.getField("i")))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), x - F.coalesce(F.get(p, j - 1), F.lit(-3)))), F.lit(0), lambda a, x: a + x
        )

    # transform over an array of one keeps each step's result, where a plain reference would compute it again
    found = F.get(F.transform(F.transform(F.array(ordered), places), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(triples)) == F.size(triples), F.lit(0)).otherwise(found)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and w, the array of words."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    n = F.size("w")
    triple = lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1))
    triples = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), triple)).otherwise(F.array().cast("array<bigint>"))
    cut = docs.select("doc_id", words(text).alias("w"), lines.alias("lines"), F.length(F.regexp_replace(text, SYMBOLS, "")).alias("n_symbols"))
    cut = cut.withColumn("triples", triples)
    cut = cut.withColumn("n_words", n).withColumn("n_repeat_words", repeated_words(F.col("w"), F.col("triples")))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return cut.select(
        "doc_id", F.col("n_words").cast("long"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.col("n_repeat_words").cast("long"), failed.alias("base_failed"), "w",
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): labelled good by all their labels; null ids and labels are left out."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return named.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """Per bucket, the log ratio of its count among trusted documents and that expected from all, each plus PRIOR."""
    # labels grow with the documents: the join is a shuffle at every size, never a broadcast
    good = trusted_ids(labels).withColumn("good", F.lit(1)).hint("merge")
    marked = docs.select("doc_id", text_or_empty().alias("text")).join(good, "doc_id", "left")
    cut = marked.select(words(F.col("text")).alias("w"), "good")
    each = cut.select("good", F.explode(grams(F.col("w"))).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target")).collect()
    share = sum(r.target for r in counts) / max(1, sum(r.raw for r in counts))
    values = [0.0] * (1 << BITS)
    for r in counts:
        values[r.bucket] = math.log((r.target + PRIOR) / (r.raw * share + PRIOR)) if share else 0.0
    return values


def threshold(good: DataFrame) -> float:
    """The exact LOST quantile of the rounded scores of ``good``, from their histogram; zero without rows.

    The same rows give the same threshold whatever their order and partitions. A histogram of so few digits has some ten
    thousand rows at any size.
    """
    histogram = good.where("score is not null").groupBy(F.round("score", DIGITS).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = histogram.select("s", F.sum("n").over(running).alias("upto"), F.sum("n").over(everything).alias("total"))
    return placed.where(F.col("upto") >= LOST * F.col("total")).agg(F.min("s")).first()[0] or 0.0


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, score and kept.

    A null or empty text has no words, no score and fails. Without trusted documents all ratios and the threshold are zero.
    Repeated rows each get a row; extra columns play no part.
    """
    values = ratios(docs, labels)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in values)), ",").cast("array<double>")  # folded into one constant
    total = F.aggregate(grams(F.col("w")), F.lit(0.0), lambda a, g: a + F.get(table, g))
    scored = base(docs).withColumn("score", total / F.when(F.col("n_words") > 0, 3 * F.col("n_words"))).drop("w")
    scored = landed(scored, "quality")
    good = scored.where("not base_failed").join(trusted_ids(labels), "doc_id", "left_semi")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.round("score", DIGITS) >= threshold(good)))
