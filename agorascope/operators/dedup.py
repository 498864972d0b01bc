"""First-wins and last-wins selection, null-safe anti-joins and upserts without MERGE.

``row_number() = 1`` lets Spark keep one row per key on the map side already, so a key that
holds a large share of all rows never travels whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``. NULL keys form one group."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def by_content(frame: DataFrame) -> Column:
    """Last resort of an order: equal for equal rows only, so that ties fall the same way in every run."""
    plain = [f.name for f in frame.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key (NULL counts as a value) is not in ``existing``."""
    known = existing.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & new[k].eqNullSafe(known[f"_k{i}"])
    return new.join(known, match, "left_anti")


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-skip: what a batch adds to a store. Repeats inside the batch: first wins."""
    return absent(first_wins(batch, keys, order), existing, keys)


def upsert_embeddings(batch: DataFrame, existing: DataFrame, order: list[Column]) -> DataFrame:
    """One vector per (record, model); a new model is a new row beside the old one."""
    return new_rows(batch, existing, ["record_id", "model_name"], [*order, by_content(batch)])


def dedup_article_urls(records: DataFrame) -> DataFrame:
    """Articles sharing a URL: the earliest captured stays. Other records pass unchanged.

    Only rows that can clash are ranked; the rest skip the shuffle.
    """
    clash = (F.col("category") == "article") & F.col("url").isNotNull()
    articles = first_wins(records.filter(clash), ["url"], [F.col("captured_at"), F.col("id")])
    return articles.unionByName(records.filter(~F.coalesce(clash, F.lit(False))))


def canonical_entities(names: DataFrame) -> DataFrame:
    """One entity per (lower(name), type) with the casing seen first."""
    return names.groupBy(F.lower("name").alias("name_key"), "type").agg(
        F.min_by("name", F.struct("first_seen", "name")).alias("name"),
        F.min("first_seen").alias("first_seen"), F.count(F.lit(1)).alias("variants"),
    )


def dedup_mentions(mentions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Unique per (entity, record, offset), and per (entity, record) where the offset is NULL: the most confident stays."""
    keys = ["entity_id", "record_id", "start_offset"]
    sure = [F.col("confidence").desc_nulls_last()] if "confidence" in mentions.columns else []
    once = first_wins(mentions, keys, [*sure, by_content(mentions)])
    return once if existing is None else absent(once, existing, keys)


def dedup_assignments(assignments: DataFrame) -> DataFrame:
    """One row per (record, topic, method): the most confident."""
    return first_wins(
        assignments, ["record_id", "topic_id", "method"], [F.col("confidence").desc_nulls_last(), by_content(assignments)]
    )


def upsert_signals(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """New signals; (kind, topic, dedup key) repeats are skipped, a NULL topic being a value.

    Rows without a dedup key are always kept.
    """
    keyed = new_rows(
        batch.filter("dedup_key IS NOT NULL"), existing.filter("dedup_key IS NOT NULL"),
        ["kind", "topic_id", "dedup_key"], [F.col("detected_at"), F.col("id")],
    )
    return keyed.unionByName(batch.filter("dedup_key IS NULL"))


def keyed_refresh(old: DataFrame, new: DataFrame, keys: list[str], latest: list[Column] = ()) -> DataFrame:
    """Last wins: rows of ``new`` replace those of ``old`` with the same key.

    Of repeats within ``new`` the first in the order ``latest`` stays (then the order of their contents).
    """
    once = first_wins(new, keys, [*latest, by_content(new)])
    return absent(old, once, keys).unionByName(once, allowMissingColumns=True)


def active_refresh(old: DataFrame, new: DataFrame, keys: list[str], latest: list[Column] = ()) -> DataFrame:
    """As ``keyed_refresh`` for tables with history: replaced rows stay, with ``is_active`` false."""
    once = first_wins(new, keys, [*latest, by_content(new)])
    kept = absent(old, once, keys)
    replaced = old.join(once.select(*keys), keys, "left_semi").withColumn("is_active", F.lit(False))
    fresh = once.withColumn("is_active", F.lit(True))
    return kept.unionByName(replaced.select(*kept.columns)).unionByName(fresh, allowMissingColumns=True)


def merge_entities(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Extension: re-point mentions of an alias to its canonical entity and dedup again."""
    mapped = mentions.join(
        aliases.select(F.col("alias_id").alias("entity_id"), "canonical_id"), "entity_id", "left"
    )
    return dedup_mentions(
        mapped.withColumn("entity_id", F.coalesce("canonical_id", "entity_id")).drop("canonical_id")
    )


def saturation_delta(rows: DataFrame, in_active: Column, in_recent: Column, key: str = "token") -> DataFrame:
    """Change of a suppression list: tokens added, removed and kept.

    ``rows`` holds the tokens of both lists; the two conditions tell which list a row is from.
    """
    sides = rows.filter(in_active | in_recent).groupBy(key).agg(
        F.bool_or(in_active).alias("_a"), F.bool_or(in_recent).alias("_r")
    )
    return sides.select(key, F.when(~F.col("_a"), "added").when(~F.col("_r"), "removed").otherwise("kept").alias("change"))
