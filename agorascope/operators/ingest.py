"""From provider items to canonical records: hydrate, normalise, window, upsert, announce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.functions.rules import category, iso_ms
from agorascope.functions.text import host
from agorascope.operators.dedup import absent, new_rows
from agorascope.operators.positions import id_positions
from agorascope.params import P
from agorascope.schemas import SOURCE_KINDS

RECORD_COLUMNS = (
    "kind", "source_config_id", "category", "publisher", "content_type", "external_id", "title", "content_text",
    "url", "author", "published_at", "subreddit", "language", "source_metadata", "analysis",
)


def candidate_ids(feed: DataFrame, name: str, limit: int = 200) -> DataFrame:
    """The first ``limit`` ids of one feed, in feed order."""
    return feed.filter(F.col("feed") == name).orderBy("rank", "id").limit(limit)


def hydrate_items(ids: DataFrame, items: DataFrame) -> DataFrame:
    """Items of the wanted ids; missing, deleted and dead ones fall out."""
    gone = F.coalesce("deleted", F.lit(False)) | F.coalesce("dead", F.lit(False))
    return items.filter(~gone).join(ids.select("id"), "id", "left_semi")


def ensure_source(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Source registry after insert-if-absent on (kind, name); rows already there win whole."""
    fresh = absent(wanted.dropDuplicates(["kind", "name"]), existing, ["kind", "name"])
    both = existing.select("kind", "name", "config", "enabled").unionByName(
        fresh.select("kind", "name", F.coalesce("config", F.lit("{}")).alias("config"), F.lit(True).alias("enabled"))
    )
    return both.withColumn("source_id", F.substring(F.sha2(F.concat_ws("/", "kind", "name"), 256), 1, 12))


def normalize_items(items: DataFrame, source_id: int | None, kind: str = "hackernews") -> DataFrame:
    """Stories and comments with an author, in the intermediate shape every adapter produces."""
    wanted = items.filter(F.col("type").isin("story", "comment") & (F.coalesce("by", F.lit("")) != ""))
    meta = F.to_json(
        F.struct(
            F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("descendants", F.lit(0)).alias("descendants"),
            F.coalesce("kids", F.array().cast("array<bigint>")).alias("kids"), F.col("parent"),
            F.col("type").alias("hn_type"),
        ),
        {"ignoreNullFields": "false"},
    )
    return wanted.select(
        F.lit(kind).alias("kind"), F.lit(source_id).cast("int").alias("source_config_id"),
        F.when(F.col("type") == "story", "post").otherwise("comment").alias("content_type"),
        F.col("id").cast("string").alias("external_id"), "title", F.col("text").alias("content_text"), "url",
        F.col("by").alias("author"), F.timestamp_seconds("time").alias("published_at"),
        F.lit(None).cast("string").alias("subreddit"), F.lit("en").alias("language"), meta.alias("source_metadata"),
    )


def canonical_record(items: DataFrame) -> DataFrame:
    """Normalised items as records: category and publisher derived, defaults filled.

    ``captured_at`` is not set here: it belongs to the batch (see ``upsert_records``).
    """

    def have(name: str) -> Column:
        return F.col(name) if name in items.columns else F.lit(None).cast("string")

    cat = category(F.col("kind"))
    shaped = items.select(
        "kind", (F.col("source_config_id") if "source_config_id" in items.columns else F.lit(None).cast("int"))
        .alias("source_config_id"),
        cat.alias("category"), F.when(cat == "article", host(have("url"))).alias("publisher"), "content_type",
        "external_id", have("title").alias("title"), have("content_text").alias("content_text"),
        have("url").alias("url"), have("author").alias("author"),
        (F.col("published_at") if "published_at" in items.columns else F.lit(None).cast("timestamp"))
        .alias("published_at"),
        have("subreddit").alias("subreddit"), F.coalesce(have("language"), F.lit("en")).alias("language"),
        F.coalesce(have("source_metadata"), F.lit("{}")).alias("source_metadata"), F.lit("{}").alias("analysis"),
    )
    return shaped


def upsert_records(batch: DataFrame, existing: DataFrame, order: list[Column], ingested_at: Column) -> DataFrame:
    """Rows a batch adds on (kind, external_id), stamped with the batch's one ingest time."""
    return new_rows(batch, existing, ["kind", "external_id"], order).withColumn("captured_at", ingested_at)


def assign_ids(rows: DataFrame, key: str, start: Column) -> DataFrame:
    """Consecutive ids from ``start`` on, in the order of a unique numeric ``key``."""
    return id_positions(rows, key, name="_p").withColumn("id", F.col("_p") + start).drop("_p")


def record_ingested_events(new: DataFrame) -> DataFrame:
    """One event per newly stored record."""
    return new.select(
        F.col("id").cast("string").alias("recordId"), "kind", F.col("content_type").alias("contentType"),
        F.col("external_id").alias("externalId"), iso_ms(F.col("captured_at")).alias("capturedAt"),
    )


def next_window(records: DataFrame, cursors: DataFrame, hours: int = P.cursor_window_hours) -> DataFrame:
    """Rows after each source's cursor, up to ``hours`` later."""
    until = F.col("cursor") + F.make_dt_interval(hours=F.lit(hours))
    few = F.broadcast(cursors.filter(F.col("kind").isin(*SOURCE_KINDS)))  # one row a kind, of nine
    return records.join(few, "kind").filter((F.col("captured_at") > F.col("cursor")) & (F.col("captured_at") <= until))


def advance_cursors(cursors: DataFrame, window: DataFrame) -> DataFrame:
    """Cursors after a window was stored; a source without rows keeps its own."""
    seen = window.groupBy("kind").agg(F.max("captured_at").alias("_top"), F.count(F.lit(1)).alias("rows"))
    return cursors.join(seen, "kind", "left").select(
        "kind", "cursor", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("_top", "cursor").alias("next_cursor"),
    )


def ingest_lag(records: DataFrame, as_of: Column, threshold_hours: float = P.lag_threshold_hours) -> DataFrame:
    """Seconds since the newest record of each source kind, and whether that is too long."""
    lag = F.unix_seconds(as_of) - F.unix_seconds("last_captured_at")
    return records.groupBy("kind").agg(F.max("captured_at").alias("last_captured_at")).select(
        "kind", "last_captured_at", lag.alias("lag_seconds"), (lag > threshold_hours * 3600).alias("late")
    )


def engagement(records: DataFrame, score_weight: float = P.engagement_score_weight,
               reply_weight: float = P.engagement_reply_weight) -> DataFrame:
    """Weighted sum of the provider's score and reply count."""

    def number(path: str) -> Column:
        return F.coalesce(F.get_json_object("source_metadata", path).cast("double"), F.lit(0.0))

    return records.withColumn(
        "engagement_score", number("$.score") * score_weight + number("$.descendants") * reply_weight
    )
