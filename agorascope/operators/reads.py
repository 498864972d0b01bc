"""Filtered lists, lookups, work-sets and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.functions.text import contains_ci, slug
from agorascope.params import P


def _when(value, condition) -> Column:
    return F.lit(True) if value is None else condition


def record_list(
    records: DataFrame, assignments: DataFrame | None = None, mentions: DataFrame | None = None, *,
    kind=None, content_type=None, topic_id=None, entity_id=None, sentiment=None, since=None, until=None,
    min_sentiment=None, max_sentiment=None,
) -> DataFrame:
    """Records matching every given criterion. ``mixed`` sentiment matches nothing."""
    c = F.col
    rows = records.filter(
        _when(kind, c("kind") == kind) & _when(content_type, c("content_type") == content_type)
        & _when(sentiment, c("sentiment_label") == sentiment)
        & _when(since, c("captured_at") >= since) & _when(until, c("captured_at") <= until)
        & _when(min_sentiment, c("sentiment_score") >= min_sentiment)
        & _when(max_sentiment, c("sentiment_score") <= max_sentiment)
    )
    if topic_id is not None:
        hits = assignments.filter(c("topic_id") == topic_id).select(c("record_id").alias("id"))
        rows = rows.join(hits, "id", "left_semi")
    if entity_id is not None:
        hits = mentions.filter(c("entity_id") == entity_id).select(c("record_id").alias("id"))
        rows = rows.join(hits, "id", "left_semi")
    return rows


def story_list(
    stories: DataFrame, *, type=None, topic_id=None, entity_name=None, arc_status=None, enriched=None, since=None
) -> DataFrame:
    """Active stories matching every criterion; ``arc_status`` is the computed one (a column here)."""
    c = F.col
    return stories.filter(
        c("active") & _when(type, c("type") == type) & _when(topic_id, c("topic_id") == topic_id)
        & _when(entity_name, c("entity_name") == entity_name)
        & _when(arc_status, c("computed_arc_status") == arc_status if arc_status else F.lit(True))
        & _when(enriched, c("enriched_at").isNotNull() == F.lit(bool(enriched)))
        & _when(since, c("generated_at") >= since)
    )


def signal_list(
    signals: DataFrame, evidence: DataFrame | None = None, *, kind=None, topic_id=None, entity_id=None, since=None
) -> DataFrame:
    c = F.col
    rows = signals.filter(
        _when(kind, c("kind") == kind) & _when(topic_id, c("topic_id") == topic_id)
        & _when(since, c("detected_at") >= since)
    )
    if entity_id is not None:
        hits = evidence.filter((c("target") == "entity") & (c("entity_id") == entity_id))
        rows = rows.join(hits.select(c("signal_id").alias("id")), "id", "left_semi")
    return rows


def signal_feed(signals: DataFrame, as_of: Column, window_hours: int = P.signal_window_hours) -> DataFrame:
    hours = max(1, min(int(window_hours), 168))
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    return signals.filter((F.col("detected_at") > since) & (F.col("detected_at") <= as_of))


def entity_list(entities: DataFrame, *, name=None, type=None, min_mentions: int = 0) -> DataFrame:
    return entities.filter(
        _when(name, contains_ci(F.col("name"), name or "")) & _when(type, F.col("type") == type)
        & (F.col("mention_count") >= min_mentions)
    )


def public_entities(entities: DataFrame, allowed: tuple[str, ...] = ("index",)) -> DataFrame:
    """Unclassified entities count as eligible."""
    return entities.filter(F.col("indexability").isNull() | F.col("indexability").isin(*allowed))


def keyword_scan(records: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring of title or text; ``%`` and ``_`` are literal."""
    return records.filter(
        F.coalesce(contains_ci(F.col("title"), term), F.lit(False))
        | F.coalesce(contains_ci(F.col("content_text"), term), F.lit(False))
    )


def by_id(frame: DataFrame, key) -> DataFrame:
    return frame.filter(F.col("id") == F.lit(key))


def slug_lookup(entities: DataFrame) -> DataFrame:
    """Each slug with the number of entities behind it: one is a hit, more ask the reader to choose.

    The choices are listed by id, so a slug's own list is as long as its collisions.
    """
    return entities.groupBy(slug(F.col("name")).alias("slug")).agg(
        F.count(F.lit(1)).alias("matches"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.sort_array(F.collect_list("id")).alias("ids"),
    ).withColumn("kind", F.when(F.col("matches") == 1, "entity").otherwise("disambiguation"))


def slug_matches(entities: DataFrame, wanted: str) -> DataFrame:
    return entities.filter(slug(F.col("name")) == wanted)


def worksets(records: DataFrame, sources: DataFrame, entities: DataFrame, signals: DataFrame, stories: DataFrame,
             as_of: Column, enrichment_version: int) -> dict[str, DataFrame]:
    """The named partial sets other services poll, one filter each."""
    c = F.col
    return {
        "open_signals": signals.filter(~c("acknowledged")),
        "enabled_sources": sources.filter("enabled"),
        "unclassified_entities": entities.filter(c("indexability").isNull()),
        "scheduled_stories": stories.filter(c("publish_at").isNotNull() & (c("publish_at") > as_of)),
        "stale_enrichment": stories.filter(
            c("active") & c("enriched_at").isNotNull() & (c("enrichment_version") < enrichment_version)
        ),
        "publisher_articles": records.filter((c("category") == "article") & c("publisher").isNotNull()),
    }


def publish_gate(stories: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Gate state of each active story: passed, blocked, or pending while no verdict exists."""
    state = (
        F.when(F.col("quality_passed"), "passed").when(F.col("quality_passed").isNotNull(), "blocked")
        .otherwise("pending")
    )
    judged = stories.filter("active").join(verdicts, key, "left").withColumn("gate", state)
    return judged.withColumn("published", F.col("gate") == "passed")


def seo_list(seo: DataFrame, *, q=None, page_type=None, status: str = "active") -> DataFrame:
    c = F.col
    chosen = {"active": c("active"), "inactive": ~c("active"), "all": F.lit(True)}[status]
    hit = F.lit(True)
    if q is not None:
        hit = F.coalesce(contains_ci(c("page_id"), q), F.lit(False)) | F.coalesce(
            contains_ci(c("seo_title"), q), F.lit(False)
        )
    return seo.filter(chosen & _when(page_type, c("page_type") == page_type) & hit)
