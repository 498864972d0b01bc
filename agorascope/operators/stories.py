"""Append-only story chains, arcs, citations, references and the reads built on them.

Chain questions (previous version, differences, gaps) are equi-joins on the unique version id,
not windows over a slug, so one very long chain does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorascope.functions import rules
from agorascope.functions.text import slug, word_count
from agorascope.operators.asof import latest_before
from agorascope.operators.dedup import first_wins
from agorascope.operators.positions import bucketed_positions, salted_join
from agorascope.operators.rollups import hours_before, n_rows
from agorascope.params import P
from agorascope.schemas import SEO_BOUNDS


# ---- projections ----------------------------------------------------------------------------
def computed_arc_status(
    stories: DataFrame, signals: DataFrame, membership: DataFrame, as_of: Column,
    live_hours: int = P.live_hours, breaking_hours: int = P.breaking_max_age_hours,
) -> DataFrame:
    """Adds ``arc_id`` and the reader-facing status.

    ``breaking``: stored as breaking and at most ``breaking_hours`` old. ``developing``: not
    resolved or archived, and its topic had a signal or its arc an active story within
    ``live_hours``. Else NULL.
    """
    since = hours_before(as_of, live_hours)

    def live(column: str) -> Column:
        return (F.col(column) <= as_of) & (F.col(column) >= since)

    topics = signals.filter(live("detected_at") & F.col("topic_id").isNotNull()).select("topic_id").distinct()
    recent = stories.filter(F.col("active") & live("generated_at")).select(F.col("id").alias("story_id"))
    arcs = membership.join(recent, "story_id", "left_semi").select("arc_id").distinct()
    rows = (
        stories.join(topics.withColumn("_topic_live", F.lit(True)), "topic_id", "left")
        .join(membership.select(F.col("story_id").alias("id"), "arc_id"), "id", "left")
        .join(arcs.withColumn("_arc_live", F.lit(True)), "arc_id", "left")
    )
    young = F.col("generated_at") >= hours_before(as_of, breaking_hours)
    alive = F.col("_topic_live").isNotNull() | F.col("_arc_live").isNotNull()
    status = F.when((F.col("arc_status") == "breaking") & young, "breaking").when(
        ~F.col("arc_status").isin("resolved", "archived") & alive, "developing"
    )
    return rows.withColumn("computed_arc_status", status).drop("_topic_live", "_arc_live")


def source_pairs(stories: DataFrame) -> DataFrame:
    """(story, record) pairs from the stored id lists."""
    return stories.select(
        F.col("id").alias("story_id"), F.explode(F.col("source_record_ids").cast("array<bigint>")).alias("record_id")
    )


def story_summary(stories: DataFrame, topics: DataFrame, records: DataFrame) -> DataFrame:
    """Stories with topic name and the distinct source kinds (a set of at most nine)."""
    kinds = records.select(F.col("id").alias("record_id"), "kind")
    platforms = source_pairs(stories).join(kinds, "record_id").groupBy(F.col("story_id").alias("id")).agg(
        F.sort_array(F.collect_set("kind")).alias("source_platforms")
    )
    names = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"))
    return stories.join(names, "topic_id", "left").join(platforms, "id", "left")


def top_entity(mentions: DataFrame) -> DataFrame:
    """Most salient entity per record: confidence, then the earliest offset, then the id."""
    order = [F.desc("confidence"), F.asc_nulls_last("start_offset"), F.asc("entity_id")]
    return first_wins(mentions, ["record_id"], order)


def dispatch_records(stories: DataFrame) -> DataFrame:
    """Ids of records behind an active dispatch story."""
    dispatches = stories.filter(F.col("active") & (F.col("type") == "dispatch"))
    return source_pairs(dispatches).select("record_id").distinct()


def record_summary(
    records: DataFrame, assignments: DataFrame, mentions: DataFrame, entities: DataFrame, stories: DataFrame, topics: DataFrame,
    excerpt_chars: int = 160,
) -> DataFrame:
    """``records`` with ``excerpt``, ``topics`` (id and display name, by id), ``top_entity`` (name and salience) and ``has_dispatch``.

    Names are resolved on the small sides first, so each join of records is on their own id.
    """
    shown = topics.select(F.col("id").alias("topic_id"), "display_name")
    named = salted_join(assignments.select("record_id", "topic_id").distinct(), shown, ["topic_id"], ["record_id"])
    own = named.groupBy(F.col("record_id").alias("id")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("topic_id").alias("id"), "display_name"))).alias("topics")
    )
    names = entities.select(F.col("id").alias("entity_id"), F.col("name"))
    best = salted_join(top_entity(mentions), names, ["entity_id"], ["record_id"]).select(
        F.col("record_id").alias("id"), F.struct("name", F.col("confidence").alias("salience")).alias("top_entity")
    )
    dispatch = dispatch_records(stories).select(F.col("record_id").alias("id"), F.lit(True).alias("_d"))
    return (
        records.withColumn("excerpt", F.substring("content_text", 1, excerpt_chars))
        .join(own, "id", "left").join(best, "id", "left")
        .join(dispatch, "id", "left").withColumn("has_dispatch", F.col("_d").isNotNull()).drop("_d")
    )


def seo_diagnostics(seo: DataFrame) -> DataFrame:
    """Per field: missing, too short, ok or too long."""
    out = seo
    for field, unit, low, high in SEO_BOUNDS:
        size = F.length(field) if unit == "chars" else F.size(field)
        size = F.when(F.col(field).isNotNull(), size)
        out = out.withColumn(f"{field}_status", rules.length_status(size, low, high))
    return out


def public_stories(stories: DataFrame, as_of: Column, stub_words: int) -> DataFrame:
    """Active stories already shown at ``as_of`` that are not stubs, with their display time."""
    shown = F.coalesce("publish_at", "generated_at")
    return stories.filter(F.col("active") & (shown <= as_of) & (word_count(F.col("content")) >= stub_words)).withColumn(
        "shown_at", shown
    )


# ---- versions -------------------------------------------------------------------------------
def current_version(stories: DataFrame) -> DataFrame:
    return first_wins(stories, ["slug"], [F.desc("version"), F.desc("id")])


def with_previous(stories: DataFrame, columns: list[str]) -> DataFrame:
    """Each version beside the one it supersedes (``prev_*`` columns, NULL at the start)."""
    prev = stories.select(
        F.col("id").alias("previous_version_id"), *[F.col(c).alias(f"prev_{c}") for c in columns]
    )
    return stories.join(prev, "previous_version_id", "left")


def version_chain(stories: DataFrame) -> DataFrame:
    """Versions of each slug with the chain's root, the steps from it, and the successor.

    Equal to following the links one by one wherever ``chain_integrity`` finds no fault.
    """
    root = stories.groupBy("slug").agg(
        F.min_by("id", "version").alias("root_id"), F.min("version").alias("_first"), F.max("version").alias("versions")
    )
    nxt = stories.filter(F.col("previous_version_id").isNotNull()).select(
        F.col("previous_version_id").alias("id"), F.col("id").alias("next_version_id")
    )
    return stories.join(root, "slug").join(nxt, "id", "left").withColumn("steps", F.col("version") - F.col("_first")).drop("_first")


def version_diff(stories: DataFrame) -> DataFrame:
    """Word-count change and source records gained and lost against the prior version."""
    rows = with_previous(
        stories.withColumn("words", word_count(F.col("content"))), ["words", "source_record_ids"]
    ).filter(F.col("previous_version_id").isNotNull())
    return rows.select(
        "id", "slug", "version", (F.col("words") - F.col("prev_words")).alias("word_delta"),
        F.sort_array(F.array_except("source_record_ids", "prev_source_record_ids")).alias("sources_added"),
        F.sort_array(F.array_except("prev_source_record_ids", "source_record_ids")).alias("sources_removed"),
    )


def version_cadence(stories: DataFrame, min_gap_minutes: float = P.cadence_min_gap_minutes) -> DataFrame:
    """Versions that followed their predecessor faster than allowed."""
    rows = with_previous(stories, ["generated_at"])
    gap = F.unix_seconds("generated_at") - F.unix_seconds("prev_generated_at")
    return rows.withColumn("gap_seconds", gap).filter(F.col("gap_seconds") < min_gap_minutes * 60)


def chain_integrity(stories: DataFrame) -> DataFrame:
    """Chains with a fault: not exactly one active version, or a link to no or the wrong version."""
    rows = with_previous(stories, ["slug", "version"])
    broken = F.col("previous_version_id").isNotNull() & ~(
        F.coalesce(F.col("prev_slug") == F.col("slug"), F.lit(False))
        & F.coalesce(F.col("prev_version") + 1 == F.col("version"), F.lit(False))
    )
    headless = F.col("previous_version_id").isNull() & (F.col("version") > 1)
    sums = rows.groupBy("slug").agg(
        n_rows().alias("versions"), F.count_if("active").alias("active_versions"),
        F.count_if(broken | headless).alias("broken_links"),
    )
    return sums.filter((F.col("active_versions") != 1) | (F.col("broken_links") > 0))


def supersede_story(stories: DataFrame, drafts: DataFrame) -> DataFrame:
    """Snapshot after new versions: slug copied, version and link advanced, old heads inactive.

    ``drafts`` holds ``slug``, ``id`` and the new values. Several drafts of a slug follow each other by id, each
    linked to the one before; only the last is active.
    """
    heads = current_version(stories.join(drafts.select("slug"), "slug", "left_semi")).select(
        "slug", F.col("id").alias("_prev"), F.col("version").alias("_v")
    )
    turn, back = W.partitionBy("slug").orderBy("id"), W.partitionBy("slug").orderBy(F.desc("id"))
    ranked = drafts.withColumn("_n", F.row_number().over(turn)).withColumn("_before", F.lag("id").over(turn)).withColumn(
        "_last", F.row_number().over(back) == 1
    )
    fresh = ranked.join(heads, "slug", "left").select(
        *drafts.columns, (F.coalesce("_v", F.lit(0)) + F.col("_n")).alias("version"), F.coalesce("_before", "_prev").alias("previous_version_id"),
        F.col("_last").alias("active"),
    )
    marked = stories.join(drafts.select("slug").distinct().withColumn("_s", F.lit(True)), "slug", "left")
    kept = marked.withColumn("active", F.col("active") & F.col("_s").isNull()).drop("_s")
    return kept.unionByName(fresh, allowMissingColumns=True)


# ---- arcs -----------------------------------------------------------------------------------
def arc_sequence(membership: DataFrame, stories: DataFrame) -> DataFrame:
    """1-based place of each story in its arc, by time and id."""
    rows = membership.join(stories.select(F.col("id").alias("story_id"), "generated_at"), "story_id")
    placed = bucketed_positions(
        rows, ["arc_id"], F.to_date("generated_at"), [F.col("generated_at"), F.col("story_id")], "_p"
    )
    return placed.withColumn("sequence_order", F.col("_p") + 1).drop("_p")


def arc_members(arcs: DataFrame, sequence: DataFrame, stories: DataFrame) -> DataFrame:
    rows = sequence.join(stories.select(F.col("id").alias("story_id"), "headline", "type"), "story_id")
    names = arcs.select(F.col("id").alias("arc_id"), F.col("slug").alias("arc_slug"))
    return rows.join(names, "arc_id")


def arc_stats(membership: DataFrame, stories: DataFrame) -> DataFrame:
    rows = membership.join(stories.select(F.col("id").alias("story_id"), "generated_at"), "story_id")
    return rows.groupBy("arc_id").agg(
        n_rows().alias("story_count"), F.min("generated_at").alias("first_story_at"), F.max("generated_at").alias("last_story_at")
    )


def arc_status(arcs: DataFrame, membership: DataFrame, stories: DataFrame, status: str = "arc_status",
               fallback: str | None = "developing", stub_words: int = P.stub_words) -> DataFrame:
    """Status of each arc's newest active member that is no stub."""
    live = stories.filter(F.col("active") & (word_count(F.col("content")) >= stub_words)).select(F.col("id").alias("story_id"), "generated_at", F.col(status).alias("_s"))
    newest = membership.select("story_id", "arc_id").join(live, "story_id").groupBy("arc_id").agg(
        F.max_by("_s", F.struct("generated_at", "story_id")).alias("_s")
    )
    return arcs.join(newest, arcs.id == newest.arc_id, "left").select(
        arcs.id.alias("arc_id"), "slug", "title", "topic_id", F.coalesce("_s", F.lit(fallback)).alias("arc_status")
    )


def arc_list(arcs: DataFrame, membership: DataFrame, computed: DataFrame, *, topic_id=None, status=None) -> DataFrame:
    """Arcs with stats and the computed status of the newest active member, filtered."""
    rows = arc_status(arcs, membership, computed, "computed_arc_status", None).join(
        arc_stats(membership, computed), "arc_id", "left"
    )
    if topic_id is not None:
        rows = rows.filter(F.col("topic_id") == topic_id)
    return rows if status is None else rows.filter(F.col("arc_status") == status)


def entity_arcs(references: DataFrame, entities: DataFrame, membership: DataFrame, stories: DataFrame) -> DataFrame:
    """Arcs whose stories reference an entity page: distinct stories and last update."""
    slugs = entities.select(slug(F.col("name")).alias("ref_slug"), F.col("id").alias("entity_id"))
    pairs = references.filter("ref_type = 'entity'").join(slugs, "ref_slug").select("entity_id", "story_id").distinct()
    rows = pairs.join(membership.select("story_id", "arc_id"), "story_id").join(
        stories.select(F.col("id").alias("story_id"), "generated_at"), "story_id"
    )
    return rows.groupBy("entity_id", "arc_id").agg(
        n_rows().alias("story_count"), F.max("generated_at").alias("last_updated_at")
    )


# ---- citations, references, related ---------------------------------------------------------
def story_citations(stories: DataFrame, citations: DataFrame) -> DataFrame:
    """One row a story: its ``citations`` as structs in order of position (then marker), and counts by type; uncited stories stay.

    A story's citations are its own footnotes, so the array is as long as its text allows.
    """
    internal = F.col("citation_type") == "internal"
    order = [F.coalesce("position", F.lit(2**31 - 1)).alias("position"), F.coalesce("marker", F.lit(2**31 - 1)).alias("marker")]
    listed = citations.groupBy(F.col("story_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(*order, "citation_type", "record_id", "external_url"))).alias("citations"),
        F.count_if(internal).alias("internal_count"), F.count_if(~internal).alias("external_count"),
    )
    return stories.join(listed, "id", "left").fillna(0, ["internal_count", "external_count"])


def story_with_citations(stories: DataFrame, citations: DataFrame) -> DataFrame:
    """Stories beside each of their citations, with counts by type; uncited stories stay. ``story_citations`` lists them in order."""
    internal = F.col("citation_type") == "internal"
    counts = citations.groupBy("story_id").agg(
        F.count_if(internal).alias("internal_count"), F.count_if(~internal).alias("external_count")
    )
    rows = stories.join(citations.withColumnRenamed("story_id", "id"), "id", "left")
    both = rows.join(counts.withColumnRenamed("story_id", "id"), "id", "left")
    return both.fillna(0, ["internal_count", "external_count"])


def story_sources(citations: DataFrame, records: DataFrame) -> DataFrame:
    """Cited records with their details, and external links apart (``section``)."""
    known = records.select(F.col("id").alias("record_id"), "kind", "title", F.col("author").alias("byline"), "sentiment_score")
    inside = citations.filter("citation_type = 'internal'").join(known, "record_id", "left").withColumn(
        "section", F.lit("sources")
    )
    outside = citations.filter("citation_type = 'external'").withColumn("section", F.lit("external"))
    return inside.unionByName(outside, allowMissingColumns=True)


def citation_domains(citations: DataFrame) -> DataFrame:
    return citations.groupBy("domain", "platform", "fact_type").agg(
        n_rows().alias("citations"), F.round(F.avg("credibility_score"), 6).alias("mean_credibility")
    )


def marker_audit(texts: DataFrame, citations: DataFrame) -> DataFrame:
    """Inline ``[n]`` markers without a citation row, and citation markers absent from the text.

    ``texts`` holds ``story_id`` and the array ``markers``.
    """
    used = texts.select("story_id", F.explode("markers").alias("marker"))
    rows = citations.filter(F.col("marker").isNotNull()).select("story_id", "marker").distinct()
    missing = used.join(rows, ["story_id", "marker"], "left_anti").withColumn("fault", F.lit("no_citation"))
    unused = rows.join(used, ["story_id", "marker"], "left_anti").withColumn("fault", F.lit("not_in_text"))
    return missing.unionByName(unused)


def story_related(related: DataFrame, stories: DataFrame) -> DataFrame:
    """Directed related edges with the target's headline."""
    target = stories.select(F.col("id").alias("related_id"), F.col("headline").alias("related_headline"), "active")
    return related.join(target, "related_id")


def story_variants(stories: DataFrame, variants: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row per story, one column per variant type."""
    wide = variants.groupBy("story_id").pivot("variant_type", list(types)).agg(F.max("content"))
    return stories.select(F.col("id").alias("story_id")).join(wide, "story_id")


def link_integrity(references: DataFrame, entities: DataFrame, topics: DataFrame, stories: DataFrame) -> DataFrame:
    """Link targets with in-degree; ``broken`` where no such page exists."""
    pages = (
        entities.select(F.lit("entity").alias("ref_type"), slug(F.col("name")).alias("ref_slug"))
        .union(topics.select(F.lit("beat"), "name"))
        .union(stories.filter("active").select(F.lit("story"), "slug"))
        .distinct()
        .withColumn("_page", F.lit(True))
    )
    degree = references.groupBy("ref_type", "ref_slug").agg(n_rows().alias("in_degree"))
    return degree.join(pages, ["ref_type", "ref_slug"], "left").select(
        "ref_type", "ref_slug", "in_degree", F.col("_page").isNull().alias("broken")
    )


def page_seo(stories: DataFrame, topics: DataFrame, entities: DataFrame, arcs: DataFrame, seo: DataFrame) -> DataFrame:
    """Every page with its active metadata row; each page type has its own id."""
    pages = (
        stories.filter("active").select(F.lit("story").alias("page_type"), F.col("slug").alias("page_id"))
        .union(topics.select(F.lit("beat"), "name"))
        .union(entities.select(F.lit("entity"), F.lower("name")))
        .union(arcs.select(F.lit("arc"), "slug"))
    )
    live = seo.filter("active").select("page_type", "page_id", "seo_title", "version")
    return pages.join(live, ["page_type", "page_id"], "left")


# ---- provenance -----------------------------------------------------------------------------
def signals_before_story(stories: DataFrame, signals: DataFrame, hours: int) -> DataFrame:
    """The last signal of the story's topic in the ``hours`` before it."""
    left = stories.select("id", "slug", "topic_id", "generated_at")
    right = signals.filter(F.col("topic_id").isNotNull()).select(
        F.col("id").alias("signal_id"), F.col("kind").alias("signal_kind"), "topic_id", "severity", "score", "detected_at"
    )
    hits = latest_before(
        left.filter(F.col("topic_id").isNotNull()), right, ["topic_id"], "generated_at", "detected_at", "signal_id",
        within=F.make_dt_interval(hours=F.lit(hours)),
    )
    return hits.select("id", "slug", "topic_id", "generated_at", "match.signal_id", "match.signal_kind",
                       "match.severity", "match.score", "match.detected_at")


def signal_provenance(stories: DataFrame, before: DataFrame) -> DataFrame:
    """Stories with the signal that triggered them and its confidence; NULLs without one."""
    found = before.filter(F.col("signal_id").isNotNull()).select("id", "signal_id", "signal_kind", "severity", "score")
    return stories.select("id", "slug").join(found, "id", "left").withColumn(
        "confidence", rules.severity_confidence(F.col("severity"))
    )


def asof_baseline(records: DataFrame, daily: DataFrame) -> DataFrame:
    """Each record with the latest daily mean of its kind strictly before its own day.

    The lookup is made per (kind, day), which is tiny, and joined back on that key.
    """
    d = F.to_date("captured_at")
    keys = records.select("kind", d.alias("day")).distinct()
    rollup = daily.select(
        "kind", F.col("bucket_date").alias("day"), F.struct(F.col("bucket_date").alias("at"), "avg_score").alias("_r")
    )
    w = W.partitionBy("kind").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    lookup = keys.join(rollup, ["kind", "day"], "full_outer").withColumn("_base", F.last("_r", ignorenulls=True).over(w))
    rows = records.withColumn("day", d).join(lookup.select("kind", "day", "_base"), ["kind", "day"], "left")
    return rows.withColumn("baseline_day", F.col("_base.at")).withColumn("baseline_avg", F.col("_base.avg_score"))
