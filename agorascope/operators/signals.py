"""Change signals over the corpus, each joined to the weighted evidence that justifies it.

A detector returns one row per signal with at least ``kind``, its subject (``topic_id`` or
another key) and a raw ``score``. ``assemble_evidence`` weighs what supports it and the
minimum-evidence gate keeps signals that enough rows stand behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorascope.functions.rules import severity_band
from agorascope.operators.dedup import absent
from agorascope.operators.positions import bucketed_positions, salted_join
from agorascope.operators.rollups import growth, n_rows, rolling_baseline, since
from agorascope.params import P
from agorascope.session import stored


def topic_rows(assignments: DataFrame, records: DataFrame, *columns: str) -> DataFrame:
    """Each record once per topic, with the record's columns."""
    pairs = assignments.select("topic_id", "record_id").distinct()
    return pairs.join(records.select(F.col("id").alias("record_id"), *columns), "record_id")


def _two_windows(rows: DataFrame, as_of: Column, recent_days: int, prior_days: int) -> tuple[DataFrame, Column]:
    """Rows of both windows, and the condition for the recent one."""
    t = F.col("captured_at")
    split, start = since(as_of, recent_days), since(as_of, recent_days + prior_days)
    return rows.filter((t > start) & (t <= as_of)), t > split


# ---- detectors ------------------------------------------------------------------------------
def velocity(
    daily: DataFrame, first_day: str, last_day: str, days: int = P.baseline_days, ratio: float = P.velocity_ratio,
    run: int = P.velocity_run, min_evidence: int = P.min_evidence,
) -> DataFrame:
    """Runs of at least ``run`` consecutive days on which a topic exceeds its rolling baseline.

    ``daily`` is (topic_id, day, n). Days are zero-filled; the run search sees one row per day.
    """
    base = rolling_baseline(daily, "topic_id", first_day, last_day, days)
    rate = F.col("n") / F.greatest(F.col("baseline"), F.lit(1.0))
    above = base.filter((F.col("baseline_n") == days) & (rate >= ratio)).withColumn("_rate", rate)
    order = W.partitionBy("topic_id").orderBy("day")
    island = F.datediff("day", F.lit(first_day).cast("date")) - F.row_number().over(order)
    return above.withColumn("_island", island).groupBy("topic_id", "_island").agg(
        F.min("day").alias("start_day"), F.max("day").alias("end_day"), n_rows().alias("run_days"),
        F.round(F.max("_rate"), 6).alias("score"), F.sum("n").cast("long").alias("evidence"),
    ).filter((F.col("run_days") >= run) & (F.col("evidence") >= min_evidence)).drop("_island").withColumn("kind", F.lit("velocity"))


def volume_anomaly(
    daily: DataFrame, key: str, first_day: str, last_day: str, days: int = P.baseline_days, z: float = P.volume_z,
    min_evidence: int = P.min_evidence,
) -> DataFrame:
    """Days far above or below the key's own baseline, in deviations; the day or its baseline has rows enough."""
    base = rolling_baseline(daily, key, first_day, last_day, days)
    score = (F.col("n") - F.col("baseline")) / F.nullif("deviation", F.lit(0.0))
    enough = F.greatest(F.col("n").cast("double"), F.col("baseline")) >= min_evidence
    return base.filter((F.col("baseline_n") == days) & enough).withColumn("score", F.round(score, 6)).filter(
        F.abs(F.col("score")) >= z
    ).select(key, "day", "n", "score", F.when(F.col("score") > 0, "above").otherwise("below").alias("direction"),
             F.lit("volume_anomaly").alias("signal_kind"))


def novelty_signals(distances: DataFrame, min_distance: float = P.novelty_min_distance, min_evidence: int = P.min_evidence) -> DataFrame:
    """Topics where enough new records are far both from the centroid and from the recent records."""
    far = distances.withColumn("_d", F.least("centroid_distance", "recent_distance")).filter(F.col("_d") >= min_distance)
    return far.groupBy("topic_id").agg(n_rows().alias("evidence"), F.round(F.avg("_d"), 6).alias("score")).filter(
        F.col("evidence") >= min_evidence
    ).withColumn("kind", F.lit("novelty"))


def divergence(
    rows: DataFrame, min_rows: int = P.divergence_min_rows, min_spread: float = P.divergence_min_spread, name: str = "divergence"
) -> DataFrame:
    """Topics whose source kinds disagree: spread of per-kind mean sentiment.

    ``rows`` is ``topic_rows`` with ``kind`` and ``sentiment_score``.
    """
    per_kind = rows.filter(F.col("sentiment_score").isNotNull()).groupBy("topic_id", F.col("kind").alias("source_kind")).agg(
        F.avg("sentiment_score").alias("_m"), n_rows().alias("_n")
    ).filter(F.col("_n") >= min_rows)
    return per_kind.groupBy("topic_id").agg(
        n_rows().alias("kinds"), F.sum("_n").alias("evidence"), F.round(F.max("_m") - F.min("_m"), 6).alias("score"),
        F.max_by("source_kind", F.struct("_m", "source_kind")).alias("most_positive"),
        F.min_by("source_kind", F.struct("_m", "source_kind")).alias("most_negative"),
    ).filter((F.col("kinds") >= 2) & (F.col("score") >= min_spread)).withColumn("kind", F.lit(name))


def divergence_aligned(rows: DataFrame, **limits) -> DataFrame:
    """Extension: divergence on the time every kind of the topic has reached.

    The newest capture of the kind that lags most bounds the comparison, so ingestion lag does
    not look like disagreement.
    """
    reach = rows.groupBy("topic_id", "kind").agg(F.max("captured_at").alias("_t")).groupBy("topic_id").agg(
        F.min("_t").alias("_common")
    )
    shared = salted_join(rows, reach, ["topic_id"], ["captured_at", "kind"]).filter(F.col("captured_at") <= F.col("_common"))
    return divergence(shared, **limits)


def sentiment_shift(
    rows: DataFrame, as_of: Column, recent_days: int, prior_days: int, min_shift: float = P.sentiment_shift_min,
    min_evidence: int = P.min_evidence,
) -> DataFrame:
    """Topics whose mean sentiment moved between two windows."""
    inside, recent = _two_windows(rows.filter(F.col("sentiment_score").isNotNull()), as_of, recent_days, prior_days)
    score = F.col("sentiment_score")
    sums = inside.groupBy("topic_id").agg(
        F.avg(F.when(recent, score)).alias("_r"), F.avg(F.when(~recent, score)).alias("_p"), F.count_if(recent).alias("evidence"),
    )
    return sums.select(
        "topic_id", "evidence", F.round(F.col("_r"), 6).alias("recent_mean"), F.round(F.col("_p"), 6).alias("prior_mean"),
        F.round(F.col("_r") - F.col("_p"), 6).alias("score"), F.lit("sentiment_shift").alias("kind"),
    ).filter((F.abs(F.col("score")) >= min_shift) & (F.col("evidence") >= min_evidence))


def entity_surge(
    mentions: DataFrame, as_of: Column, min_growth: float = P.surge_min_growth, min_evidence: int = P.min_evidence, **windows
) -> DataFrame:
    """Entities whose mention rate grew past ``min_growth``."""
    rates = growth(mentions, as_of, **windows)
    return rates.filter((F.col("growth_factor") >= min_growth) & (F.col("recent_mentions") >= min_evidence)).select(
        "entity_id", "recent_mentions", "baseline_mentions", F.col("growth_factor").alias("score"), F.lit("entity_surge").alias("kind")
    )


def register_shift(
    rows: DataFrame, as_of: Column, recent_days: int, prior_days: int, min_shift: float = P.register_shift_min,
    min_evidence: int = P.min_evidence,
) -> DataFrame:
    """Topics whose mix of emotional registers moved: total variation between two windows."""
    inside, recent = _two_windows(rows.filter(F.col("emotional_register").isNotNull()), as_of, recent_days, prior_days)
    per_class = inside.groupBy("topic_id", "emotional_register").agg(
        F.count_if(recent).alias("_r"), F.count_if(~recent).alias("_p")
    )
    totals = per_class.groupBy("topic_id").agg(F.sum("_r").alias("_tr"), F.sum("_p").alias("_tp"))
    both = per_class.join(totals, "topic_id").filter((F.col("_tr") > 0) & (F.col("_tp") > 0))
    moved = F.abs(F.col("_r") / F.col("_tr") - F.col("_p") / F.col("_tp"))
    return both.groupBy("topic_id").agg(
        F.round(F.sum(moved) / 2, 6).alias("score"), F.max("_tr").alias("evidence"),
        F.max_by("emotional_register", F.struct(moved, "emotional_register")).alias("most_changed"),
    ).filter((F.col("score") >= min_shift) & (F.col("evidence") >= min_evidence)).withColumn("kind", F.lit("emotional_register_shift"))


def key_phrase(deltas: DataFrame, min_ratio: float, min_count: int, recent_days: int = 7, baseline_days: int = 21) -> DataFrame:
    """Phrases from ``ngram_delta`` whose daily count is ``min_ratio`` times that of the baseline (one added to its count)."""
    per_day = (F.col("recent_n") / float(recent_days)) / ((F.col("baseline_n") + 1.0) / float(baseline_days))
    return deltas.filter(F.col("recent_n") >= min_count).withColumn("score", F.round(per_day, 6)).filter(
        F.col("score") >= min_ratio
    ).withColumn("kind", F.lit("key_phrase_trending"))


def cross_topic(
    assignments: DataFrame, daily: DataFrame, first_day: str, last_day: str, min_corr: float = P.correlation_min,
    min_shared: int = P.correlation_min_shared,
) -> DataFrame:
    """Topic pairs that share records and whose daily counts move together.

    Candidate pairs come from the distinct topics of a record, by whatever methods it got them. A record has a few
    topics of a small taxonomy; the join is on the record, so a busy topic is spread over its records.
    """
    own = assignments.select("record_id", "topic_id").distinct()
    one, other = own.withColumnRenamed("topic_id", "topic_a"), own.withColumnRenamed("topic_id", "topic_b")
    pairs = one.join(other, "record_id").filter("topic_a < topic_b")
    edges = pairs.groupBy("topic_a", "topic_b").agg(n_rows().alias("shared_records")).filter(
        F.col("shared_records") >= min_shared
    )
    days = F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    left = daily.select(F.col("topic_id").alias("topic_a"), "day", F.col("n").alias("_na"))
    right = daily.select(F.col("topic_id").alias("topic_b"), "day", F.col("n").alias("_nb"))
    series = edges.withColumn("day", days).join(left, ["topic_a", "day"], "left").join(right, ["topic_b", "day"], "left")
    corr = F.corr(F.coalesce("_na", F.lit(0)).cast("double"), F.coalesce("_nb", F.lit(0)).cast("double"))
    return series.groupBy("topic_a", "topic_b", "shared_records").agg(F.round(corr, 6).alias("score")).filter(
        F.abs(F.col("score")) >= min_corr
    ).withColumn("kind", F.lit("cross_topic_correlation"))


def trend(
    daily: DataFrame, first_day: str, last_day: str, min_slope: float = P.trend_min_slope, min_evidence: int = P.min_evidence
) -> DataFrame:
    """Topics with rising daily counts: slope of the zero-filled series."""
    grid = daily.select("topic_id").distinct().withColumn(
        "day", F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    )
    series = grid.join(daily, ["topic_id", "day"], "left").select(
        "topic_id", F.coalesce("n", F.lit(0)).cast("double").alias("y"), F.datediff("day", F.lit(first_day).cast("date")).cast("double").alias("x")
    )
    return series.groupBy("topic_id").agg(F.round(F.regr_slope("y", "x"), 6).alias("score"), F.sum("y").cast("long").alias("evidence")).filter(
        (F.col("score") > min_slope) & (F.col("evidence") >= min_evidence)
    ).withColumn("kind", F.lit("trend"))


# ---- evidence, severity ---------------------------------------------------------------------
def evidence_part(rows: DataFrame, signal: Column, target: str, target_id: Column, weight: Column, ids: str = "long") -> DataFrame:
    """Evidence rows of one target; ``ids`` is the type of the target ids, the same in all parts that are assembled."""
    return rows.select(
        signal.cast("string").alias("signal_key"), F.lit(target).alias("target"), target_id.cast(ids).alias("target_id"),
        weight.cast("double").alias("raw_weight"),
    )


def assemble_evidence(parts: list[DataFrame], min_evidence: int = P.min_evidence) -> DataFrame:
    """Evidence of every signal: weights that sum to one, ranked by weight.

    Ranks compare each weight with the signal's mean weight, to four decimals, so they hold for signals of any
    number of rows. Totals are a partial aggregate joined back by salted key; ranks are counted per
    weight step, so a signal with very many rows is spread over its steps.
    """
    rows = reduce(DataFrame.unionByName, parts).groupBy("signal_key", "target", "target_id").agg(F.sum("raw_weight").alias("raw_weight"))
    totals = rows.groupBy("signal_key").agg(F.sum("raw_weight").alias("_t"), n_rows().alias("evidence_count")).filter(
        (F.col("evidence_count") >= min_evidence) & (F.col("_t") > 0)
    )
    share = F.col("raw_weight") / F.col("_t")
    weighted = salted_join(rows, totals, ["signal_key"], ["target", "target_id"]).withColumn("weight", F.round(share, 12)).withColumn(
        "_w", F.round(share * F.col("evidence_count"), 4)
    )
    near = F.substring("target_id", 1, 4) if dict(rows.dtypes)["target_id"] == "string" else F.floor(F.col("target_id") / 4096)
    step = F.struct(-F.col("_w"), F.col("target"), near)
    ranked = bucketed_positions(weighted, ["signal_key"], step, [F.desc("_w"), F.asc("target"), F.asc("target_id")], "_p")
    return ranked.withColumn("rank", F.col("_p") + 1).drop("_p", "_t", "_w", "raw_weight")


def evidence_of_signals(
    found: DataFrame, membership: DataFrame, mentions: DataFrame, assignments: DataFrame, stories: DataFrame, min_evidence: int = P.min_evidence,
) -> DataFrame:
    """The evidence behind signals of any kind, on all four targets: records, entities, topics and stories.

    ``found`` has ``signal_key``, what the signal is about (``scope``: topic, kind, entity or phrase, and its ``value``; several
    rows where it is about several) and the ``days`` up to ``last`` that it looks at. ``membership`` has the records of each
    scope and value by ``day``; the join is on all three, so a hot topic is one key a day. A signal's records bring the
    entities they mention, the topics they are assigned to and the active stories drawn from them. Weights: a record a half, a
    mentioned entity or a story drawn from it a quarter, a topic an eighth, summed by target.
    """
    asked = found.select("signal_key", "scope", "value", F.explode(F.sequence(F.date_sub("last", F.col("days") - 1), F.col("last"))).alias("day"))
    rows = stored(membership.join(asked, ["scope", "value", "day"]).select("signal_key", "record_id").distinct(), "signal-records")
    drawn = stories.filter("active").select(F.col("id").alias("story_id"), F.explode("source_record_ids").alias("r")).select("story_id", F.col("r").cast("long").alias("record_id"))
    key, parts = F.col("signal_key"), [evidence_part(rows, F.col("signal_key"), "record", F.col("record_id"), F.lit(0.5), "string")]
    for target, links, column, weight in (
        ("entity", mentions, "entity_id", 0.25), ("topic", assignments, "topic_id", 0.125), ("story", drawn, "story_id", 0.25),
    ):
        linked = rows.join(links.select("record_id", column).distinct(), "record_id")
        parts.append(evidence_part(linked, key, target, F.col(column), F.lit(weight), "string"))
    return assemble_evidence(parts, min_evidence)


def with_severity(signals: DataFrame, key: Column, window_day: Column) -> DataFrame:
    """Score squashed to [0, 1), its band, and the dedup key of the window."""
    size = F.abs(F.col("score"))
    strength = F.round(size / (size + 1), 6)
    return signals.withColumn("strength", strength).withColumn("severity", severity_band(F.col("strength"))).withColumn(
        "dedup_key", F.concat_ws("|", key.cast("string"), window_day.cast("string"))
    )


def as_signals(found: DataFrame, kind: str, subject: Column, window: Column, evidence: Column, topic: Column | None = None) -> DataFrame:
    """A detector's rows in the common shape: kind, topic_id, subject, window, score, evidence."""
    return found.select(
        F.lit(kind).alias("kind"), (F.lit(None) if topic is None else topic).cast("long").alias("topic_id"), subject.cast("string").alias("subject"),
        window.cast("string").alias("window"), F.col("score").cast("double"), evidence.cast("long").alias("evidence"),
    )


def signal_flow(parts: list[DataFrame], existing: DataFrame | None = None, min_evidence: int = P.min_evidence) -> DataFrame:
    """All detectors' findings as new signals: gated by evidence, with strength, severity, dedup key and rank in their kind.

    ``existing`` holds stored signals (kind, topic_id, dedup_key); what is there already is left out. Ranks run over
    signals, which are aggregates, not over records.
    """
    enough = reduce(DataFrame.unionByName, parts).filter(F.col("evidence") >= min_evidence)
    rated = with_severity(enough, F.col("subject"), F.col("window"))
    fresh = rated if existing is None else absent(rated, existing, ["kind", "topic_id", "dedup_key"])
    order = W.partitionBy("kind").orderBy(F.desc("strength"), F.asc("dedup_key"), F.asc_nulls_first("topic_id"))
    return fresh.withColumn("rank", F.row_number().over(order))


# ---- guards and gates -----------------------------------------------------------------------
def signal_guards(
    arrivals: DataFrame, assignments: DataFrame, embedded: DataFrame, as_of: Column, window_days: int,
    min_share: float = P.embedded_share_min, backfill_hours: int = P.backfill_hours,
) -> DataFrame:
    """Whether a topic's window is complete enough for detectors.

    Backfilled rows are left out; the share of embedded records must reach ``min_share``.
    """
    live = F.unix_seconds("ingested_at") - F.unix_seconds("captured_at") <= backfill_hours * 3600
    inside = arrivals.filter((F.col("captured_at") > since(as_of, window_days)) & (F.col("captured_at") <= as_of))
    rows = topic_rows(assignments, inside.withColumn("live", live), "live")
    marks = embedded.select("record_id").distinct().withColumn("_e", F.lit(True))
    sums = rows.join(marks, "record_id", "left").groupBy("topic_id").agg(
        n_rows().alias("records"), F.count_if(~F.col("live")).alias("backfilled"),
        F.count_if(F.col("live") & F.col("_e").isNotNull()).alias("_emb"), F.count_if("live").alias("_live"),
    )
    share = F.round(F.col("_emb") / F.nullif("_live", F.lit(0)), 6)
    return sums.withColumn("embedded_share", share).withColumn(
        "ready", F.coalesce(F.col("embedded_share") >= min_share, F.lit(False))
    ).drop("_emb", "_live")


def thin_beats(rows: DataFrame, min_records: int = P.thin_min_records, min_kinds: int = P.thin_min_kinds) -> DataFrame:
    """Topics with too few records or too few source kinds (``rows`` from ``topic_rows`` with ``kind``)."""
    counts = rows.groupBy("topic_id", "kind").agg(n_rows().alias("_n")).groupBy("topic_id").agg(
        F.sum("_n").alias("records"), n_rows().alias("kinds")
    )
    return counts.filter((F.col("records") < min_records) | (F.col("kinds") < min_kinds))


def saturation_gate(signals: DataFrame, evidence: DataFrame, stories: DataFrame, as_of: Column, cover_days: int) -> DataFrame:
    """Signals with the number of evidence records no recent story of the topic has used.

    A signal is suppressed when its topic was covered in the last ``cover_days`` and nothing new
    arrived.
    """
    recent = stories.filter((F.col("generated_at") > since(as_of, cover_days)) & (F.col("generated_at") <= as_of))
    covered = recent.select("topic_id").distinct().withColumn("_c", F.lit(True))
    used = recent.select("topic_id", F.explode(F.col("source_record_ids").cast("array<bigint>")).alias("record_id")).distinct()
    rows = evidence.filter(F.col("record_id").isNotNull()).select(F.col("signal_id").alias("id"), "record_id").join(
        signals.select("id", "topic_id"), "id"
    )
    fresh = absent(rows, used, ["topic_id", "record_id"]).groupBy("id").agg(F.countDistinct("record_id").alias("new_evidence"))
    return signals.join(fresh, "id", "left").join(covered, "topic_id", "left").withColumn(
        "new_evidence", F.coalesce("new_evidence", F.lit(0))
    ).withColumn("suppressed", F.col("_c").isNotNull() & (F.col("new_evidence") == 0)).drop("_c")


def entity_novelty_active(entities: DataFrame, signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entities with an open novelty signal pointing at them."""
    novel = signals.filter((F.col("kind") == "novelty") & ~F.col("acknowledged")).select(F.col("id").alias("signal_id"))
    hit = evidence.filter(F.col("target") == "entity").join(novel, "signal_id", "left_semi").select(
        F.col("entity_id").alias("id")
    ).distinct().withColumn("_h", F.lit(True))
    return entities.join(hit, "id", "left").withColumn("novelty_active", F.col("_h").isNotNull()).drop("_h")


def seeding_score(rows: DataFrame) -> DataFrame:
    """Extension: share of exact copies and concentration of authors per topic and day.

    ``rows`` has ``topic_id, day, author, text_hash``. Copies and authors are counted per value
    first; only the counts meet in one place.
    """
    copies = rows.groupBy("topic_id", "day", "text_hash").agg(n_rows().alias("_n")).groupBy("topic_id", "day").agg(
        F.sum("_n").alias("records"), F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("_dup")
    )
    authors = rows.groupBy("topic_id", "day", "author").agg(n_rows().cast("double").alias("_n")).groupBy("topic_id", "day").agg(
        F.sum(F.col("_n") * F.col("_n")).alias("_sq"), F.sum("_n").alias("_t")
    )
    return copies.join(authors, ["topic_id", "day"]).select(
        "topic_id", "day", "records", F.round(F.col("_dup") / F.col("records"), 6).alias("copy_share"),
        F.round(F.col("_sq") / (F.col("_t") * F.col("_t")), 6).alias("author_concentration"),
    )


# ---- saturation states ----------------------------------------------------------------------
def token_shares(words: DataFrame, min_count: int) -> DataFrame:
    """Share of each frequent word per window against its share in all earlier windows.

    ``words`` is (window_no, token, n). Rare words are cut by their total count, which only
    bounds what is tracked. The windows of one word are few rows.
    """
    totals = words.groupBy("window_no").agg(F.sum("n").alias("_t"))
    earlier = W.orderBy("window_no").rowsBetween(W.unboundedPreceding, -1)  # one row per window
    totals = totals.withColumn("_t_before", F.sum("_t").over(earlier))
    frequent = words.groupBy("token").agg(F.sum("n").alias("_n")).filter(F.col("_n") >= min_count).select("token")
    before = W.partitionBy("token").orderBy("window_no").rowsBetween(W.unboundedPreceding, -1)
    windows = totals.agg(F.collect_list(F.struct("window_no", "_t", "_t_before"))).scalar()  # one entry per window
    grid = frequent.withColumn("_w", windows)
    full = grid.select("token", F.inline("_w")).join(words, ["token", "window_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ratio = (F.col("n") / F.col("_t")) / (F.col("_before") / F.col("_t_before"))
    return full.withColumn("_before", F.sum("n").over(before)).select(
        "token", "window_no", "n", F.round(F.when(F.col("_before") > 0, ratio), 6).alias("ratio")
    )


def next_token_state(state: Column, ratio: Column, low: float, high: float) -> Column:
    """One step: untracked, monitored and saturated are neighbours; a missing ratio counts as zero."""
    r = F.coalesce(ratio, F.lit(0.0))
    return (
        F.when(state == "untracked", F.when(r >= low, "monitored").otherwise("untracked"))
        .when(state == "monitored", F.when(r >= high, "saturated").when(r < low, "untracked").otherwise("monitored"))
        .when(state == "saturated", F.when(r < high, "monitored").otherwise("saturated"))
        .otherwise(state)
    )


def saturation_states(
    shares: DataFrame, overrides: DataFrame, low: float = P.saturation_low, high: float = P.saturation_high
) -> DataFrame:
    """State of each word after every window; words an operator removed stay ``removed``.

    The series of one word (one entry per window) is folded in order.
    """
    series = shares.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("window_no", "ratio"))).alias("_s"))
    start = F.array(F.struct(F.lit(-1).cast("long").alias("window_no"), F.lit("untracked").alias("state")))
    folded = F.aggregate(
        "_s", start,
        lambda acc, x: F.concat(acc, F.array(F.struct(
            x["window_no"].cast("long").alias("window_no"),
            next_token_state(F.element_at(acc, -1)["state"], x["ratio"], low, high).alias("state")))),
    )
    removed = overrides.select("token").distinct().withColumn("_o", F.lit(True))
    return series.select("token", F.inline(F.slice(folded, F.lit(2), F.size("_s")))).join(removed, "token", "left").select(
        "token", "window_no", F.when((F.col("state") == "saturated") & F.col("_o").isNotNull(), "removed").otherwise(F.col("state")).alias("state")
    )
