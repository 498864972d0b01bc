"""Canonical corpus frames bound to the driver's tables.

``Corpus(spark, folder)`` derives every corpus table (records, mentions, stories, ...) from
the parquet files in ``folder`` with DataFrame operations only, so the work of each query
grows with those files. Frames are lazy and never cached; columns nobody asks for are not
read. Joins to ``documents`` and ``pages`` are only in the frames that need them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agorascope.functions.rules import category, lookup
from agorascope.functions.text import host, tokens
from agorascope.schemas import (
    ARC_STATUSES, CITATION_TYPES, SIGNAL_KINDS, SOURCE_KINDS, STORY_TYPES, TIERS, VARIANT_TYPES,
)
from agorascope.session import prepare

AS_OF = "2024-01-31 00:00:00"  # end of the fixture month
SCHEDULED = "2024-02-01 00:00:00"

# Two keywords per topic, in topic order: fixture constants.
TOPIC_KEYWORDS = (
    "thble", "anea", "thor", "thea", "thti", "eron", "eren", "erer", "thly", "thing",
    "thnd", "thsh", "thst", "erre", "eran", "erth", "ered", "erhe", "erst", "eror",
    "erat", "thwh", "erly", "ernd", "erwh", "attion", "onan", "eres", "erble", "anon",
    "onnd", "erea", "ernt", "ersh", "ertion", "onre", "onth", "oned", "oner", "erha",
)
FACT_TYPES = ("statistic", "quote", "event", "claim", "context")
RELATIONS = ("follows", "contradicts", "elaborates", "background")
REGISTERS = ("calm", "alarm", "hype", "doubt")
TIER_NAMES = tuple(t[0] for t in TIERS)


_SCHEMAS: dict[str, StructType] = {}  # schema by path, so that a table's footer is read once a process


class Corpus:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp")

    def spread(self, frame: DataFrame) -> DataFrame:
        """Rows dealt out over all cores before heavy per-row text work.

        For inputs of few, unsplittable files. ``agorascope.textPartitions`` sets the number; unset means
        none, on any master.
        """
        wanted = int(self.spark.conf.get("agorascope.textPartitions", "0"))
        return frame.repartition(wanted) if wanted > 0 else frame

    @cached_property
    def documents(self) -> DataFrame:
        """Documents ready for work on their text."""
        return self.spread(self.table("documents"))

    def _top(self, table: str, column: str, plus: int = 0):
        """max(column) + plus of a driver table as a scalar subquery."""
        return self.table(table).agg((F.max(column) + plus).alias("v")).scalar()

    # ---- events and records --------------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props",
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        )

    @cached_property
    def core(self) -> DataFrame:
        """Records without the columns that come from documents and pages."""
        e = self.events
        i, k = F.col("event_id"), F.col("k")
        kind = lookup(SOURCE_KINDS, i % 9)
        cat = category(kind)
        scored = k % 10 != 0
        return e.select(
            i.alias("id"), kind.alias("kind"), cat.alias("category"),
            F.when(cat == "article", "article").when(i % 3 == 0, "post").otherwise("comment").alias("content_type"),
            i.cast("string").alias("external_id"), (i % 9 + 1).cast("int").alias("source_config_id"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
            F.col("ts").alias("captured_at"), F.col("props").alias("source_metadata"),
            F.when(cat == "article", F.concat(F.lit("Article "), i.cast("string"))).alias("title"),
            F.when(scored, (k - 50) / F.lit(50.0)).alias("sentiment_score"),
            F.when(~scored, None).when(k > 60, "positive").when(k < 40, "negative").otherwise("neutral")
            .alias("sentiment_label"),
            lookup(REGISTERS, k % 4).alias("emotional_register"),
            (i % self._top("documents", "doc_id", 1)).alias("doc_id"),
            (i % self._top("pages", "page_id", 1)).alias("page_id"),
        )

    def _with_url(self, frame: DataFrame) -> DataFrame:
        pages = self.table("pages").select("page_id", "url")
        return frame.join(pages, "page_id", "left").withColumn(
            "publisher", F.when(F.col("category") == "article", host(F.col("url")))
        )

    def _with_text(self, frame: DataFrame) -> DataFrame:
        docs = self.table("documents").select(
            "doc_id", F.col("text").alias("content_text"), F.col("lang").alias("language")
        )
        return self.spread(frame).join(docs, "doc_id", "left")

    @cached_property
    def records(self) -> DataFrame:
        return self._with_text(self._with_url(self.core))

    @cached_property
    def records_url(self) -> DataFrame:
        return self._with_url(self.core)

    @cached_property
    def records_text(self) -> DataFrame:
        return self._with_text(self.core)

    @cached_property
    def items(self) -> DataFrame:
        """Provider items; every fifth one is delivered twice."""
        i, k = F.col("event_id"), F.col("k")
        story = i % 3 == 0
        kind = F.when(i % 11 == 0, "job").when(i % 11 == 1, "poll").when(story, "story").otherwise("comment")
        once = self.events.select(
            i.alias("id"), kind.alias("type"),
            F.when(i % 17 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("by"),
            F.floor(F.unix_micros("ts") / 1_000_000).cast("long").alias("time"),
            F.when(story, F.concat(F.lit("Item "), i.cast("string"))).alias("title"),
            F.col("event_type").alias("text"),
            F.when(story, F.concat(F.lit("https://www.example.org/item/"), i.cast("string"))).alias("url"),
            F.when(k % 10 != 0, k).alias("score"),
            F.when(story, k % 7).alias("descendants"),
            F.when(k % 2 == 0, F.array(i + 1, i + 2)).alias("kids"),
            F.when(~story, i - 1).alias("parent"),
            (i % 29 == 0).alias("deleted"), (i % 23 == 0).alias("dead"),
        )
        times = F.when(F.col("id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return once.withColumn("delivery", F.explode(times))

    @cached_property
    def feed(self) -> DataFrame:
        i = F.col("event_id")
        both = F.array(
            F.struct(F.lit("new").alias("feed"), (self._top("events", "event_id") - i).alias("rank")),
            F.struct(F.lit("top").alias("feed"), (i * 7919 % 1_000_003).alias("rank")),
        )
        return self.events.select(i.alias("id"), F.inline(both))

    # ---- vectors, topics, entities --------------------------------------------------------
    @cached_property
    def embeddings(self) -> DataFrame:
        v = F.col("embedding")
        models = F.array(
            F.struct(F.lit("m64").alias("model_name"), v.alias("vector")),
            F.struct(F.lit("m32").alias("model_name"), F.slice(v, 1, 32).alias("vector")),
        )
        return self.table("embeddings").select(F.col("vec_id").alias("record_id"), F.inline(models)).withColumn(
            "dimensions", F.size("vector")
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """The m64 vectors alone."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster")
        )

    @cached_property
    def topics(self) -> DataFrame:
        words = F.array(*[F.lit(w) for w in TOPIC_KEYWORDS])
        n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
        return self.table("documents").select("source").distinct().select(
            n.alias("id"), F.col("source").alias("name"),
            F.concat(F.lit("Topic "), n.cast("string")).alias("display_name"),
            F.concat(F.lit("c"), (n % 4).cast("string")).alias("cluster"),
            F.slice(words, n * 2 + 1, F.lit(2)).alias("keywords"),
            F.lit(True).alias("active"),
        )

    @cached_property
    def assignments(self) -> DataFrame:
        docs = self.table("documents").select(
            "doc_id", F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("topic_id")
        )
        keyword = self.core.select("id", "doc_id").join(docs, "doc_id").select(
            F.col("id").alias("record_id"), "topic_id", F.lit("keyword").alias("method"),
            F.lit(None).cast("double").alias("confidence"),
        )
        cluster = self.vectors.select(
            "record_id", F.col("cluster").alias("topic_id"), F.lit("cluster"), F.lit(0.9)
        )
        return keyword.union(cluster)

    @cached_property
    def entities(self) -> DataFrame:
        nations = self.table("nation").select(
            F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("organization").alias("type")
        )
        brands = self.table("part").select("p_brand").distinct().select(
            (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") + 100), "p_brand", F.lit("technology")
        )
        statuses = self.table("orders").select("o_orderstatus").distinct().select(
            F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 201).otherwise(202),
            F.concat(F.lit("Status "), F.col("o_orderstatus")), F.lit("status"),
        )
        return nations.union(brands).union(statuses).withColumn(
            "indexability", F.when(F.col("id") % 3 == 1, "index").when(F.col("id") % 3 == 2, "noindex")
        )

    @cached_property
    def mentions(self) -> DataFrame:
        i, u = F.col("event_id"), F.col("user_id")

        def hit(entity, offset):
            return F.struct(entity.cast("int").alias("entity_id"), F.lit(offset).cast("int").alias("start_offset"))

        hits = F.filter(
            F.array(
                hit(i * 7 % 25, 0),
                hit(u % 25, None),
                F.when(i % 10 == 0, hit(u % 25, None)),
                F.when(i % 4 == 0, hit(i % 25 + 101, 10)),
                F.when(i % 50 == 0, hit(i % 3 + 200, 20)),
            ),
            lambda h: h.isNotNull(),
        )
        return self.events.select(
            i.alias("record_id"), F.col("ts").alias("captured_at"),
            ((F.col("k") % 50 + 50) / F.lit(100.0)).alias("confidence"), F.inline(hits),
        ).withColumn("end_offset", F.col("start_offset") + 8)

    # ---- signals --------------------------------------------------------------------------
    @cached_property
    def signals(self) -> DataFrame:
        i, k = F.col("event_id"), F.col("k")
        return self.events.filter(F.col("event_type") == "error").select(
            i.alias("id"), lookup(SIGNAL_KINDS, i % 11).alias("kind"),
            F.when(i % 5 != 0, (i % 20).cast("int")).alias("topic_id"),
            F.when(k < 50, "low").when(k < 80, "medium").otherwise("high").alias("severity"),
            F.concat(F.lit("Signal "), i.cast("string")).alias("headline"),
            (k / F.lit(100.0)).alias("score"), F.col("ts").alias("detected_at"),
            F.when(i % 3 != 0, F.to_date("ts").cast("string")).alias("dedup_key"),
            (i % 2 == 0).alias("acknowledged"),
        )

    @cached_property
    def evidence(self) -> DataFrame:
        i = F.col("id")

        def row(target, weight, record=None, entity=None, topic=None, story=None):
            none = F.lit(None)
            return F.struct(
                F.lit(target).alias("target"),
                (none if record is None else record).cast("long").alias("record_id"),
                (none if entity is None else entity).cast("int").alias("entity_id"),
                (none if topic is None else topic).cast("int").alias("target_topic_id"),
                (none if story is None else story).cast("string").alias("story_id"),
                F.lit(weight).alias("weight"),
            )

        rows = F.filter(
            F.array(
                row("record", 0.5, record=i * 13 % F.col("n_records")),
                F.when(i % 2 == 0, row("entity", 0.3, entity=i % 25)),
                F.when(i % 4 == 0, row("topic", 0.1, topic=i % 20)),
                F.when(i % 3 == 0, row("story", 0.1, story=i % F.col("n_chains") * 100)),
            ),
            lambda r: r.isNotNull(),
        )
        sized = self.signals.select(
            "id", self._top("events", "event_id", 1).alias("n_records"),
            self._top("conversations", "conv_id", 1).alias("n_chains"),
        )
        return sized.select(i.alias("signal_id"), F.inline(rows))

    # ---- stories --------------------------------------------------------------------------
    @cached_property
    def _turns(self) -> DataFrame:
        last = self.table("conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
        return self.table("conversations").join(last, "conv_id")

    @cached_property
    def stories(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        ne = self._top("events", "event_id")
        base = self._turns.withColumn("event_id", c * 17 % (ne - 64) + t).join(
            self.events.select("event_id", F.col("ts").alias("generated_at")), "event_id"
        )
        n = self._top("events", "event_id", 1)
        return base.select(
            (c * 100 + t).cast("string").alias("id"), F.concat(F.lit("conv-"), c.cast("string")).alias("slug"),
            lookup(STORY_TYPES, c % 5).alias("type"), (c % 20).cast("int").alias("topic_id"),
            F.substring("text", 1, 60).alias("headline"), F.substring("text", 1, 200).alias("synopsis"),
            F.col("text").alias("content"), lookup(ARC_STATUSES, t % 5).alias("arc_status"), "generated_at",
            F.when(c % 20 == 3, F.lit(SCHEDULED).cast("timestamp"))
            .when(c % 4 == 0, F.col("generated_at") + F.expr("INTERVAL 1 HOUR")).alias("publish_at"),
            (t == F.col("last_turn")).alias("active"),
            F.when(c % 5 == 4, F.concat(F.lit("NATION_"), (c % 25).cast("string"))).alias("entity_name"),
            (t + 1).cast("int").alias("version"),
            F.when(t > 0, (c * 100 + t - 1).cast("string")).alias("previous_version_id"),
            (t % 3).cast("int").alias("enrichment_version"),
            F.when(t % 3 > 0, F.col("generated_at")).alias("enriched_at"),
            F.concat(F.lit("model-"), (c % 3).cast("string")).alias("generation_model"),
            F.array(*[((c * 31 + t * 7 + m) % n).cast("string") for m in (1, 2)]).alias("source_record_ids"),
            "conv_id", "turn",
        )

    @cached_property
    def citations(self) -> DataFrame:
        c, t, m = F.col("conv_id"), F.col("turn"), F.col("marker")
        n, np = self._top("events", "event_id", 1), self._top("pages", "page_id", 1)
        three = self.table("conversations").select(
            "conv_id", "turn", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("marker")
        ).withColumn("page_id", F.when(m == 3, (c + t) % np))
        record = F.when(m < 3, (c * 31 + t * 7 + m) % n)
        return three.join(self.table("pages").select("page_id", "url"), "page_id", "left").select(
            (c * 100 + t).cast("string").alias("story_id"), "marker",
            F.when(m < 3, CITATION_TYPES[0]).otherwise(CITATION_TYPES[1]).alias("citation_type"),
            record.alias("record_id"), F.col("url").alias("external_url"), host(F.col("url")).alias("domain"),
            lookup(SOURCE_KINDS, record % 9).alias("platform"),
            lookup(FACT_TYPES, (c + m) % 5).alias("fact_type"),
            ((c * 7 + t * 3 + m) % 100 / F.lit(100.0)).alias("credibility_score"),
            (m == 2).alias("inferred"), m.alias("position"),
        )

    @cached_property
    def active_stories(self) -> DataFrame:
        return self.stories.filter("active")

    @cached_property
    def arcs(self) -> DataFrame:
        a = (F.col("conv_id") % 10).cast("int")
        return self.table("conversations").select(a.alias("id")).distinct().select(
            "id", F.concat(F.lit("arc-"), F.col("id").cast("string")).alias("slug"),
            F.concat(F.lit("Arc "), F.col("id").cast("string")).alias("title"), F.col("id").alias("topic_id"),
        )

    @cached_property
    def membership(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        return self.table("conversations").select(
            (c * 100 + t).cast("string").alias("story_id"), (c % 10).cast("int").alias("arc_id")
        )

    @cached_property
    def _live(self) -> DataFrame:
        """One row per chain: its last turn, without the story columns."""
        c = F.col("conv_id")
        return self._turns.filter(F.col("turn") == F.col("last_turn")).select(
            "conv_id", "turn", "text", (c * 100 + F.col("turn")).cast("string").alias("story_id")
        )

    @cached_property
    def variants(self) -> DataFrame:
        c = F.col("conv_id")
        return self._live.select(
            "story_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"), "conv_id", "text"
        ).select(
            "story_id", lookup(VARIANT_TYPES, (c + F.col("d")) % 6).alias("variant_type"),
            F.substring("text", 1, 80).alias("content"),
        )

    @cached_property
    def references(self) -> DataFrame:
        c = F.col("conv_id")

        def ref(kind, value):
            return F.struct(F.lit(kind).alias("ref_type"), value.alias("ref_slug"))

        return self._live.select("story_id", F.inline(F.array(
            ref("entity", F.concat(F.lit("nation-"), (c % 30).cast("string"))),
            ref("beat", F.concat(F.lit("src"), (c % 22).cast("string"))),
            ref("story", F.concat(F.lit("conv-"), (c + 1).cast("string"))),
        )))

    @cached_property
    def related(self) -> DataFrame:
        c = F.col("conv_id")
        out = self._live.select(
            "story_id", "conv_id", F.explode(F.array(c + 1, c + 5)).alias("other_conv")
        )
        other = self._live.select(F.col("conv_id").alias("other_conv"), F.col("story_id").alias("related_id"))
        return out.join(other, "other_conv").select(
            "story_id", "related_id", lookup(RELATIONS, c % 4).alias("relationship_type"),
            ((c * 13 + F.col("other_conv")) % 1000 / F.lit(1000.0)).alias("similarity_score"),
        )

    @cached_property
    def seo(self) -> DataFrame:
        c = F.col("conv_id")
        title = F.expr("substring(text, 1, CAST(5 + conv_id % 50 AS INT))")
        story = self._turns.select(
            F.lit("story").alias("page_type"), F.concat(F.lit("conv-"), c.cast("string")).alias("page_id"),
            title.alias("seo_title"), F.expr("substring(text, 1, CAST(conv_id % 200 AS INT))").alias("seo_description"),
            F.when(c % 3 != 0, title).alias("og_title"), F.substring("text", 1, 220).alias("og_description"),
            F.slice(tokens(F.col("text")), F.lit(1), (c % 13).cast("int")).alias("keywords"),
            (F.col("turn") + 1).cast("int").alias("version"), (F.col("turn") == F.col("last_turn")).alias("active"),
        )
        none = F.lit(None).cast("string")
        words = F.lit(None).cast("array<string>")

        def plain(frame, kind, page):
            return frame.select(
                F.lit(kind), page, F.concat(F.lit("All about "), page), none, none, none, words, F.lit(1), F.lit(True)
            )

        beats = plain(self.topics, "beat", F.col("name"))
        ents = plain(self.entities, "entity", F.lower("name"))
        arcs = plain(self.arcs, "arc", F.col("slug"))
        return story.union(beats).union(ents).union(arcs)

    @cached_property
    def verdicts(self) -> DataFrame:
        """Judge verdict per chain, an input: labelled good, labelled bad, or no row at all."""
        good = (F.col("quality") == 1) & (F.col("toxic") == 0)
        return self.table("labels").select(F.col("doc_id").alias("conv_id"), good.alias("quality_passed"))

    # ---- service logs ---------------------------------------------------------------------
    @cached_property
    def usage(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("key_id"), lookup(TIER_NAMES, F.col("user_id") % 6).alias("tier"),
            F.when(F.col("user_id") % 6 == 3, 5).otherwise(1).alias("seats"), F.col("ts").alias("called_at"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("endpoint_id"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
            F.md5(F.floor(F.col("event_id") / 2).cast("string")).alias("idempotency_key"),
            F.col("ts").alias("attempted_at"),
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("subscriber_id"), (F.col("c_custkey") % 25).cast("int").alias("entity_id"),
            lookup(("instant", "daily", "weekly"), F.col("c_custkey") % 3).alias("cadence"),
        )

    @cached_property
    def saved_searches(self) -> DataFrame:
        return self.table("benchmark").select(
            F.col("item_id").alias("search_id"),
            F.concat_ws(" ", F.slice(tokens(F.col("text")), 1, 2)).alias("query"),
        )

    @cached_property
    def arrivals(self) -> DataFrame:
        """Records with the time they reached us; every thirteenth arrives two days late."""
        late = F.col("id") % 13 == 0
        return self.core.withColumn(
            "ingested_at",
            F.when(late, F.col("captured_at") + F.expr("INTERVAL 2 DAYS"))
            .otherwise(F.col("captured_at") + F.expr("INTERVAL 1 MINUTE")),
        )
