"""One stream of event envelopes, routed by type to nine typed sinks; what does not keep to its type is kept apart.

An envelope is (event_type, payload, sent_at): the payload is the event as JSON. A batch is read once: each payload is parsed by
its type's schema and judged by its type's rules, and all valid events go to one store partitioned by type in a single
write; the others go to a dead-letter store with the reason. A type's sink is that partition, read with the type's columns.
A retried batch rewrites its own folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorascope.schemas import ARC_STATUSES, CONTENT_TYPES, EVIDENCE_TARGETS, SEVERITIES, SOURCE_KINDS, STORY_TYPES, STREAMS, VARIANT_TYPES
from agorascope.session import fresh_dir
from agorascope.streaming.flows import finish

#: Fields that may be absent or NULL.
NULLABLE = {
    "topic_assigned": {"confidence"}, "signal_detected": {"topicId"}, "story_enriched": {"arcId"}, "arc_updated": {"triggerStoryId"},
    "story_published": {"topicId", "entityName", "previousVersionId", "publishAt", "fromEnrichment"},
}


def _of(field: str) -> Column:
    return F.col(f"e.{field}")


def _among(field: str, values: tuple[str, ...]) -> tuple[str, Column]:
    return f"{field} outside its domain", _of(field).isin(*values)


def _all_among(field: str, values: tuple[str, ...]) -> tuple[str, Column]:
    inside = (F.size(_of(field)) > 0) & F.forall(_of(field), lambda x: x.isin(*values))
    return f"{field} empty or outside its domain", inside


def _at_least(field: str, least: int) -> tuple[str, Column]:
    return f"{field} below {least}", _of(field) >= least


def rules(event_type: str) -> list[tuple[str, Column]]:
    """(reason, condition that must hold) of a type beyond its required fields."""
    return {
        "record_ingested": [_among("kind", SOURCE_KINDS), _among("contentType", CONTENT_TYPES)],
        "entities_extracted": [_at_least("entityCount", 0)],
        "embedding_ready": [_at_least("dimensions", 1)],
        "topic_assigned": [],
        "signal_detected": [_among("severity", SEVERITIES), _all_among("evidenceTargets", EVIDENCE_TARGETS)],
        "story_published": [_among("type", STORY_TYPES), _at_least("version", 1)],
        "story_enriched": [_at_least("enrichmentVersion", 1), _at_least("externalCitationCount", 0), _at_least("variantCount", 0)],
        "arc_updated": [_at_least("arcId", 1), _among("arcStatus", ARC_STATUSES), _at_least("storyCount", 0)],
        "variants_generated": [_all_among("variantTypes", VARIANT_TYPES)],
    }[event_type]


def _fault(event_type: str) -> Column:
    """Why the parsed struct ``e`` is no event of the type; NULL for a valid one."""
    fault = F.when(F.col("e").isNull() | _of("_corrupt").isNotNull(), F.lit("payload does not parse"))
    for field in T.StructType.fromDDL(STREAMS[event_type]).names:
        if field not in NULLABLE.get(event_type, ()):
            fault = fault.when(_of(field).isNull(), F.lit(f"{field} is missing"))
    for reason, holds in rules(event_type):
        fault = fault.when(~F.coalesce(holds, F.lit(False)), F.lit(reason))
    return fault


def judged(envelopes: DataFrame) -> DataFrame:
    """``envelopes`` with ``reason``: NULL where the payload is a valid event of its type."""
    out = envelopes.withColumn("reason", F.when(F.coalesce(F.col("event_type").isin(*STREAMS), F.lit(False)), F.lit(None)).otherwise(F.lit("unknown type")))
    for event_type, fields in STREAMS.items():
        own = F.col("event_type") == event_type
        parsed = F.from_json("payload", f"{fields}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        out = out.withColumn("e", F.when(own, parsed)).withColumn("reason", F.when(own, _fault(event_type)).otherwise(F.col("reason"))).drop("e")
    return out


@dataclass(frozen=True)
class Sinks:
    """The stores that a run of ``route`` has written."""

    valid: DataFrame
    dead: DataFrame

    def events(self, event_type: str) -> DataFrame:
        """The typed events of one type; only its partition is read."""
        rows = self.valid.filter(F.col("event_type") == event_type)
        return rows.select("sent_at", F.from_json("payload", STREAMS[event_type]).alias("e")).select("sent_at", "e.*")


def route(envelopes: DataFrame) -> Sinks:
    """Run a stream of ``envelopes`` (event_type, payload, sent_at) to its end, into the typed sinks and the dead letters."""
    spark, root = envelopes.sparkSession, fresh_dir(envelopes.sparkSession, "envelopes")
    columns = T.StructType.fromDDL("payload string, sent_at timestamp")
    good, bad = columns.add("event_type", T.StringType()), T.StructType.fromDDL("event_type string, payload string, sent_at timestamp, reason string")
    spark.createDataFrame([], columns).write.parquet(f"{root}/valid/batch=-1/event_type=none")
    spark.createDataFrame([], bad).write.parquet(f"{root}/dead/batch=-1")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = judged(batch.select("event_type", "payload", "sent_at")).persist()
        rows.filter("reason IS NULL").select("payload", "sent_at", "event_type").write.mode("overwrite").partitionBy("event_type").parquet(f"{root}/valid/batch={batch_id}")
        rows.filter("reason IS NOT NULL").select(*bad.names).write.mode("overwrite").parquet(f"{root}/dead/batch={batch_id}")
        rows.unpersist()

    finish(envelopes.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/checkpoint"))
    batch = T.StructField("batch", T.LongType())
    valid = spark.read.schema(T.StructType([*good.fields, batch])).parquet(f"{root}/valid")
    return Sinks(valid.drop("batch"), spark.read.schema(T.StructType([*bad.fields, batch])).parquet(f"{root}/dead").drop("batch"))
