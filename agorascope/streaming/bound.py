"""The fixture corpus with ``events`` and ``embeddings`` read as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.sources.fixtures import Corpus
from agorascope.streaming.flows import read_stream


class StreamCorpus(Corpus):
    """Same frames as ``Corpus``, of streaming events; other tables stay static."""

    streamed = ("events",)

    def table(self, name: str) -> DataFrame:
        if name not in self.streamed:
            return super().table(name)
        schema = super().table(name).schema
        return read_stream(self.spark, self.folder, f"{name}.parquet", schema)

    def ready_embeddings(self) -> DataFrame:
        """EmbeddingReady events five minutes after capture, from a second stream; every third is lost."""
        static = Corpus(self.spark, self.folder)
        schema = static.table("embeddings").schema
        times = static.events.select(F.col("event_id").alias("vec_id"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ready_at"))
        return read_stream(self.spark, self.folder, "embeddings.parquet", schema).select("vec_id").filter("vec_id % 3 <> 0").join(times, "vec_id").select(
            F.col("vec_id").alias("ready_id"), "ready_at"
        )
