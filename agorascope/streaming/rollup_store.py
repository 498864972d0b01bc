"""A store of additive daily counts that is compacted by day behind a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorascope.session import SharedFiles

SCHEMA = T.StructType([T.StructField("bucket_date", T.DateType()), T.StructField("kind", T.StringType()), T.StructField("record_count", T.LongType())])


class RollupStore:
    """Partial counts (bucket_date, kind, record_count), one folder a batch, folded into day folders every ``every`` batches.

    The manifest names what is live: for each day the compaction that last rewrote it, and the batches not folded yet. It
    is a small file of its own, ``manifest-<n>``, written after all it names is complete; the newest complete one counts. A
    compaction rewrites only the days its batches touch. A crash before the manifest leaves the old state; a retried
    batch overwrites its own folder, and one that is folded already is not added again.
    """

    def __init__(self, spark: SparkSession, root: str, every: int = 16):
        self.spark, self.root, self.every = spark, root, every
        self.manifests = SharedFiles(spark, f"{root}/manifests")
        self.state = self._newest()

    def _newest(self) -> dict:
        names = [n for n in self.manifests.names() if n.startswith("manifest-")]
        if not names:
            return {"number": 0, "folded": -1, "days": {}, "batches": []}
        return json.loads(self.manifests.read(max(names)))

    def _commit(self, **changes) -> None:
        state = {**self.state, **changes, "number": self.state["number"] + 1}
        self.manifests.write(f"manifest-{state['number']:012}", json.dumps(state))
        self.state = state

    def add(self, counts: DataFrame, batch_id: int) -> None:
        if batch_id <= self.state["folded"]:
            return
        counts.select(*SCHEMA.names).write.mode("overwrite").parquet(f"{self.root}/batches/{batch_id}")
        self._commit(batches=sorted({*self.state["batches"], batch_id}))
        if len(self.state["batches"]) >= self.every:
            self.compact()

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _day_path(self, day: str) -> str:
        return f"{self.root}/days/{self.state['days'][day]}/bucket_day={day}"

    def compact(self) -> None:
        """Folds the open batches into the days they touch; other days keep their files."""
        batches, number = self.state["batches"], self.state["number"] + 1
        if not batches:
            return
        fresh = self._rows([f"{self.root}/batches/{b}" for b in batches])
        touched = [str(r.bucket_date) for r in fresh.filter("bucket_date IS NOT NULL").select("bucket_date").distinct().collect()]  # days of a few batches
        touched += ["none"] if fresh.filter("bucket_date IS NULL").limit(1).count() else []
        old = self._rows([self._day_path(d) for d in touched if d in self.state["days"]])
        whole = fresh.union(old).groupBy("bucket_date", "kind").agg(F.sum("record_count").alias("record_count"))
        day = F.coalesce(F.col("bucket_date").cast("string"), F.lit("none"))
        whole.withColumn("bucket_day", day).repartition("bucket_day").write.mode("overwrite").partitionBy("bucket_day").parquet(f"{self.root}/days/{number}")
        self._commit(days={**self.state["days"], **dict.fromkeys(touched, number)}, batches=[], folded=max(batches))

    def paths(self) -> list[str]:
        return [*map(self._day_path, self.state["days"]), *(f"{self.root}/batches/{b}" for b in self.state["batches"])]

    def read(self) -> DataFrame:
        rows = self._rows(self.paths())
        return rows.groupBy("bucket_date", "kind").agg(F.sum("record_count").alias("record_count"))
