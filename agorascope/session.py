"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "agorascope", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; extra settings win."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on, on a session somebody else built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``.

    Only when the cluster names none (local tests) is a folder of our own chosen.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        root = os.environ.get("AGORASCOPE_SCRATCH") or tempfile.mkdtemp(prefix="agorascope-")
        spark.conf.set("spark.checkpoint.dir", root)
        return root
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str, *by: str) -> DataFrame:
    """``frame`` written once below the shared folder (partitioned ``by`` columns) and read from there."""
    path = fresh_dir(frame.sparkSession, label)
    writer = frame.write.partitionBy(*by) if by else frame.write
    writer.parquet(path)
    schema = frame.schema if not by else None
    reader = frame.sparkSession.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` with its lineage cut by a checkpoint in the shared folder."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(frame.sparkSession))
    return frame.checkpoint()


class SharedFiles:
    """Small text files of a shared folder, through the file system that Spark itself uses for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._system = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self._system.exists(self._folder):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._folder))

    def read(self, name: str) -> str:
        stream = self._system.open(self._jvm.org.apache.hadoop.fs.Path(self._folder, name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Complete or not there: written under another name first, then renamed."""
        path = self._jvm.org.apache.hadoop.fs.Path
        part, final = path(self._folder, f".{name}"), path(self._folder, name)
        stream = self._system.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._system.delete(final, False)
        if not self._system.rename(part, final):
            raise OSError(f"could not rename {part} to {final}")

