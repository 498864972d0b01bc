"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agorascope.session import fresh_dir, shared_dir

#: Bytes that separate words of `[^\x20\x09-\x0D]+`; bytes.split() without arguments cuts at exactly these.
SPACES = "\t\n\x0b\f\r "


#: Rows are worked on, and handed back, in slices of about so many bytes.
SLICE_BYTES = 1 << 22

#: Frames made while it is on remove their shuffle files when their action ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextlib.contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def stable(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the shared checkpoint folder, so that later reads never recompute it.

    What was shuffled for it goes at once: otherwise it lies on the disks until the driver happens to collect its garbage.
    """
    spark = frame.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with _freed(spark):
        return frame.select("*").checkpoint()  # a frame made here, whose only action this is


def landed(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written as Parquet to a new folder of the shared checkpoint folder, and read from there; its shuffles go as in ``stable``."""
    path = fresh_dir(frame.sparkSession, label)
    with _freed(frame.sparkSession):
        frame.select("*").write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Remove the folder of a landed frame that nothing reads any more."""
    spark = frame.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    for folder in {name.rpartition("/")[0] for name in frame.inputFiles()}:
        path = fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def digest(name: str = "text") -> Column:
    """128 bits of a text's SHA-256: the identity of a whole text."""
    return F.substring(F.unhex(F.sha2(text_or_empty(name), 256)), 1, 16)


def with_fields(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def in_batches(
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: ``make`` runs once per task, what it returns once per few MB of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for k in range(0, batch.num_rows, rows):
                yield step(batch.slice(k, rows))

    return run
