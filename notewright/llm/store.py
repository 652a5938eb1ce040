"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, one temporary folder per local session. A cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="notewright-"))
    return found.rstrip("/")


class Store:
    """A folder of intermediate Parquet tables of one run of one operator.

    A table survives the loss of executors, and is read again instead of recomputed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/notewright/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def bloom_joins(spark: SparkSession):
    """Within this, Spark puts a Bloom filter of a filtered, smaller side before the shuffle of a join's other side."""
    knobs = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
    before = {k: spark.conf.get(k, None) for k in knobs}
    for k, v in knobs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within this, tables written by mapInArrow hand over `rows` rows at a time, as else a task's whole texts are one batch, held by the JVM and by its worker."""
    knob = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, now = spark.conf.get(knob, None), int(spark.conf.get(knob, "10000"))
    spark.conf.set(knob, str(min(rows, now) if now > 0 else rows))
    try:
        yield
    finally:
        spark.conf.unset(knob) if before is None else spark.conf.set(knob, before)


def lean(run):
    """A function for mapInArrow that gives freed memory back to the machine, as Python workers outlive their tasks."""

    def lean_run(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return lean_run


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of numpy arrays or lists, in the schema's order and types."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
