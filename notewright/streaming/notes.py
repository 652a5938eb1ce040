"""The same transforms over a folder that files arrive in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_notes(spark: SparkSession, folder: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each new .md file through `transform` (of note_id, md) to Parquet; ends when all files that are there are done."""
    notes = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("wholetext", "true").text(folder)
    notes = notes.select(F.col("_metadata.file_path").alias("note_id"), F.col("value").alias("md"))
    return transform(notes).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
