"""What queries leave behind: JSON of manifests and chapters, one text a file, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chapters(chapters: DataFrame, path: str) -> None:
    """Chapters as JSON lines in a folder for each doc_id; Spark's committer makes the write atomic."""
    chapters.repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").json(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    manifests.write.mode("overwrite").json(path)


def read_sections(spark: SparkSession, manifest_path: str, chapter_path: str) -> DataFrame:
    """(doc_id, pos, type, text): sections of manifests, and of chapters for documents that have no manifest. Both hold `sections`, an array, as JSON lines."""
    kind = "doc_id long, index int, sections array<struct<pos:int,type:string,text:string>>"
    own = spark.read.schema(kind).json(manifest_path)
    rest = spark.read.schema(kind).json(chapter_path).join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    return own.unionByName(rest).select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*")


def write_texts(texts: DataFrame, path: str, key: str = "package", column: str = "md") -> None:
    """One text a file, in a folder of its key's name; nothing is seen before all is written."""
    texts.select(key, F.col(column).alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def report(rows: DataFrame) -> DataFrame:
    """(line): each row as JSON."""
    return rows.select(F.to_json(F.struct("*")).alias("line"))
