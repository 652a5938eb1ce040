"""A corpus pipeline of five of the training-data operators.

Each stage takes all that the one before kept, written as a table in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.decontaminate import drop_contaminated
from notewright.llm.jaccard_join import representatives
from notewright.llm.line_dedup import dedup_lines
from notewright.llm.packing import pack
from notewright.llm.quality_rules import keep_good
from notewright.llm.store import Store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their recurring lines; one that loses all its lines goes. n_chars follows the text."""
    done = dedup_lines(docs).where("not (n_dropped > 0 and trim(regexp_replace(text, '[\\\\t-\\\\r ]+', '')) = '')")
    return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontaminate", decontaminate), ("packing", packing)]

#: The cutoffs of the first stage and the sequences of the last have no SQL form; tests/llm/test_pipeline_model.py compares each stage and run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Store(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store.keep(docs, name)
    return docs
