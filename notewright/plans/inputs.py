"""Derived inputs that exercise the document operators on the test tables, in both SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NOTES = """SELECT doc_id, concat(
 '---', {NL}, 'title: "Doc ', cast(doc_id AS {STR}), '"', {NL},
 'tags: [', lang, ', ', CASE WHEN doc_id % 3 = 0 THEN 'spark' ELSE 'misc' END, ']', {NL},
 'current_version: "', CASE WHEN doc_id % 4 = 0 THEN 'Spark 4.1' ELSE '' END, '"', {NL}, '---', {NL},
 '# Doc ', cast(doc_id AS {STR}), {NL}, {NL}, text, {NL}, {NL},
 'v', cast(doc_id % 97 AS {STR}), ' uses Engine ', cast(doc_id % 5 AS {STR}), '.', cast(doc_id % 7 AS {STR}), ' and `Widget', cast(doc_id % 11 AS {STR}), '`', {NL},
 '项：aa', cast(doc_id % 13 AS {STR}), '、bb、cc、dd', cast(doc_id % 17 AS {STR}), '、ee。', {NL},
 CASE WHEN doc_id % 6 = 0 THEN '![i](https://img.example.org/' ELSE '[l](https://www.example.org/' END, cast(doc_id % 37 AS {STR}), ') see https://bare.example.org/', cast(doc_id % 5 AS {STR}), '.', {NL},
 CASE doc_id % 8
  WHEN 0 THEN concat({BQ}, 'java', {NL}, 'import a.b.C;', {NL}, 'var x = new Foo', cast(doc_id % 3 AS {STR}), '();', {NL}, 'Bar.create(x).runIt();', {NL}, {BQ}, {NL})
  WHEN 1 THEN concat({BQ}, 'yaml', {NL}, 'a.b', cast(doc_id % 4 AS {STR}), ': 1', {NL}, 'plain: 2', {NL}, {BQ}, {NL})
  WHEN 2 THEN concat({BQ}, 'python', {NL}, 'from pkg.mod import z', {NL}, 'Thing.make().doIt()', {NL}, {BQ}, {NL})
  WHEN 3 THEN concat({BQ}, 'mermaid', {NL}, 'flowchart TD', {NL}, 'A -->|x<br/>y| B', {NL}, 'C["p', {BS}, 'nq"] --> D', {NL}, {BQ}, {NL})
  WHEN 4 THEN concat({BQ}, 'mermaid', {NL}, 'timeline', {NL}, '2000 : a<br />b', {NL}, {BQ}, {NL})
  WHEN 5 THEN concat({BQ}, 'mermaid', {NL}, 'flowhcart TD', {NL}, 'A --> B', {NL}, {BQ}, {NL})
  WHEN 6 THEN concat('> [!WARNING] old', {NL}, '> `OldApi', cast(doc_id % 3 AS {STR}), '` gone', {NL}, {NL}, '<div>', {NL}, 'x', {NL}, '</div>', {NL}, '> q', {NL}, 'bad `= a` end', {NL})
  ELSE concat('**t**', {NL}, '||b|', {NL}, '|---|---|', {NL}, '|1|2|', {NL}, {BQ}, 'mermaid', {NL}, 'graph TD', {NL}) END) AS md
FROM documents"""
_SECTIONS = """SELECT doc_id, cast(pos AS INT) AS pos, text,
 CASE WHEN pos = 0 OR pos % 9 = 3 OR pos % 9 = 6 THEN 'heading' WHEN pos % 5 = 4 THEN 'list_item' WHEN pos % 7 = 5 THEN 'quote' ELSE 'paragraph' END AS type,
 CASE WHEN pos = 0 THEN 1 WHEN pos % 9 = 3 THEN 2 WHEN pos % 9 = 6 THEN 3 WHEN pos % 5 = 4 THEN 0 END AS level
FROM ({LINES}) t"""
_SPARK = {"NL": "chr(10)", "BS": "chr(92)", "BQ": "repeat(chr(96),3)", "STR": "STRING", "LINES": "SELECT doc_id, pos, text FROM (SELECT doc_id, text AS body FROM documents) LATERAL VIEW posexplode(split(body, chr(10))) e AS pos, text"}
_DUCK = _SPARK | {"STR": "VARCHAR", "LINES": "SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents)"}

NOTES_SQL, SECTIONS_SQL = _NOTES.format(**_DUCK), _SECTIONS.format(**_DUCK)
PAIRS_SQL = "SELECT doc_id, text AS source, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 4 <> 0), chr(10)) AS note FROM documents"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query.replace("FROM documents", "FROM {documents}"), documents=_documents(spark, sf_dir))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _NOTES.format(**_SPARK)).withColumnRenamed("doc_id", "note_id")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _SECTIONS.format(**_SPARK))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT doc_id, text AS source, array_join(filter(split(text, chr(10)), (x, i) -> (i + 1) % 4 <> 0), chr(10)) AS note FROM documents")
