"""Queries over notes that hold each document's whole text: what stands behind its first 400 characters counts, too."""

import pytest

from notewright.plans import registry

LONG = "word " * 3_000
TEXT = LONG + "\n用于：kk、ll、mm、nn、oo。\nTool 7.25 and `FarClass` at https://far.example.org/x \n" + LONG + "\n||z|\n|---|---|"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(8, TEXT, "en"), (16, "short", "en")], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name, column, found", [
    ("long_enumerations", "items", "用于：kk|ll|mm|nn|oo"), ("versions_mentioned", "version", "Tool 7.25"), ("claims_classes", "name", "FarClass"), ("note_urls", "url", "https://far.example.org/x"), ("table_repair", "fixes", 2), ("prose_web", "chars", None),
])
def test_behind_the_prefix(spark, folder, name, column, found):
    got = [r[column] for r in registry.QUERIES[name](spark, folder).where("note_id = 8").collect()]
    assert found in got if found is not None else got[0] > 2 * 4 * 3_000


def test_no_query_reads_a_prefix():
    assert not any("substring(text, 1, 400)" in sql for sql in registry.ORACLE.values())
