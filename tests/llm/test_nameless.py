"""Near copies that have no doc_id."""

from notewright.llm import jaccard_join


def test_texts_without_id_link(spark):
    words = [f"w{i}" for i in range(100)]
    first, last = [f"a{i}" for i in range(9)] + words[9:], words[:91] + [f"z{i}" for i in range(9)]
    lone = [f"q{i}" for i in range(40)]
    rows = [(5, " ".join(first)), (3, " ".join(last)), (None, " ".join(words)), (None, " ".join(words)), (None, " ".join(lone)), (None, " ".join([*lone[:39], "x"])), (9, "far away from all of the others")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.n_links > 0) for r in jaccard_join.jaccard_join(docs).collect()), key=repr)
    # 5 and 3 are partners through the text without an id alone: 78 of 114 shingles in common, 87 of 105 with it.
    assert got == sorted([(5, 3, True), (3, 3, True), (None, 3, True), (None, 3, True), (None, None, True), (None, None, True), (9, 9, False)], key=repr)
    assert sorted(map(repr, (r.doc_id for r in jaccard_join.representatives(docs).collect()))) == sorted(map(repr, [3, 9, None, None, None, None]))
