"""How often op3_line_dedup masks a line."""

from notewright.llm import line_dedup


def test_a_pass_masks_each_line_once(spark, monkeypatch):
    plans, keep = {}, line_dedup.Store.keep

    def planned(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(line_dedup.Store, "keep", planned)
    docs = spark.createDataFrame([(i, f"we all say that {'abc'[i % 3]} follows 1{i}") for i in range(9)], "doc_id long, text string")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    try:
        assert {r.n_dropped for r in line_dedup.dedup_lines(docs).where("doc_id > 0").collect()} == {1}
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
    assert [plans[k].count("regexp_replace(") for k in ("lines", "tokens")] == [2, 2]  # spaces and fields
