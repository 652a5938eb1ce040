"""How many rows of whole texts op9_pack's workers are handed at once."""

from notewright.llm import packing


def test_batches_are_small(spark, monkeypatch):
    real, knob = packing._tokenize, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def watched(*args):
        run = real(*args)

        def small(batches):
            for batch in batches:
                if batch.num_rows > 3:
                    raise ValueError(f"{batch.num_rows} rows")
                yield batch

        return lambda batches: run(small(batches))

    docs = spark.createDataFrame([(i, "word " * (i * 100)) for i in range(40)], "doc_id long, text string").coalesce(1)
    columns, before = ("doc_id", "piece", "start", "length", "ids_crc32"), spark.conf.get(knob)
    want = sorted(packing.pack(docs).select(*columns).collect())
    monkeypatch.setattr(packing, "_tokenize", watched)
    monkeypatch.setattr(packing, "BATCH_ROWS", 3, raising=False)
    rows = packing.pack(docs).collect()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == [tuple(r) for r in want]
    for s in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= packing.CAPACITY
    assert spark.conf.get(knob) == before
