"""What op4_lattice_lm's lattices do once for many words."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from notewright.llm import lattice_lm


def test_pieces_are_indexed_once():
    path = public_tokenizers.path(lattice_lm.VOCABULARY)
    logp, pieces = lattice_lm.first_scores(path), lattice_lm._pieces(path)[0]
    a, b = lattice_lm.Lattice(path, logp), lattice_lm.Lattice(path, logp - 1)
    assert a.index is b.index and a.single is b.single
    for i in range(0, len(pieces), 97):
        raw = np.frombuffer(pieces[i], np.uint8)[None, :]
        assert a.edges(raw)[len(pieces[i])][0, 0] == i
    assert (b.word_logs([b"a"]) < a.word_logs([b"a"])).all()


def test_batches_are_joined(monkeypatch):
    schema = pa.schema([("word", pa.binary()), ("by", pa.list_(pa.int64()))])
    batch = lambda lo, n: pa.RecordBatch.from_pydict({"word": [b"%d" % i for i in range(lo, lo + n)], "by": [[i, i] for i in range(lo, lo + n)]}, schema=schema)
    monkeypatch.setattr(lattice_lm, "WORDS", 25)
    got = list(lattice_lm._gather([batch(0, 10), batch(10, 0), batch(10, 10), batch(20, 10), batch(30, 5)]))
    assert [b.num_rows for b in got] == [30, 5]
    assert [w for b in got for w in b["word"].to_pylist()] == [b"%d" % i for i in range(35)]
    assert got[1]["by"].flatten().to_pylist() == [i for i in range(30, 35) for _ in range(2)]
    monkeypatch.setattr(lattice_lm, "SLICE_BYTES", 1)
    assert [b.num_rows for b in lattice_lm._gather([batch(0, 3), batch(3, 4)])] == [3, 4]
    assert list(lattice_lm._gather([])) == list(lattice_lm._gather([batch(0, 0)])) == []
