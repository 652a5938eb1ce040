"""Numbers of links against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from notewright.llm import jaccard_join


def _texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n, most, copies in ((70, 3, 90), (160, 8, 120), (300, 12, 20)):
        base = rng.choices(words, k=n)
        for _ in range(copies):  # near to the base or at the limit, so that some members of a group link and others don't
            own = list(base)
            for _ in range(rng.randint(0, most)):
                own[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(own[rng.choice((0, 0, 0, 5, n // 10)) :]))
    texts += [rng.choice(texts).upper() for _ in range(30)] + [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(20)] + ["", None, "w1 w2", "w1  W2"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def _brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    rows_of = Counter(s for s in sets.values() if s)
    number = {}
    for s in rows_of:
        partners = [t for t in rows_of if t != s and 100 * len(s & t) >= 75 * len(s | t)]
        number[s] = len(partners), sum(rows_of[t] for t in partners) + rows_of[s] - 1
    return {i: number.get(s, (0, 0)) for i, s in sets.items()}


@pytest.mark.parametrize("members", [512, 16])
def test_all_links_count(spark, monkeypatch, members):
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    rows = _texts(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_links, r.n_linked_docs) for r in jaccard_join.jaccard_join(docs).collect()}
    want = _brute(rows)
    assert got == want
    assert len({n for n, _ in want.values()}) > 20 and max(n for n, _ in want.values()) > 32


def test_overlaps():
    rng = np.random.default_rng(2)
    for many in (3, 60):  # tokens of few and of many sets
        a, b = ([np.unique(np.concatenate((rng.integers(0, 40, 20), rng.integers(0, 9000, 300)))).astype(np.uint64) for _ in range(k)] for k in (many, many + 5))
        assert (jaccard_join._overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
        assert (jaccard_join._overlaps(a, a) == [[len(np.intersect1d(x, y)) for y in a] for x in a]).all()
    none = [np.zeros(0, np.uint64)]
    assert jaccard_join._overlaps(none, none).tolist() == [[0]]
