"""Links of heavily edited copies, shared passages and frequent tokens against brute force."""

import random

import pytest

from notewright.llm import jaccard_join


def _brute(rows):
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    label[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def _corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, passage = [], rng.choices(words, k=40)
    for base in [rng.choices(words, k=n) for n in (60, 90, 150)]:
        rows.append(list(base))
        for _ in range(50):  # some link to the base, some to other copies alone, some to nothing
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 14)):
                own[rng.randrange(len(own))] = rng.choice(words)
            own = own[rng.choice((0, 0, 3, 12)) :] + rng.choices(words, k=rng.choice((0, 0, 2, 8)))
            rows.append(own)
    for _ in range(50):  # hardly anything but a common passage
        rows.append(rng.choices(words, k=rng.randint(0, 14)) + passage + rng.choices(words, k=rng.randint(0, 14)))
    rows += [rng.choices(words, k=rng.randint(1, 8)) for _ in range(30)]
    rng.shuffle(rows)
    return [(i * 7 % 1009, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("often", [16, 3, 1 << 40])
def test_clusters(spark, monkeypatch, often):
    """The result doesn't depend on which tokens are known to be frequent."""
    monkeypatch.setattr(jaccard_join, "MIN_OFTEN", often)
    rows = _corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == _brute(rows)
    sizes = sorted((sum(c == i for _, c in got.values()) for i in got), reverse=True)
    assert sizes[0] > 10 and sizes.count(1) > 30
