"""Cutoffs of the quality rules for few labels, and what they promise."""

import math

import numpy as np

from notewright.llm import quality_rules as Q


def test_blocks_are_exact():
    for n, miss in ((307, 0.0125), (488, 0.0125), (1973, 0.0125), (10, 0.05)):
        m = Q.blocks(n, 0.02, miss)
        below = lambda k, n=n: sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k))
        assert below(m) <= miss < below(m + 1)
        assert m == 0 or Q.upper_bound(m - 1, n, miss) <= 0.02 + 1e-6


def test_every_large_enough_language_gets_cutoffs():
    good = {"en": 1973, "fr": 488, "de": 475, "es": 307, "xx": 160}
    clean = {(lang, rule): [0] * len(grid) for lang in good for rule, (_, grid) in Q.RULES.items()}
    cut = Q.choose_cutoffs(clean, good)
    assert {lang for lang, _ in cut} == {"en", "fr", "de", "es"}
    assert all(cut[lang, "symbols"] == Q.RULES["symbols"][1][0] for lang in ("en", "fr", "de", "es"))
    assert len([1 for lang, _ in cut if lang == "en"]) == 6 and not any(lang == "xx" for lang, _ in cut)


def test_joint_rejection_is_bounded():
    rng, n, miss = np.random.default_rng(4), 1973, 0
    grids = {rule: [round(x, 4) for x in np.linspace(0.6, 1, len(grid))] for rule, (_, grid) in Q.RULES.items()}
    for _ in range(400):
        values = {rule: rng.random(n) for rule in Q.RULES}  # independent: the worst case for the joint rate
        rules = {rule: ("", list(np.quantile(values[rule], np.linspace(0.97, 1, len(grids[rule]))))) for rule in Q.RULES}
        kept = Q.RULES
        try:
            Q.RULES = rules
            cut = Q.choose_cutoffs({("en", r): [int((values[r] > c).sum()) for c in g] for r, (_, g) in rules.items()}, {"en": n})
        finally:
            Q.RULES = kept
        miss += 1 - math.prod(c for c in cut.values()) > Q.ALPHA
    assert miss <= 35  # of 400 with a chance of 0.05 each at most


def test_query_rejects_junk(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, 120)) + (" $$##$$ x" * 20 if i >= 300 else ""), "es") for i in range(320)]
    labels = [(i, int(i < 300)) for i in range(310)]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    junk = [got[i] for i in range(300, 320) if not got[i].base_failed]
    assert junk and all(got[i].kept for i in range(300)) and not any(r.kept for r in junk)
