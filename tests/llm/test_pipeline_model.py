"""The pipeline against a plain Python version of its five stages, on rows with planted junk, lines, copies and passages."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from notewright.llm import packing, quality_rules
from test_whole_lines import brute

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randint(3, 8))) for _ in range(4000)]
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def prose(n, width=12):
    words = [RNG.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, n, width))


def planted():
    docs = {i: [prose(RNG.randint(60, 140)), "en"] for i in range(300)}
    item = " ".join(RNG.choice(WORDS) for _ in range(30))
    for i in range(0, 300, 10):
        docs[i][0] += "\nThis very line stands in many documents"
    for i in range(1, 300, 40):
        docs[i][0] += "\nAll rights reserved."
    for i in (4, 14):
        docs[i][0] += "\n" + " ".join(WORDS[:30])
    for k, i in enumerate((33, 47, 58)):
        docs[i][0] += "\n" + " ".join(item.split()[5 * k : 5 * k + 12])
    for i in range(300, 315):
        docs[i] = [prose(80) + " $$##" * 60, "en"]
    docs[315], docs[316], docs[317] = ["too short", "en"], [" ".join(WORDS[:6] * 30), "en"], [prose(80) + " $$##" * 60, None]
    docs[318], docs[319] = [None, "en"], ["", "en"]
    docs[7][0] = " ".join(docs[7][0].split())
    docs[320] = [docs[7][0], "en"]  # loses all its lines
    flat = " ".join(docs[8][0].split())
    docs[8][0] = flat
    docs[321] = [" ".join([*flat.split()[:-1], "changed"]), "en"]  # a near copy, whose one line is another
    docs[322] = [flat.upper(), "en"]  # the same words
    labels = [(i, 1) for i in range(300)] + [(i, 0) for i in range(300, 310)]
    return [(i, t, lang) for i, (t, lang) in docs.items()], labels, [(1, item), (2, " ".join(WORDS[100:140])), (3, None)]


def ws(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def stats(text):
    w, text = ws(text), text or ""
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if ws(x)]
    n, chars = len(w), sum(map(len, w))
    bad = n < 50 or 2 * len(twice) > n
    m = max(n, 1)
    return bad, {"symbols": sum(c in "#*$%&|<>" for c in text) / m, "repeats": len(twice) / m, "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "long_words": chars / m, "short_words": n / max(chars, 1), "short_text": 1 / m}


def quality(rows, labels):
    found = {i: stats(t) for i, t, _ in rows}
    good = [found[i][1] for i, q in labels if q == 1 and not found[i][0]]  # one language has labels
    below, blocks = 0.0, -1
    while below <= 0.05:
        blocks += 1
        below += math.comb(len(good), blocks) * 0.02**blocks * 0.98 ** (len(good) - blocks)
    cut = {}
    for r, (rule, (_, grid)) in enumerate(quality_rules.RULES.items()):
        own = sum(b % 6 == r for b in range(blocks))
        cut[rule] = next((c for c in grid if sum(g[rule] > c for g in good) < own), math.inf)
    return [(i, t, lang) for i, t, lang in rows if not found[i][0] and not (lang == "en" and any(found[i][1][r] > c for r, c in cut.items()))]


def lines(rows):
    lang = {i: x for i, _, x in rows}
    return [(i, t, lang[i]) for i, _, k, t in brute([(i, t) for i, t, _ in rows]) if not (k and not ws(t))]


def distinct(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (ws(t.translate(LOW)) for _, t, _ in rows)]
    lead = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if lead[a] != lead[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = lead[a], lead[b]
                lead = [y if z == x else z for z in lead]
    first = defaultdict(list)
    for row, x in zip(rows, lead, strict=True):
        first[x].append(row)
    return [min(g) for g in first.values()]


def clean(rows, items):
    split = lambda s: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(LOW)) if w]
    windows = {tuple(w[k : k + 10]) for w in (split(t) for _, t in items) for k in range(len(w) - 9)}
    return [r for r in rows if not windows & {tuple(w[k : k + 10]) for w in [split(r[1])] for k in range(len(w) - 9)}]


def test_pipeline_model(spark, tmp_path):
    rows, labels, items = planted()
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = [rows]
    for stage in (lambda x: quality(x, labels), lines, distinct, lambda x: clean(x, items)):
        steps.append(stage(steps[-1]))
    gone = [{r[0] for r in a} - {r[0] for r in b} for a, b in zip(steps, steps[1:], strict=False)]
    assert gone == [{*range(300, 317), 318, 319}, {320}, {321, 322}, {33, 47, 58}]  # each stage has its plants
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], steps[1:], strict=True):
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == sorted((i, t, len(t)) for i, t, _ in want), name
    library, want = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), []
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for i, t, _ in steps[-1]:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        want += [(i, k, s, len(ids[s : s + packing.CAPACITY]), zlib.crc32(np.array(ids[s : s + packing.CAPACITY], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), packing.CAPACITY))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= packing.CAPACITY
