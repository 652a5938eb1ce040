"""The training-data operators against brute force, on texts that are hard in small ways."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from notewright.llm import byte_cnn, chat_format, decontaminate, jaccard_join, lattice_lm, line_dedup, packing, quality_rules, suffix_dedup, warc_zst, word_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, token long, key long, n_words long, n_dropped long, line long"
RNG = random.Random(11)
WORDS = ["alpha", "Beta", "gamma,", "delta.", "eps", "zeta", "eta9", "théta", "iota", "%%%", "kappa", "x@y", "naïve", "It's", "12", "İx"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") if rng.random() < 0.7 else "") for _ in range(n))


def make_rows():
    base = prose(120)
    words = base.split(" ")
    texts = [
        None, "", " \t\n", "one two", "one two", "One Two", base, base, base.upper(), " ".join([*words[:60], "changed", *words[61:]]), " ".join([*words[:30], "a", "b", *words[32:]]), " ".join(words[:95]), " ".join(words[40:]),
        prose(80) + "\n" + "The common line has seven words here\n" + prose(40), "The common line has seven words here\n" + prose(55), "x\nThe common  line has seven words here \nThe common line has seven words here\n" + prose(30),
        "page 12 of 99 pages\n" + prose(20), "page 13 of 7 pages\n" + prose(20), "page 1 of 2 pages\nblank\n\n", "a" * 700, "ab" * 400, prose(60) + base + prose(60), prose(5) + base[:260] + prose(5), "日本語 テキスト " * 40, "\\", prose(6000),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, base), (None, base), (None, "no id here at all")]
    return [(i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), 1, 2, 3, 4, 5, 6) for i, t in rows]


ROWS = make_rows()
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ws(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_jaccard(docs, none):
    sets = []
    for row in ROWS:
        w = ws((row[1] or "").translate(LOW))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(ROWS)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    want = []
    for i, row in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if find(j) == find(i) and ROWS[j][0] is not None]
        want.append((row[0], len(sets[i]), min(ids) if ids and sets[i] else row[0]))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert jaccard_join.jaccard_join(none).count() == 0
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for d, n, c in want if n and c is not None} | {d for d, n, _ in want if not n and d is not None})


def test_decontaminate(spark, docs, none):
    base = ws(ROWS[6][1])
    items = [(1, " ".join(base[10:40])), (2, "one two"), (10, "!!! one--TWO ?"), (3, None), (4, ""), (None, "no id here at all"), (5, "not there in any text whatever it may be that we say"), (1, " ".join(base[10:40]))]
    split = lambda s: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(LOW)) if w]
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for row in ROWS:
        w, found = split(row[1]), set()
        hit = [False] * len(w)
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        want.append((row[0], len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_contamination(docs, bench).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in rows))) == sorted(map(repr, want))
    texts = {r[0]: r[1] for r in ROWS}
    for r in rows:
        assert sum(len(split(texts[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit or r.doc_id is None
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.find_contamination(docs, bench.limit(0)).collect())


def test_decontaminate_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(ws(ROWS[6][1])[i : i + 12])) for i in range(0, 60, 7)], "item_id long, text string")
    want = sorted(map(repr, (tuple(r) for r in decontaminate.find_contamination(docs, bench).collect())))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 4)
    assert sorted(map(repr, (tuple(r) for r in decontaminate.find_contamination(docs, bench).collect()))) == want


def test_line_dedup(docs, none):
    import duckdb

    got = line_dedup.dedup_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_lines"}
    c = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in ROWS], pa.int64()), "text": pa.array([r[1] for r in ROWS], pa.string())})
    c.register("documents", documents)
    want = c.sql(line_dedup.OP3_SQL).fetchall()
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    assert sorted(map(repr, ((r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in got.collect()))) == sorted(map(repr, want))
    rows = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert rows[13].n_dropped == 0 and rows[14].n_dropped == 1 and rows[15].n_dropped == 2 and rows[17].n_dropped == 1
    assert rows[0].text is None and rows[0].n_lines == 0 and rows[1].n_lines == 1
    assert line_dedup.dedup_lines(none).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString() and "InArrow" not in got._jdf.queryExecution().toString()


def test_lattice_matches_enumeration():
    path = public_tokenizers.path(lattice_lm.VOCABULARY)
    logp = lattice_lm.first_scores(path)
    pieces = dict(zip(lattice_lm._pieces(path)[0], logp, strict=True))

    def total(raw):
        sums = [1.0] + [0.0] * len(raw)
        for j in range(1, len(raw) + 1):
            sums[j] = sum(sums[i] * math.exp(pieces[raw[i:j]]) for i in range(j) if raw[i:j] in pieces)
        return math.log(sums[-1])

    words = [b"the", b"thandtion", "été".encode(), b"a", b"zzq", b"\xff", b"x" * 90]
    lattice = lattice_lm.Lattice(path, logp)
    assert np.allclose(lattice.word_logs(words), [total(b" " + w) for w in words])
    weight = np.array([2.0] * len(words))
    uses = lattice.expected(words, weight)
    names = lattice_lm._pieces(path)[0]
    assert math.isclose(sum(len(n) * u for n, u in zip(names, uses, strict=True)), 2 * sum(len(w) + 1 for w in words), rel_tol=1e-9)


def test_lattice_scores(docs, none):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [[*(w.translate(LOW) for w in ws(r[1])), None] for r in ROWS]
    count = Counter(t for r, ts in zip(ROWS, tokens, strict=True) if not held(r[0]) for t in ts)
    n, kinds = sum(count.values()), len(count)
    want = [(r[0], held(r[0]), len(ts), sum(count[t] > 0 for t in ts), n, round(sum(math.log10((count[t] + 1) / (n + kinds + 1)) for t in ts), 5)) for r, ts in zip(ROWS, tokens, strict=True)]
    for head in (20, 200_000):
        rows = lattice_lm.score_texts(docs, rounds=1, head=head).collect()
        assert sorted(map(repr, ((*tuple(r)[:5], round(r.base_score, 5)) for r in rows))) == sorted(map(repr, want))
        assert all(math.isfinite(r.score) and r.score < 0 and r.lattice_score < 0 for r in rows)
        scores = sorted(round(r.score, 6) for r in rows)
        assert head == 20 or scores == first
        first = scores
    assert lattice_lm.score_texts(none, rounds=1).count() == 0


def test_template():
    t = chat_format.Template("{% for m in messages %}{% if 1 == 1 and m.role != 'x' %}{{ 'a' + 'b' }}{{ m.text | upper }}{% generation %}{{ m.role }}{% endgeneration %}{% endif %}{% endfor %}{{ missing }}")
    assert t.tree[0][3][0][1][0][1][0] == ("text", "ab")
    assert t.render([{"role": "u", "text": "q"}, {"role": "x", "text": "z"}]) == ("abQu", [(3, 4)])
    for bad in ("{% for m in x %}", "{{ a.__class__ }}", "{{ a | eval }}", "{% import os %}", "{{ f('x') }}", "{{ 'a' + }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.Template(bad)


def test_chat_round_trip(spark):
    rng, parts = random.Random(5), ["\\", "[", "/", "INST", "]", "<s>", "</s>", "[INST]", "[/INST]", " ", "[TURN", "[/TURN]", "\n", "a", "é"]
    rows = [(c, i, rng.choice(["user", "assistant", "system", "x]\\", None]), None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for c in [*range(40), None] for i in range(rng.randint(1, 5))]
    rows += [rows[0], (7, 99, "assistant", "z" * 300_000)]
    got = {r.conv_id: r for r in chat_format.format_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert tuple(got[conv])[1:5] == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss))
    assert chat_format.format_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    parts = chat_format.format_conversations(spark.createDataFrame(rows[:5], "conv_id long, turn long, role string, text string")).collect()
    assert len(parts) == 5 and all(p.text for p in parts)


def test_quality(spark, docs, none):
    want = []
    for row in ROWS:
        text, w = row[1] or "", ws(row[1])
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if ws(x)]
        want.append((row[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), len(w) < 50 or 100 * len(twice) > 50 * len(w)))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, None, 0), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert sorted(map(repr, (tuple(r)[:7] for r in rows))) == sorted(map(repr, want))
    assert all(r.kept == (not r.base_failed) for r in rows)  # too few labels for any cutoff
    assert quality_rules.keep_good(docs, labels).count() == sum(r.kept for r in rows)
    assert quality_rules.quality_rules(none, labels).count() == 0


def test_binomial_bound():
    for k, n in ((0, 50), (3, 200), (10, 40)):
        p = quality_rules.upper_bound(k, n, 0.01)
        assert math.isclose(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), 0.01, rel_tol=1e-4)
    good = {"en": 20_000}
    grid = quality_rules.RULES["symbols"][1]
    counts = [max(0, 400 - 40 * i) for i in range(len(grid))]
    cut = quality_rules.choose_cutoffs({("en", "symbols"): counts}, good)["en", "symbols"]
    assert counts[grid.index(cut)] / 20_000 <= quality_rules.ALPHA / len(quality_rules.RULES) and quality_rules.choose_cutoffs({("en", "symbols"): [0] * len(grid)}, {"en": 50}) == {}


def test_warc(spark):
    big, other = "<p>" + "payload " * 40, "<q>" + "é" * 90
    pages = [(1, "http://a/ b\r\n", big), (2, "u", big), (3, None, other), (9, "u", other), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (2, "u", big), (8, "u", "x" * 2_000_000)] + [(100 + i, "u", f"<html>{i} " + "common words " * 50) for i in range(60)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, first int")
    first = {}
    for p, _, h in pages:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        again = h in first and first[h] != p
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    got = warc_zst.archive_pages(df)
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()))) == sorted(map(repr, want))
    assert warc_zst.archive_pages(df.limit(0)).count() == 0
    records = [warc_zst.record(i, "u", b"some payload " * 30, 390, "d", None) for i in range(300)]
    raw = warc_zst.write_archive(records)
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and list(warc_zst.read_archive(raw)) == records


def test_suffix(docs, none):
    raws = [(r[1] or "").encode() for r in ROWS]
    seen = Counter(raw[s : s + 200] for raw in raws for s in range(len(raw) - 199))
    want = []
    for row, raw in zip(ROWS, raws, strict=True):
        cover = bytearray(len(raw))
        for s in range(len(raw) - 199):
            if seen[raw[s : s + 200]] > 1:
                cover[s : s + 200] = b"\1" * 200
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        want.append((row[0], len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.dedup_bytes(docs).drop("kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert suffix_dedup.dedup_bytes(none).count() == 0


def test_suffix_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    text = prose(400)
    batch = pa.RecordBatch.from_arrays([pa.array([text, "y" * 10, text[50:]]), pa.array([1, 2, 3])], names=["text", "key"])
    windows = sum(int(suffix_dedup.entries(data, off)[2].sum()) for _, _, data, off in suffix_dedup._segments(batch))
    assert windows == sum(max(0, len(t.encode()) - 199) for t in (text, text[50:]))


def test_refine():
    rng = np.random.default_rng(2)
    for alphabet, n in ((1, 500), (2, 3000), (3, 2000), (200, 3000)):
        data = np.concatenate([rng.integers(0, alphabet, n).astype(np.uint8)] * 2)
        starts = np.arange(len(data) - 199)
        number = suffix_dedup.refine(data, starts)
        raw = data.tobytes()
        by = {}
        for s, x in zip(starts.tolist(), number.tolist(), strict=True):
            assert by.setdefault(raw[s : s + 200], x) == x
        assert len(set(by.values())) == len(by)


def test_word_bpe():
    path = public_tokenizers.path(packing.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = [r[1] or "" for r in ROWS] + ["it's we'll 12a3 ½ Σας ﬁ a\x00b", "z" * 300, "é" * 60, "'S'T x'"]
    cache = word_bpe.WordCache(word_bpe.WordBpe(path), most=40)
    got = [x.tolist() for i in range(0, len(texts), 4) for x in cache.encode([t.encode() for t in texts[i : i + 4]])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pack(docs, none):
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for row in ROWS:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [0]
        want += [(row[0], k, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    rows = packing.pack(docs, capacity=256).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in rows))) == sorted(map(repr, want))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(none).count() == 0


def _fewest(pieces, capacity):
    best = len(pieces)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= pieces[i]}.values():
            rooms[k] -= pieces[i]
            go(i + 1, rooms)
            rooms[k] += pieces[i]
        rooms.append(capacity - pieces[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    for seed in range(150):
        rng = random.Random(seed)
        pieces = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, left = packing.reduce_instance(Counter(pieces), 20)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(fixed.values()) + (_fewest(rest, 20) if rest else 0) == _fewest(pieces, 20)
        bins = packing.plan_bins(Counter(pieces), 20)
        assert Counter(x for b, m in bins.items() for x in b * m) == Counter(pieces) and all(sum(b) <= 20 for b in bins)


def test_cnn(spark, docs, none):
    net = byte_cnn.ByteCnn()
    rng = np.random.default_rng(1)
    net.p["out"] = rng.normal(0, 1, net.p["out"].shape).astype(np.float32)
    data = rng.integers(0, 256, 90).astype(np.uint8)
    off, y = np.array([0, 40, 40, 45, 90]), np.array([1, 0, 0, 1], np.float32)
    chunk, first = net.chunks(data, off)
    grads = net.gradient(chunk, first, y)

    def loss():
        p = 1 / (1 + np.exp(-(net.features(chunk, first)[2] @ net.p["out"] + net.p["base"][0])))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name in ("filter", "out", "embed", "bias"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-3
        up = loss()
        net.p[name][at] = kept - 1e-3
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / 2e-3 - grads[name][at]) < 0.05 * abs(grads[name][at]) + 1e-3
    long = rng.integers(0, 256, 5 * byte_cnn.SLICE_BYTES // 2).astype(np.uint8)
    assert abs(net._long(long) - (net.features(*net.chunks(long, np.array([0, len(long)])))[2] @ net.p["out"] + net.p["base"][0])[0]) < 1e-2
    rows = byte_cnn.score_quality(docs, net).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert byte_cnn.score_quality(none, net).count() == 0


def test_cnn_learns(spark):
    rows = [(i, prose(40, random.Random(i)) if i % 2 else " ".join(w + "%%%" for w in prose(40, random.Random(i)).split())) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    got = byte_cnn.score_quality(docs, byte_cnn.train(docs, labels)).where("held_out").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 0.95 * len(got) > 0
    assert byte_cnn.train(docs, labels.limit(0)).p["base"].shape == (1,)


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs, names = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.toPandas(), docs.schema) if not out.isEmpty() else out
        assert kept.count() <= docs.count()
        docs, _ = kept, names.append(name)
    clean = {r.doc_id for r in quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in docs.collect()} <= clean
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == {r.doc_id for r in docs.collect()}
    assert names == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate"]
