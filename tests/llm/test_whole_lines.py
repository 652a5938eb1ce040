"""Line dedup with short, long and unspaced lines and with words as variable fields, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from notewright.llm import line_dedup

LONG = " ".join(f"word{chr(97 + i)}" for i in range(24))
ROWS = [(i, f"own{chr(97 + i)} text\nAll rights reserved.\nx{chr(97 + i)}") for i in range(6)]
ROWS += [(10, LONG + "\nfirst"), (11, "second\n  " + LONG.replace(" ", "  ", 1)), (12, "日本語のテキストには単語の間に空白がありません。\nα"), (13, "日本語のテキストには単語の間に空白がありません。"), (14, "β\n日本語のテキストには単語の間に空白がありません。")]
ROWS += [(20 + i, f"1{i} 2{i} 3{i} 4{i}\nrow {i} of the table\nrare one\n\n ") for i in range(4)] + [(30, None), (31, ""), (None, "All rights reserved.\nend"), (None, LONG), (10, LONG)]

# One template with a name and a month as fields, a line of its leaf that is something else, and one that differs in too many words.
NAMES, MONTHS = ["Ann", "Bob", "Cem", "Dora"], ["May", "June", "July", "May"]
ROWS += [(40 + i, f"Posted on the blog by {n} in {m} under general news\nkeep{chr(97 + i)}") for i, (n, m) in enumerate(zip(NAMES, MONTHS, strict=True))]
ROWS += [(44, "Posted on the wall were seven rules for all of us"), (45, "Posted on the blog by Eve in some other odd place"), (46, "Posted on the blog by Fay in May\nPosted on the blog by Gil in May"), (None, "Posted on the blog by Hal in March under general news")]
# Ties between tokens of a position, and two documents alone.
ROWS += [(50 + i, f"we all say that {'ab'[i % 2]} follows") for i in range(6)] + [(60, "two of them share this"), (61, "two of them share that")]

ROWS_BY = dict(ROWS)


def brute(rows):
    def key(line):
        y = re.sub("[ \t\x0b\f\r]+", " ", line).strip(" ")
        if not y:
            return None
        tokens = y.split(" ")
        if len(tokens) >= 4 and 2 * sum(bool(re.search("[0-9@]", t)) for t in tokens) <= len(tokens):
            tokens = ["<*>" if re.search("[0-9@]", t) else t for t in tokens]
        return " ".join(tokens)

    seen = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(doc)
    leaves, templates = defaultdict(list), {}
    for k in seen:
        if k is not None and len(tokens := k.split(" ")) >= 5:
            leaves[len(tokens), *tokens[:3]].append(k)
    for (n, *_), ks in leaves.items():
        if len(ks) < 2:
            continue
        votes = [Counter() for _ in range(n)]
        for k in ks:
            for p, t in enumerate(k.split(" ")):
                votes[p][t] += len(seen[k])
        most = [min(((-c, t.encode()) for t, c in v.items() if c >= 3), default=(0, None))[1] for v in votes]
        members = [k for k in ks if sum(t.encode() == m for t, m in zip(k.split(" ")[3:], most[3:], strict=True)) >= max(1, n - 3 - min(5, n // 5))]
        docs = set().union(*(seen[k] for k in members))
        if len(docs) >= 3:
            templates |= dict.fromkeys(members, min(d for d in docs if d is not None))

    def gone(doc, line):
        k = key(line)
        if k is None:
            return False
        if k in templates:
            return doc != templates[k]
        n = len(k.split(" "))
        need = 2 if n >= 20 or len(k) >= 120 else 3 if n >= 4 or len(k) >= 20 else 5
        return len(seen[k]) >= need and doc != min((d for d in seen[k] if d is not None), default=None)

    return [(doc, len(lines := text.split("\n")) if text is not None else 0, sum(gone(doc, x) for x in lines) if text is not None else 0, None if text is None else "\n".join(x for x in lines if not gone(doc, x))) for doc, text in rows]


def test_all_lines_take_part(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(docs)
    rows = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, brute(ROWS)))
    by = {r[0]: r for r in rows}
    assert by[0][2] == 0 and all(by[i][2] == 1 for i in range(1, 6))  # three tokens
    assert by[11][3] == "second" and by[14][3] == "β"  # two documents; no spaces
    assert by[23][3].startswith("13 23 33 43\nrare one")  # numbers alone share no template
    assert [by[i][3] for i in range(40, 46)] == [ROWS_BY[40], "keepb", "keepc", "keepd", ROWS_BY[44], ROWS_BY[45]]  # words as fields
    assert by[46][2] == 0 and by[60][2] == by[61][2] == 0 and sum(by[i][2] for i in range(50, 56)) == 5
    assert "Python" not in got._jdf.queryExecution().toString() and line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", [None, "sf0.001"])
def test_sql(spark, sf, tmp_path):
    path = f"/root/testdata/{sf}"
    if sf is None:
        path = str(tmp_path)
        spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    want = c.sql(line_dedup.OP3_SQL).fetchall()
    assert sorted(map(repr, map(tuple, line_dedup.op3_line_dedup(spark, path).collect()))) == sorted(map(repr, want))
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    assert sorted(map(repr, want)) == sorted(repr((d, n, k, sha(t))) for d, n, k, t in brute([tuple(r) for r in rows]))
