"""Small rows with results that follow from the rules by hand."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from notewright.functions import layout as L
from notewright.functions import text as T
from notewright.functions.rx import split_lines
from notewright.operators import lint, notes, structure
from notewright.sources import files, providers


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("row, level", [
    (("Heading 3", 0.0, False, False, "x"), 3), (("Heading", 0.0, False, False, "x"), 1), (("Heading 7", 0.0, False, False, "x"), 4), (("", 26.0, True, True, "x"), 1), (("", 18.0, True, True, "x"), 2), (("", 16.0, True, True, "x"), 3),
    (("", 14.0, True, True, "x"), 4), (("", 14.0, True, True, "x" * 80), 0), (("", 12.0, True, True, "1.1 x"), 0), (("", 0.0, True, False, "1.1 x"), 3), (("", 0.0, True, False, "1.快速"), 0), (("", 0.0, True, True, "abc"), 4), (("", 30.0, False, False, "x"), 0),
])
def test_heading_level(spark, row, level):
    df = spark.createDataFrame([row], "style string, pt double, bold boolean, all_bold boolean, text string")
    assert df.select(L.heading_level(*map(F.col, df.columns))).first()[0] == level


def test_numbering(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ("1. x", "1.1 x", "1.1.1 x", "2、x", "3", "1.快速")], "t string").select(L.numbering_depth(F.col("t"))).collect()]
    assert got == [1, 2, 3, 1, 1, None]


def test_single_cell(spark):
    got = [tuple(one(spark, L.single_cell(F.col("t")), t=t)) for t in ("Java\nint a=1;", "x = 1", "hello world", "# n\nl")]
    assert got == [("code", "java", "int a=1;"), ("code", "text", "x = 1"), ("quote", None, "hello world"), ("code", "text", "# n\nl")]


def test_images(spark):
    assert [one(spark, L.small_inline(F.col("w"), F.col("h")), w=w, h=h) for w, h in ((700, 150), (701, 150), (0, 10))] == [True, False, False]
    assert tuple(one(spark, L.resized(F.col("w"), F.col("h")), w=4000, h=1000)) == (2000, 500)
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (300).to_bytes(4, "big") + (20).to_bytes(4, "big")
    assert tuple(spark.createDataFrame([(bytearray(png),)], "b binary").select(L.png_size(F.col("b")).alias("x")).first().x) == (300, 20)
    assert one(spark, T.code_score(F.col("t")), t="a=(1);") == 4


@pytest.mark.parametrize("status, kind, size, image, ok", [(200, "text/html", 10, True, False), (200, "image/png", 0, True, False), (200, "image/png", -1, True, True), (404, "", 1, False, False), (None, "", 1, False, False)])
def test_probe(spark, status, kind, size, image, ok):
    df = spark.createDataFrame([(status, kind, size, image)], "s int, k string, n int, i boolean")
    assert df.select(L.probe_verdict(*map(F.col, "skni"))).first()[0] is ok


def test_text(spark):
    assert one(spark, T.numbers(F.col("t")), t="a 3.14 b 3 c 3.14 d 10") == ["3.14", "3", "10"]
    assert one(spark, T.long_enumerations(F.col("t")), t="用于：aa、bb、cc、dd、ee。") == [["用于：aa", "bb", "cc", "dd", "ee"]]
    assert one(spark, T.long_enumerations(F.col("t")), t="aa、bb、cc、dd") == []
    assert [one(spark, T.infer_tech(F.col("t")), t=t) for t in ("Archive tips", "pyspark x", "zzz")] == ["Apache Hive", "Apache Spark", ""]
    urls = one(spark, T.urls(F.col("t")), t='see (https://a.b/c) [l](https://j.k "t") ![i](https://g.h/i.png) http://z.y/.')
    assert [tuple(u) for u in urls] == [("https://g.h/i.png", True), ("http://z.y/", False)]
    assert one(spark, T.collapse_blank(F.col("t")), t="a\n\n\n\nb") == "a\n\nb"
    assert one(spark, T.html_text(F.col("t")), t="<b>a</b>&amp;lt;&nbsp;") == "a< "
    assert one(spark, split_lines(F.col("t")), t="a\r\nb\x1cc\n") == ["a", "b", "c"]


def test_long_inputs(spark):
    md = "> [!WARNING] x\n" + "> `OldThing` y\n" * 50_000
    assert one(spark, T.deprecated_names(F.col("t")), t=md) == ["OldThing"]
    assert len(one(spark, T.long_enumerations(F.col("t")), t="、".join(["ab"] * 50_000))[0]) == 50_000


def test_fences(spark):
    lines = ["a", "```java", "~~~", "x", "```", "~~~", "q", "~~~", "```x", "u"]
    assert [tuple(r) for r in one(spark, lint.fence_ranges(F.split(F.col("t"), "\n")), t="\n".join(lines))] == [(1, 4), (5, 7)]


@pytest.mark.parametrize("md, found", [
    ("```mermaid\nflowchart TD\nA -->|x<br/>y| B\n```", {("E1", 3)}), ('```mermaid\nflowchart TD\nA -->|"x<br/>y"| B\n```', set()), ("```mermaid\nflowchart TD", {("E2", 1)}), ("```mermaid\nflowhcart TD\n```", {("E3", 1)}),
    ("`=a`", {("E4", 1)}), ("<code>=a</code>", {("E4", 1)}), ("</div>\n> q", {("E5", 2)}), ("```mermaid\nmindmap\n root((a<br/>b))\n```", {("W1", 3)}), ('```mermaid\nmindmap\n A["p\\nq"]\n```', {("W2", 3)}),
    ("```mermaid\ntimeline\n2000 : a<br />b\n```", {("W4", 3), ("W3", 3)}), ("`=a`\n```\nx\n```", {("E4", 1)}), ("```mermaid\n```", set()), ("", set()),
])
def test_lint(spark, md, found):
    df = spark.createDataFrame([(1, md)], "note_id int, md string")
    assert {(r.code, r.line) for r in lint.lint_issues(df).collect()} == found


def test_repairs(spark):
    fixed = one(spark, lint.repair_tables(F.col("t")), t="**t**\n||b|\n|---|---|")
    assert tuple(fixed) == ("**t**\n\n| |b|\n|---|---|", 2)
    assert one(spark, lint.repair_tables(F.lit(fixed.md)), t="") == (fixed.md, 0)
    assert one(spark, lint.repair_mermaid(F.col("t")), t='A["x"]\nB["y"]') == 'A["x"]\nB["y"]'
    assert one(spark, lint.repair_mermaid(F.col("t")), t='A["x\\ny"]') == 'A["x<br/>y"]'
    joined = one(spark, lint.join_slide_lines(F.array(*map(F.lit, ("- a", "- b", "t1", "t2", "> [!QUOTE]\n> x", "t3")))))
    assert joined == "- a\n- b\n\nt1\nt2\n\n> [!QUOTE]\n> x\n\nt3"
    assert one(spark, L.slide_lines(F.array(*map(F.lit, ("• a", " ", "x ≠ y", "plain"))))) == ["- a", "> [!QUOTE]\n> x ≠ y", "plain"]
    got = one(spark, notes.rewrite_images(F.col("t"), F.create_map(F.lit("i.png"), F.lit("http://u/1"))), t="a ![x](i.png) b ![y](j.png) ![z](http://h/k)")
    assert got == "a ![x](http://u/1) b ![y ⚠️上传失败](j.png) ![z](http://h/k)"
    warned = one(spark, lint.mermaid_warnings(F.col("t")), t="graph TD\nsubgraph G\nA --> B\nend\nG --> C\nstyle Q fill:red")
    assert (warned.unbalanced, warned.subgraph_arrows, warned.unknown_styles, warned.odd_start) == (0, ["G"], ["Q"], False)


SECTIONS = "doc_id int, pos int, type string, level int, text string"


def test_chapters_by_hand(spark):
    rows = [(1, 0, "heading", 1, "T"), (1, 1, "paragraph", None, "p"), (1, 2, "heading", 2, "A"), (1, 3, "paragraph", None, "p"), (1, 4, "heading", 1, "P"), (1, 5, "paragraph", None, "p"), (1, 6, "heading", 2, "B"), (1, 7, "paragraph", None, "p")]
    got = structure.chapters(spark.createDataFrame(rows, SECTIONS)).orderBy("chunk").collect()
    assert [(r.heading, r.parent, r.positions) for r in got] == [("A", None, [0, 1, 2, 3, 5]), ("B", "P", [4, 6, 7])]


@pytest.mark.parametrize("sizes, merged", [([3, 4, 20], [27]), ([80, 5], [80, 5]), ([10, 85], [10, 85]), ([14, 1, 1], [15, 1])])
def test_merge(spark, sizes, merged):
    rows = [(1, i, f"h{i}", None, n, [i]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id int, chunk long, heading string, parent string, section_count long, positions array<int>")
    assert [r.section_count for r in structure.merge_chapters(df).orderBy("index").collect()] == merged


def _model(rows, level):
    """Chunks of one document, section by section."""
    title = next((r[4] for r in rows if r[2] == "heading" and r[3] == 1), "")
    chunks, now, ahead, parent = [], [], [], None
    head = up = None
    started = False
    for r in rows:
        named = r[2] == "heading" and r[4] != title
        if named and r[3] == level:
            if started:
                chunks.append((head, up, now))
                now = []
            now, ahead, head, up, started = now + ahead + [r[1]] if not started else ahead + [r[1]], [], r[4], parent, True
        elif named and r[3] < level:
            parent = r[4]
            if started:
                ahead.append(r[1])
            else:
                now.append(r[1])
        else:
            (now).append(r[1])
    if started:
        chunks.append((head, up, now))
        if ahead:
            first = next(r[4] for r in rows if r[1] == ahead[0])
            chunks.append((first, parent, ahead))
    elif now:
        chunks.append((None, parent, now))
    return [(h, u, sorted(p)) for h, u, p in chunks]


def test_chapters_random(spark):
    rng, rows, want = random.Random(3), [], {}
    for d in range(60):
        own = []
        for i in range(rng.randint(1, 25)):
            level = rng.choice([None, None, 1, 2, 2, 3])
            own.append((d, i, "heading" if level else "paragraph", level, f"{'h' if level else 'p'}{rng.randint(0, 9)}"))
        rows += own
        want[d] = _model(own, 2)
    for d, chunks in want.items():
        assert sorted(p for _, _, x in chunks for p in x) == [r[1] for r in rows if r[0] == d]
    got = {}
    for r in structure.chapters(spark.createDataFrame(rows, SECTIONS)).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.heading, r.parent, r.positions))
    for d in want:
        assert [p for _, _, p in got[d]] == [p for _, _, p in want[d]]
        assert [(h, u) for h, u, _ in got[d] if len(want[d]) > 1] == [(h, u) for h, u, _ in want[d] if len(want[d]) > 1] or want[d][0][0] is None


def test_verify_empty_source(spark):
    r = notes.verify_notes(spark.createDataFrame([(1, "", "x")], "doc_id int, source string, note string")).first()
    assert (r.ratio, r.passed) == (0.0, False)


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/01 a.md").write_text("# A\n")
    (tmp_path / "sub/00 x.md").write_text("# X\n")
    assert files.read_notes(spark, str(tmp_path)).count() == 2
    assert [r.md for r in files.join_notes(files.read_notes(spark, str(tmp_path), numbered=True)).collect()] == ["# A\n"]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "d.docx").write_bytes(buffer.getvalue())
    got = files.read_docx(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.kind, r.style, r.text, r.rows) for r in got] == [("p", "Heading 2", "Head", None), ("tbl", "", "", [["c"]])]
    page = 'MIME-Version: 1.0\nContent-Type: multipart/related; boundary="b"\n\n--b\nContent-Type: text/html\nContent-Location: http://x/\n\n<span data-slate-string="true">a&amp;b</span>\n--b\nContent-Type: image/png\nContent-Transfer-Encoding: base64\nContent-Location: http://x/resource/image/i.png\n\niVBORw0KGgo=\n--b--\n'
    (tmp_path / "p.mhtml").write_text(page)
    rows = files.read_mhtml(spark, str(tmp_path)).orderBy("part").collect()
    assert [r.content_type for r in rows] == ["text/html", "image/png"]
    assert one(spark, T.span_text(F.lit(rows[0].html))) == "a&b"


def test_providers(spark):
    plan = spark.createDataFrame([("http://a/", True), ("http://b/", False)], "url string, is_image boolean")
    got = providers.probe_urls(plan, lambda u: providers.Probe(200 if "a" in u.split("/")[2] else 404, "image/png", -1, "")).orderBy("url").collect()
    assert [r.status for r in got] == [200, 404]
