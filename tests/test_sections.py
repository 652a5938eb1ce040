"""From files to sections to chapters and back to files."""

import hashlib
import struct
import zipfile

import duckdb
from pyspark.sql import functions as F

from notewright.functions import layout as L
from notewright.functions import text as T
from notewright.operators import checks, courses, notes, sections, structure
from notewright.sources import files, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def para(text, style=None, num=None, sz=None, bold=False):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "")
    run = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{sz}"/>' if sz else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def write_docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def test_docx_to_chapters(spark, tmp_path):
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = para("Title", "Heading 1") + para("One", "Heading 2") + para("text") + para("first", num=(1, 0)) + para("big", sz=34, bold=True) + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('d')}</w:tr></w:tbl>" + f"<w:tbl><w:tr>{cell('val x = 1')}</w:tr></w:tbl>" + para("") + para("x = y", "Code")
    write_docx(tmp_path / "a.docx", body)
    write_docx(tmp_path / "a(1).docx", body)
    (tmp_path / "b.docx").write_bytes(b"not a zip file")
    raw = files.read_docx(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in raw.where("kind = 'error'").collect()] == ["b.docx"]
    rows = raw.where("kind <> 'error'").withColumn("doc_id", F.lit(1).cast("long"))
    listed = sections.resolve_lists(rows, spark.createDataFrame([("1", "n")], "num_id string, abstract_id string"), spark.createDataFrame([("n", "0", "decimal")], "abstract_id string, ilvl string, format string"))
    got = sections.classify(listed).orderBy("pos")
    assert [(r.type, r.level, r.text, r.lang, r.ordered) for r in got.collect()] == [
        ("heading", 1, "Title", None, None), ("heading", 2, "One", None, None), ("paragraph", None, "text", None, None), ("list_item", 0, "first", None, True), ("heading", 2, "big", None, None),
        ("table", None, "| a | b |\n| --- | --- |\n| c | d |", None, None), ("code", None, "val x = 1", "text", None), ("code", None, "x = y", "text", None),
    ]
    chapters = structure.chapters(got.withColumn("pos", F.col("pos").cast("int")))
    assert sorted(r.heading for r in chapters.collect()) == ["One", "big"]
    summary = sections.manifests(got, structure.titles(got), structure.split_levels(got)).first()
    assert (summary.title, summary.chapter_level, summary.total_sections, summary.type_counts["heading"]) == ("Title", 2, 8, 3)
    sinks.write_chapters(chapters.select("doc_id", "chunk", "heading"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_manifest_before_chapters(spark, tmp_path):
    make = lambda rows, name: spark.createDataFrame(rows, "doc_id long, index int, sections array<struct<pos:int,type:string,text:string>>").write.json(str(tmp_path / name))
    make([(1, 0, [(0, "paragraph", "m"), (1, "code", "c")])], "manifest")
    make([(1, 1, [(0, "paragraph", "old")]), (2, 1, [(0, "heading", "h"), (1, "quote", "q"), (2, "paragraph", "")])], "chapters")
    assert sorted(map(tuple, sections.prose(sinks.read_sections(spark, str(tmp_path / "manifest"), str(tmp_path / "chapters"))).collect())) == [(1, "m"), (2, "h\nq")]


def test_texts_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a\nb")], "package string, md string")
    sinks.write_texts(rows, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t/package=p"), wholetext=True).collect()] == ["a\nb\n"]
    assert sinks.report(rows).first().line == '{"package":"p","md":"a\\nb"}'


def test_jpeg(spark):
    head = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 6) + b"abcd" + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 480, 640) + b"\0" * 6
    assert L.jpeg_dimensions(head) == (640, 480) and L.jpeg_dimensions(b"GIF") is None and L.jpeg_dimensions(head[:14]) is None
    got = spark.createDataFrame([(1, head), (2, b"x"), (3, None)], "i int, d binary").select("i", L.jpeg_size(F.col("d")).alias("s")).orderBy("i").collect()
    assert [(r.s.w, r.s.h) for r in got] == [(640, 480), (None, None), (None, None)]


def test_missing_paths_are_rows(spark, tmp_path):
    (tmp_path / "n.md").write_text("x")
    found, errors = files.read_or_errors(spark, [str(tmp_path), str(tmp_path / "gone")], files.read_notes)
    assert found.count() == 1 and [(r.path, r.code) for r in errors.collect()] == [(str(tmp_path / "gone"), "IO")]
    (tmp_path / "A.PNG").write_bytes(b"1")
    (tmp_path / "b.txt").write_bytes(b"2")
    assert [r.path.rsplit("/", 1)[1] for r in files.read_binary(spark, str(tmp_path), (".png",)).collect()] == ["A.PNG"]


def test_technologies(spark):
    rows = spark.createDataFrame([(1, '---\ntitle: "Docker 101"\ncourse: "c"\n---\n'), (2, '---\ntitle: "t"\ncurrent_version: "My Tool 1.2"\n---\n'), (3, "none")], "note_id long, md string")
    assert [r.tech for r in notes.web_tech(rows).orderBy("note_id").collect()] == ["Docker", "", ""]
    assert [r.tech for r in notes.note_claims(rows).orderBy("note_id").collect()][1:] == ["My Tool", ""]
    assert T.WEB_TECH["vue"] == "Vue.js"


def test_untested_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(L.pdf_heading_level(F.lit(0.0), F.lit(False), F.lit("1.2 Part"))) == 3 and get(L.pdf_heading_level(F.lit(23.0), F.lit(True), F.lit("x"))) == 1
    assert get(L.decorative(F.lit("CONTENT"), F.lit(100), F.lit(100), F.lit(10))) and not get(L.decorative(F.lit("COVER"), F.lit(100), F.lit(100), F.lit(10)))
    html = '<img src="a.png"><span data-slate-string="true">x</span><img src="b.png">'
    assert get(L.cover_or_content(F.lit(html), F.lit("a.png"))) == "COVER" and get(L.cover_or_content(F.lit(html), F.lit("b.png"))) == "CONTENT"
    runs = F.from_json(F.lit('[{"text":"a","pt":12.5,"bold":true},{"text":" ","pt":null,"bold":false}]'), "array<struct<text:string,pt:double,bold:boolean>>")
    assert (get(L.run_max_pt(runs)), get(L.run_any_bold(runs)), get(L.run_all_bold(runs))) == (12.5, True, True)
    api = spark.createDataFrame([("A", "valid"), ("B", "changed"), ("D", "valid")], "name string, status string")
    claims = spark.createDataFrame([(1, ["A", "B", "C"])], "note_id long, classes array<string>")
    assert sorted((r.name, r.category) for r in notes.freshness(claims, api).collect()) == [("A", "valid"), ("B", "changed"), ("C", "removed"), ("D", "new")]
    assert [r.verdict for r in spark.createDataFrame([(0,), (2,), (3,)], "k int").select(checks.severity(F.col("k")).alias("verdict")).collect()] == ["pass", "warn", "redo"]
    package = spark.createDataFrame([(1, "T", "c", "d")], "package long, title string, course string, date string")
    none = spark.createDataFrame([], "package long, pos int, name string, abstract string, body string, md string")
    assert courses.course_documents(package, none, none, []).first().md.endswith("> 共 0 份实操文档" + courses.BREAK + courses.TASKS)


def test_slide_decks_keep_digits_of_cells(spark, tmp_path):
    """A cell is the whole second line, whatever digit it begins or ends with."""
    from notewright.plans import more, registry  # noqa: F401  more adds to registry

    rows = [(1, "Title\n11 lines of 1\nrest\n11 lines of 1\nend"), (2, "Title\n\n22 lines of 2\nrest"), (3, " Title\n 1 \nrest 1\n1"), (4, "Title\n1"), (5, ""), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, registry.QUERIES["slide_decks"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.sql(registry.ORACLE["slide_decks"]).fetchall())
    assert [r[2] for r in got[:2]] == [hashlib.md5(x).hexdigest() for x in (b"### Title\n\nrest\nend", b"### Title\n\nrest")]
