"""Queries of note checks, course packages and sections, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, courses, notes, sections
from . import inputs
from .inputs import NOTES_SQL, PAIRS_SQL, SECTIONS_SQL
from .registry import _JVM, _MD, _PROSE, _joined, _query

_WS = "\\s+"


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- checks of notes
_B = "repeat(chr(96), 3)"
_CHECKED = f"""concat(text, chr(10), chr(10), CASE doc_id % 6
 WHEN 0 THEN concat({_B}, 'mermaid', chr(10), 'mindmap', chr(10), '  root', chr(10), '    a', chr(10), {_B}, chr(10), {_B}, 'mermaid', chr(10), 'graph TD', chr(10), 'A-->B', chr(10), {_B}, chr(10))
 WHEN 1 THEN concat({_B}, 'mermaid', chr(10), 'mindmap', chr(10), 'root', chr(10), '  a', chr(10), {_B}, chr(10))
 WHEN 2 THEN concat({_B}, 'mermaid', chr(10), 'mindmap', chr(10), chr(10), '  r1', chr(10), '    x', chr(10), '  r2', chr(10), {_B}, chr(10))
 WHEN 3 THEN concat('<div style="display:grid">', chr(10), chr(10), 'x', chr(10), '</div>', chr(10), chr(10), '## h', chr(10))
 WHEN 4 THEN concat({_B}, 'mermaid', chr(10), 'graph TD', chr(10), 'A["x', chr(92), 'ny"]', chr(10), 'B["', chr(92), 'n"]', chr(10), {_B}, chr(10), '<div class="c" style="a;display:flex">y</div>')
 ELSE concat('![x](https://e.example.org/a.png)', chr(10), {_B}, 'mindmap', chr(10), {_B}, '<style>') END)"""


@_query("note_checks", f"""WITH n AS (SELECT doc_id AS note_id, {_CHECKED} AS md FROM documents),
 b AS (SELECT note_id, md, regexp_extract_all(md, '```mermaid\\n((?s:.*?))```', 1) AS b, regexp_extract_all(md, '(?s)(<div[^>]*style="[^"]*display:(?:grid|flex)[^"]*"[^>]*>.*?</div>)\\s*(?:<div|\\n##|\\n---|\\z)', 1) AS c FROM n),
 m AS (SELECT *, list_transform(list_filter(list_transform(b, lambda x: list_filter(string_split(x, chr(10)), lambda y: trim(y) <> '')), lambda l: len(l) > 1 AND trim(l[1]) = 'mindmap'), lambda l: list_transform(l[2:], lambda y: length(y) - length(ltrim(y)))) AS i FROM b),
 r AS (SELECT note_id, len(list_filter(flatten(list_transform(b, lambda x: string_split(x, chr(10)))), lambda y: contains(y, chr(92) || 'n')))::INT AS literal_line_ends, len(list_filter(i, lambda x: list_min(x) = 0))::INT AS unindented,
  len(list_filter(i, lambda x: len(list_filter(x, lambda z: z = list_min(x))) > 1))::INT AS many_roots, len(list_filter(c, lambda x: regexp_matches(x, '\\n\\s*\\n')))::INT AS split_cards, (len(b) + len(c))::INT AS n_visual,
  len(list_filter(b, lambda x: starts_with(ltrim(x), 'mindmap')))::INT AS mindmaps, len(regexp_extract_all(md, '```mindmap|!\\[[^\\]]*\\]\\(https?://|<img src="http|<style'))::INT AS outside FROM m),
 f AS (SELECT *, n_visual >= 2 AND mindmaps >= 1 AS enough_visual FROM r), v AS (SELECT *, (literal_line_ends > 0)::INT + (unindented > 0 OR many_roots > 0)::INT + (split_cards > 0)::INT + (NOT enough_visual)::INT + (outside > 0)::INT AS k FROM f)
SELECT * EXCLUDE (k), CASE WHEN k = 0 THEN 'pass' WHEN k <= 2 THEN 'warn' ELSE 'redo' END AS verdict FROM v""")  # fmt: skip
def note_checks(spark, sf_dir):
    return checks.note_checks(_documents(spark, sf_dir).select(F.col("doc_id").alias("note_id"), F.expr(_CHECKED).alias("md")))


@_query("chapter_levels", f"""WITH s AS ({SECTIONS_SQL}), n AS (SELECT doc_id, count(*) FILTER (WHERE type = 'heading' AND level = 1) AS a, count(*) FILTER (WHERE type = 'heading' AND level = 2) AS b FROM s GROUP BY 1) SELECT doc_id, CASE WHEN a > 3 THEN 1 WHEN b >= 3 THEN 2 ELSE 0 END AS chapter_level FROM n""")
def chapter_levels(spark, sf_dir):
    return checks.chapter_levels(inputs.sections(spark, sf_dir))


_COMMENTED = f"WITH s AS (SELECT doc_id, pos, type, level, CASE WHEN doc_id % 2 = 0 AND pos % 9 = 6 THEN concat(text, ' 全部留言') ELSE text END AS text FROM ({SECTIONS_SQL}))"


@_query("cut_comments", f"{_COMMENTED}, e AS (SELECT doc_id, min(pos) AS stop FROM s WHERE type = 'heading' AND text LIKE '%全部留言' GROUP BY 1) SELECT s.doc_id, count(*) AS n, max(pos)::INT AS last_pos FROM s LEFT JOIN e USING (doc_id) WHERE stop IS NULL OR pos < stop GROUP BY 1")
def cut_comments(spark, sf_dir):
    rows = inputs.sections(spark, sf_dir).withColumn("text", F.when((F.col("doc_id") % 2 == 0) & (F.col("pos") % 9 == 6), F.concat("text", F.lit(" 全部留言"))).otherwise(F.col("text")))
    return checks.cut_comments(rows).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


_TITLE = "concat('0', doc_id % 9, CASE doc_id % 3 WHEN 0 THEN '｜' WHEN 1 THEN ' | ' ELSE ' ' END, 'Topic ', doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('- Course ', doc_id % 4, '-Site') ELSE '' END)"


@_query("title_parts", f"""WITH t AS (SELECT doc_id, string_split({_TITLE}, '-') AS p FROM documents), c AS (SELECT doc_id, p, regexp_extract(p[1], '^(.*?)\\s*[｜|]', 1) AS lecture FROM t)
SELECT doc_id, trim(lecture) AS lecture, trim(regexp_replace(p[1], '^.*?[｜|]', '')) AS topic, CASE WHEN len(p) >= 3 THEN trim(p[-2]) ELSE '' END AS course FROM c""")
def title_parts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", checks.title_parts(F.expr(_TITLE)).alias("t")).select("doc_id", "t.*")


_AUTHORED = "concat(html, CASE page_id % 4 WHEN 0 THEN '<div class=\"x articleInfo y\"> <span>Ann</span></div>' WHEN 1 THEN '<i class=\"C_authorName_1\"> Bo </i>' WHEN 2 THEN '你好，我是Cy。' ELSE '' END)"


@_query("page_authors", f"""WITH p AS (SELECT page_id, {_AUTHORED} AS h FROM pages) SELECT page_id, coalesce(nullif(trim(regexp_extract(h, 'class="[^"]*articleInfo[^"]*"[^>]*>\\s*(?:<span[^>]*>)?\\s*([^<]+)', 1)), ''), nullif(trim(regexp_extract(h, 'class="[^"]*authorName[^"]*"[^>]*>\\s*([^<]+)', 1)), ''), nullif(regexp_extract(h, '你好，我是\\s*([^，。,.<\\s]+)', 1), ''), '') AS author FROM p""")
def page_authors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", checks.page_author(F.expr(_AUTHORED)).alias("author"))


_ROUTES = {"spark": "big_data", "redis": "middleware", "java": "languages"}
_TOPIC = "CASE doc_id % 5 WHEN 0 THEN 'Apache Spark' WHEN 1 THEN 'Redis' WHEN 2 THEN 'JavaScript' ELSE source END"


@_query("topic_folders", f"SELECT doc_id, CASE {' '.join(f"WHEN contains(lower({_TOPIC}), '{k}') THEN '{v}'" for k, v in _ROUTES.items())} ELSE 'ask' END AS folder FROM documents")
def topic_folders(spark, sf_dir):
    return checks.route_topics(_documents(spark, sf_dir).select("doc_id", F.expr(_TOPIC).alias("topic")), _ROUTES, "ask").select("doc_id", "folder")


@_query("conceptual_notes", f"""{_JVM}, x AS (SELECT note_id FROM b WHERE l IN ('yaml', 'yml', 'properties', 'ini', 'conf', 'toml') AND regexp_matches(c, '(?m)^[a-z][a-z0-9_.\\-]*[._][a-z0-9_.\\-]*\\s*[:=]')
 UNION SELECT note_id FROM n WHERE regexp_matches(md, '`[A-Z][A-Za-z0-9_]+(?:\\.[A-Za-z][A-Za-z0-9_]+)?`')) SELECT note_id, note_id NOT IN (SELECT note_id FROM x) AS conceptual FROM n""")
def conceptual_notes(spark, sf_dir):
    return checks.is_conceptual(notes.note_claims(inputs.notes(spark, sf_dir)))


@_query("review_kinds", "SELECT doc_id, CASE WHEN date_add(DATE '2024-01-15', ((doc_id % 400) * INTERVAL 1 DAY)) >= DATE '2024-08-01' THEN 'quick' ELSE 'full' END AS kind FROM documents")
def review_kinds(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", checks.review_kind(F.expr("date_add(DATE '2024-01-15', cast(doc_id % 400 as int))"), F.expr("DATE '2025-02-01'")).alias("kind"))


_IMAGES = "SELECT doc_id % 50 AS doc_id, doc_id AS pos, md5(text) AS key FROM documents"


@_query("image_batches", f"WITH i AS ({_IMAGES}) SELECT doc_id, pos, ((row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 4)::INT AS batch FROM i")
def image_batches(spark, sf_dir):
    return checks.image_batches(spark.sql(_IMAGES.replace("FROM documents", "FROM {d}"), d=_documents(spark, sf_dir))).select("doc_id", "pos", "batch")


@_query("image_repeats", f"WITH i AS ({_IMAGES}) SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) > 1 AS duplicate FROM i")
def image_repeats(spark, sf_dir):
    return sections.mark_repeated_images(spark.sql(_IMAGES.replace("FROM documents", "FROM {d}"), d=_documents(spark, sf_dir))).select("doc_id", "pos", "duplicate")


@_query("missing_headings", f"""WITH s AS ({SECTIONS_SQL}), h AS (SELECT doc_id, pos, text AS heading FROM s WHERE type = 'heading') SELECT a.doc_id, a.heading FROM h a
WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = a.doc_id AND b.pos % 2 = 0 AND lower(regexp_replace(b.heading, '{_WS}', '', 'g')) = lower(regexp_replace(a.heading, '{_WS}', '', 'g')))""")
def missing_headings(spark, sf_dir):
    rows = inputs.sections(spark, sf_dir).where("type = 'heading'").select("doc_id", "pos", F.col("text").alias("heading"))
    return checks.missing_headings(rows.drop("pos"), rows.where("pos % 2 = 0").select("doc_id", F.concat(F.lit(" "), "heading").alias("heading")))


@_query("note_headings", f"{_MD}, l AS (SELECT note_id, unnest(string_split(md, chr(10))) AS x FROM n) SELECT note_id, count(*) AS n, string_agg(trim(regexp_extract(x, '^#+\\s+(.*)', 1)), '|' ORDER BY trim(regexp_extract(x, '^#+\\s+(.*)', 1))) AS found FROM l WHERE regexp_matches(x, '^#{{1,6}}\\s+') GROUP BY 1")
def note_headings(spark, sf_dir):
    return checks.headings(inputs.notes(spark, sf_dir)).groupBy("note_id").agg(F.count("*").alias("n"), _joined(F.array_sort(F.collect_list("heading"))).alias("found"))


@_query("gathered_urls", f"""{_MD} SELECT note_id, concat(regexp_extract(md, '!?\\[[^\\]]*\\]\\((https?://[^) \\t\\n]+)\\)', 1), '|', rtrim(regexp_extract(md, '[^(](https?://[^\\s)"''<>]+)', 1), '.,;)')) AS urls FROM n""")
def gathered_urls(spark, sf_dir):
    return checks.gather(notes.note_urls(inputs.notes(spark, sf_dir)).select("note_id", "place", "url")).select("note_id", _joined(F.transform("results", lambda r: r["url"])).alias("urls"))


# --- course packages
_FOLDER = "CASE doc_id % 7 WHEN 0 THEN 'md' WHEN 1 THEN 'md版' WHEN 2 THEN 'md版本' WHEN 3 THEN 'MD_old' ELSE concat('dir', doc_id % 3) END"


@_query("md_folders", f"""WITH f AS (SELECT doc_id % 40 AS package, {_FOLDER} AS folder FROM documents WHERE doc_id % 7 <> doc_id % 5)
SELECT package, arg_min(folder, CASE folder WHEN 'md版本' THEN '0' WHEN 'md版' THEN '1' WHEN 'md' THEN '2' ELSE concat('3', folder) END) AS folder FROM f WHERE starts_with(lower(folder), 'md') GROUP BY 1""")
def md_folders(spark, sf_dir):
    return courses.md_folders(_documents(spark, sf_dir).where("doc_id % 7 <> doc_id % 5").select((F.col("doc_id") % 40).alias("package"), F.expr(_FOLDER).alias("folder")))


@_query("next_numbers", "WITH f AS (SELECT doc_id % 40 AS package, CASE WHEN doc_id % 3 = 0 THEN concat('x', doc_id) ELSE concat(doc_id, '_', source) END AS folder FROM documents) SELECT package, coalesce(max(nullif(regexp_extract(folder, '^(\\d+)_', 1), '')::BIGINT), 0) + 1 AS number FROM f GROUP BY 1")
def next_numbers(spark, sf_dir):
    folder = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.concat("doc_id", F.lit("_"), "source"))
    return courses.next_number(_documents(spark, sf_dir).select((F.col("doc_id") % 40).alias("package"), folder.alias("folder")))


@_query("sequence_names", f"WITH i AS ({_IMAGES}), r AS (SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::VARCHAR AS k FROM i) SELECT doc_id, pos, concat('image', CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END) AS name FROM r")
def sequence_names(spark, sf_dir):
    return courses.sequence_names(spark.sql(_IMAGES.replace("FROM documents", "FROM {d}"), d=_documents(spark, sf_dir)), "doc_id", "pos").select("doc_id", "pos", "name")


_PART = "CASE doc_id % 2 WHEN 0 THEN concat('# Task', chr(10), text) ELSE text END"


@_query("course_documents", f"""WITH r AS (SELECT doc_id % 20 AS package, doc_id AS pos, concat('n', doc_id) AS name, {_PART} AS x FROM documents),
 a AS (SELECT package, string_agg(concat('## ', name, chr(10), chr(10), regexp_replace(regexp_replace(regexp_replace(x, '(?m)^# (.+)$', '## \\1', 'g'), '^\\s+', ''), '\\s+\\z', '')), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY pos) AS body, count(*) AS t, package % 2 AS d FROM r GROUP BY package)
SELECT package, md5(concat('---', chr(10), 'title: "P', package, '"', chr(10), 'course: "c"', chr(10), 'tags:', chr(10), '  - a', chr(10), 'date: 2025-01-01', chr(10), '---', chr(10), chr(10), '# P', package, chr(10), chr(10),
 CASE WHEN d > 0 THEN concat('> cover', chr(10), chr(10)) ELSE '' END, '> 共 ', t, ' 份实操文档', CASE WHEN d > 0 THEN '，1 份课件' ELSE '' END, chr(10), chr(10), '---', chr(10), chr(10),
 CASE WHEN d > 0 THEN concat('## deck', chr(10), chr(10), 'slides', chr(10), chr(10), '---', chr(10), chr(10)) ELSE '' END, '{courses.TASKS.replace(chr(10), "' || chr(10) || '")}', chr(10), chr(10), '---', chr(10), chr(10), body)) AS md FROM a""")  # fmt: skip
def course_documents(spark, sf_dir):
    rows = _documents(spark, sf_dir).select((F.col("doc_id") % 20).alias("package"), F.col("doc_id").alias("pos"), F.concat(F.lit("n"), "doc_id").alias("name"), F.expr(_PART).alias("md"))
    packages = rows.select("package").distinct().select("package", F.concat(F.lit("P"), "package").alias("title"), F.lit("c").alias("course"), F.lit("2025-01-01").alias("date"))
    # Odd packages have a deck; all texts are task notes.
    decks = packages.where("package % 2 = 1").select("package", F.lit(0).alias("pos"), F.lit("deck").alias("name"), F.lit("> cover\n").alias("abstract"), F.lit(" slides").alias("body"))
    return courses.course_documents(packages, decks, rows, ["a"]).withColumn("md", F.md5("md"))


@_query("slide_decks", """WITH l AS (SELECT doc_id AS deck, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT deck, concat('> [!ABSTRACT] 课件摘要', chr(10), '> **Deck ', deck, '**', chr(10)) AS abstract, CASE WHEN len(l) > 2 THEN md5(concat('### ', l[1], CASE WHEN len(list_filter(l[2:], lambda x: x <> l[2])) > 0 THEN concat(chr(10), chr(10), array_to_string(list_filter(l[2:], lambda x: x <> l[2]), chr(10))) ELSE '' END)) ELSE md5('') END AS body FROM l""")
def slide_decks(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")  # F.trim itself would take the index as what to trim
    cover = docs.select(F.col("doc_id").alias("deck"), F.lit(0).alias("page"), F.concat(F.lit("Deck "), "doc_id").alias("text"), F.array().cast("array<string>").alias("cells"))
    pages = docs.select(F.col("doc_id").alias("deck"), F.lit(1).alias("page"), "text", F.array(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).alias("cells"))
    return courses.slide_decks(cover.unionByName(pages)).withColumn("body", F.md5("body"))


_STARTS = "|".join(s for s in ("graph ", "flowchart ", "sequenceDiagram", "classDiagram", "stateDiagram", "erDiagram", "gantt", "pie", "mindmap", "gitGraph", "timeline", "xychart"))


@_query("mermaid_rewrite", f"""{_MD}, b AS (SELECT note_id, md, regexp_extract_all(md, '```mermaid\\n((?s:.*?))```', 1) AS b FROM n)
SELECT note_id, md5(regexp_replace(md, '("[^"\\n]*)\\\\n([^"\\n]*")', '\\1<br/>\\2', 'g')) AS fixed_md, len(b)::INT AS blocks, len(list_filter(b, lambda x: regexp_matches(x, '"[^"\\n]*\\\\n[^"\\n]*"')))::INT AS fixed, len(list_filter(b, lambda x: NOT regexp_matches(x, '^\\s*({_STARTS})')))::INT AS warnings FROM b""")
def mermaid_rewrite(spark, sf_dir):
    return inputs.notes(spark, sf_dir).select("note_id", courses.rewrite_diagrams(F.col("md")).alias("r")).select("note_id", F.md5("r.md").alias("fixed_md"), "r.blocks", "r.fixed", "r.warnings")


# --- sections
_NUMBERS, _LEVELS = [("1", "a"), ("2", "b"), ("3", "missing")], [("a", "0", "decimal"), ("a", "1", "bullet"), ("b", "0", "none"), ("b", "2", "lowerLetter")]
_LISTED = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('', doc_id % 5) END AS num_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE concat('', doc_id % 3) END AS ilvl FROM documents"


@_query("list_formats", f"""WITH p AS ({_LISTED}), nu(num_id, a) AS (VALUES {', '.join(map(str, _NUMBERS))}), le(a, l, f) AS (VALUES {', '.join(map(str, _LEVELS))}),
 q AS (SELECT *, CASE WHEN num_id IS NOT NULL THEN coalesce(try_cast(ilvl AS INT), 0) END AS list_level FROM p), r AS (SELECT doc_id, list_level, CASE WHEN q.num_id IS NOT NULL THEN coalesce(f, 'bullet') END AS format FROM q LEFT JOIN nu USING (num_id) LEFT JOIN le ON le.a = nu.a AND le.l = q.list_level::VARCHAR)
SELECT doc_id, list_level, format, format NOT IN ('bullet', 'none') AS ordered FROM r""")
def list_formats(spark, sf_dir):
    rows = spark.sql(_LISTED.replace("FROM documents", "FROM {d}"), d=_documents(spark, sf_dir))
    return sections.resolve_lists(rows, spark.createDataFrame(_NUMBERS, "num_id string, abstract_id string"), spark.createDataFrame(_LEVELS, "abstract_id string, ilvl string, format string")).select("doc_id", "list_level", "format", "ordered")


_ELEMENTS = """SELECT doc_id, cast(doc_id AS INT) AS pos, CASE doc_id % 9 WHEN 0 THEN 'Heading 2' WHEN 1 THEN 'Code' WHEN 2 THEN 'Heading' ELSE 'Normal' END AS style,
 CASE doc_id % 4 WHEN 0 THEN '1.2 Part' WHEN 1 THEN 'Plain text' WHEN 2 THEN '' ELSE source END AS text, CASE doc_id % 11 WHEN 0 THEN 22.0 WHEN 1 THEN 17.5 WHEN 2 THEN 15.5 WHEN 3 THEN 13.0 WHEN 4 THEN 10.0 ELSE 0.0 END AS max_pt,
 doc_id % 2 = 0 AS bold, doc_id % 6 = 0 AS all_bold, doc_id % 13 = 0 AS listed, doc_id % 17 = 0 AS pictured FROM documents"""


@_query("element_types", f"""WITH e AS ({_ELEMENTS}), h AS (SELECT *, CASE WHEN style = 'Heading 2' THEN 2 WHEN style = 'Heading' THEN 1 WHEN max_pt > 0 THEN CASE WHEN NOT bold THEN 0 WHEN max_pt >= 22 THEN 1 WHEN max_pt >= 17 THEN 2 WHEN max_pt >= 15.5 THEN 3 WHEN max_pt >= 13 AND length(text) < 80 THEN 4 ELSE 0 END
  WHEN bold AND text = '1.2 Part' THEN 3 WHEN all_bold AND length(text) < 60 THEN 4 ELSE 0 END AS h FROM e),
 t AS (SELECT *, CASE WHEN pictured THEN 'image' WHEN text = '' THEN NULL WHEN h > 0 THEN 'heading' WHEN listed THEN 'list_item' WHEN style = 'Code' THEN 'code' ELSE 'paragraph' END AS type FROM h)
SELECT doc_id, type, CASE type WHEN 'heading' THEN h WHEN 'list_item' THEN 1 END::INT AS level, text, CASE WHEN type = 'code' THEN 'text' END AS lang, CASE WHEN type = 'list_item' THEN true END AS ordered FROM t WHERE type IS NOT NULL""")
def element_types(spark, sf_dir):
    rows = spark.sql(_ELEMENTS.replace("FROM documents", "FROM {d}"), d=_documents(spark, sf_dir))
    rows = rows.select(
        "doc_id", "pos", F.lit("p").alias("kind"), "style", "text", F.col("max_pt").cast("double").alias("max_pt"), "bold", "all_bold", F.array(F.lit("Arial")).alias("fonts"), F.when(F.col("listed"), F.lit(True)).alias("ordered"),
        F.lit(1).alias("list_level"), F.lit(None).cast("array<array<string>>").alias("rows"), F.when(F.col("pictured"), F.array(F.lit("i.png"))).otherwise(F.array().cast("array<string>")).alias("images"),
    )
    return sections.classify(rows).drop("pos")


@_query("section_prose", f"WITH s AS ({SECTIONS_SQL}) SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY pos)) AS source FROM s WHERE type IN ('paragraph', 'heading', 'list_item', 'quote') AND text <> '' GROUP BY 1")
def section_prose(spark, sf_dir):
    return sections.prose(inputs.sections(spark, sf_dir)).withColumn("source", F.md5("source"))


@_query("raw_span_chars", "WITH s AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS x FROM pages) SELECT page_id, coalesce(length(array_to_string(list_transform(x, lambda y: replace(replace(replace(replace(replace(regexp_replace(y, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')), '')), 0)::INT AS chars FROM s")
def raw_span_chars(spark, sf_dir):
    html = F.regexp_replace("html", "(?s)<p>(.*?)</p>", '<span data-slate-string="true">$1</span>')
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", sections.raw_span_chars(html).alias("chars"))


@_query("verify_notes_full", f"""WITH p AS ({PAIRS_SQL}), c AS (SELECT doc_id, note AS md, source, length(regexp_replace(source, '{_WS}', '', 'g')) AS a, list_distinct(regexp_extract_all(source, '\\d+(?:\\.\\d+)?')) AS nums FROM p), d AS (SELECT *, length(regexp_replace({_PROSE['document']}, '{_WS}', '', 'g')) AS b FROM c)
SELECT doc_id, b::INT AS note_chars, round(CASE WHEN a > 0 THEN b / a ELSE 0 END, 6) AS ratio, CASE WHEN a > 0 THEN b / a ELSE 0 END >= 0.8 AS passed, array_to_string(list_sort(list_filter(nums, lambda x: NOT contains(md, x))), '|') AS missing, len(list_filter(regexp_extract_all(source, '[^，。；！？、\\n]+(?:、[^，。；！？、\\n]+)+'), lambda x: false))::INT AS dropped FROM d""")
def verify_notes_full(spark, sf_dir):
    rows = notes.verify_notes(inputs.pairs(spark, sf_dir))
    return rows.select("doc_id", "note_chars", F.round("ratio", 6).alias("ratio"), "passed", _joined(F.array_sort("missing_numbers")).alias("missing"), F.size("dropped_enumerations").alias("dropped"))


@_query("code_like", "SELECT doc_id, length(text) - length(translate(text, '{};()=<>.:/\"''#', '')) >= 6 AS code_like FROM documents")
def code_like(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", (T.code_score(F.col("text")) >= 6).alias("code_like"))
