"""The queries of the document operators, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as T
from ..functions.rx import find_all, split_lines
from ..operators import lint, notes, structure
from . import inputs
from .inputs import NOTES_SQL, PAIRS_SQL, SECTIONS_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_TITLED = f"WITH s AS ({SECTIONS_SQL}), t AS (SELECT s.*, coalesce(min_by(text, pos) FILTER (WHERE type = 'heading' AND level = 1) OVER (PARTITION BY doc_id), '') AS title FROM s)"
_MD = f"WITH n AS (SELECT doc_id AS note_id, md FROM ({NOTES_SQL}))"


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _joined(c, by="|"):
    return F.array_join(c, by)


# --- web pages
_ELEMENT = "<(h1|p|li)>([^<]+)"


@_query("page_section_histogram", f"""WITH e AS (SELECT page_id, regexp_extract_all(html, '{_ELEMENT}', 1) AS k, regexp_extract_all(html, '{_ELEMENT}', 2) AS x FROM pages),
 r AS (SELECT page_id, unnest(k) AS k, unnest(x) AS x FROM e)
SELECT page_id, CASE k WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' ELSE 'list_item' END AS type, count(*) AS n,
 sum(length(regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\\s+', '', 'g')))::BIGINT AS chars FROM r GROUP BY page_id, k""")  # fmt: skip
def page_section_histogram(spark, sf_dir):
    found = F.arrays_zip(find_all(F.col("html"), _ELEMENT, 1).alias("k"), find_all(F.col("html"), _ELEMENT, 2).alias("x"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(found).alias("e"))
    kind = F.when(F.col("e.k") == "h1", "heading").when(F.col("e.k") == "p", "paragraph").otherwise("list_item")
    return rows.groupBy("page_id", kind.alias("type")).agg(F.count("*").alias("n"), F.sum(T.count_chars(T.html_text(F.col("e.x")))).alias("chars"))


# --- structure
@_query("type_histogram", f"WITH s AS ({SECTIONS_SQL}) SELECT doc_id, type, count(*) AS n FROM s GROUP BY 1, 2")
def type_histogram(spark, sf_dir):
    return structure.type_histogram(inputs.sections(spark, sf_dir))


@_query("document_titles", f"{_TITLED} SELECT DISTINCT doc_id, title FROM t")
def document_titles(spark, sf_dir):
    return structure.titles(inputs.sections(spark, sf_dir))


@_query("split_levels", f"""{_TITLED}, h AS (SELECT doc_id, count(*) FILTER (WHERE level = 2) AS a, count(*) FILTER (WHERE level = 1) AS b, count(*) FILTER (WHERE level = 3) AS c FROM t WHERE type = 'heading' AND text <> title GROUP BY 1)
SELECT d.doc_id, CASE WHEN a >= 2 THEN 2 WHEN b >= 2 THEN 1 WHEN c >= 2 THEN 3 ELSE 2 END AS split_level FROM (SELECT DISTINCT doc_id FROM s) d LEFT JOIN h USING (doc_id)""")
def split_levels(spark, sf_dir):
    return structure.split_levels(inputs.sections(spark, sf_dir))


@_query("chapter_labels", f"""{_TITLED} SELECT doc_id, pos, coalesce(last_value(CASE WHEN type = 'heading' AND level = 2 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), title) AS chapter FROM t""")
def chapter_labels(spark, sf_dir):
    return structure.label_chapters(inputs.sections(spark, sf_dir)).select("doc_id", "pos", "chapter")


_CHUNKS = f"""{_TITLED}, a AS (SELECT *, coalesce(type = 'heading' AND text <> title AND level = 2, false) AS s, coalesce(type = 'heading' AND text <> title AND level < 2, false) AS p FROM t),
 b AS (SELECT *, sum(s::INT) OVER w AS k, last_value(CASE WHEN p THEN text END IGNORE NULLS) OVER w AS up FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT *, CASE WHEN s THEN k WHEN p THEN k + 1 ELSE greatest(k, 1) END::BIGINT AS chunk FROM b),
 g AS (SELECT doc_id, chunk, bool_or(s) AS has, min_by(text, pos) FILTER (WHERE s) AS h1, arg_min_null(up, pos) FILTER (WHERE s) AS p1, min_by(text, pos) FILTER (WHERE type = 'heading') AS h2, arg_max_null(up, pos) AS p2, min(title) AS title,
   count(*) AS section_count, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM c GROUP BY doc_id, chunk),
 ch AS (SELECT doc_id, chunk, CASE WHEN has THEN h1 ELSE coalesce(h2, p2, title) END AS heading, CASE WHEN has THEN p1 ELSE p2 END AS parent, section_count, positions FROM g)"""


@_query("chapter_split", f"{_CHUNKS} SELECT * FROM ch")
def chapter_split(spark, sf_dir):
    return structure.chapters(inputs.sections(spark, sf_dir)).withColumn("positions", _joined("positions", ","))


@_query("chapter_merge", f"""{_CHUNKS.replace('WITH s', 'WITH RECURSIVE s')}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS r FROM ch),
 m AS (SELECT doc_id, r, 1 AS idx, heading, parent, heading AS headings, section_count AS n FROM o WHERE r = 1
  UNION ALL SELECT o.doc_id, o.r, CASE WHEN j THEN idx ELSE idx + 1 END, CASE WHEN j THEN m.heading ELSE o.heading END, CASE WHEN j THEN m.parent ELSE o.parent END, CASE WHEN j THEN m.headings || '|' || o.heading ELSE o.heading END, CASE WHEN j THEN m.n + o.section_count ELSE o.section_count END
  FROM (SELECT m.*, o.r AS r2, (m.parent IS NOT DISTINCT FROM o.parent AND m.n < 15 AND m.n + o.section_count <= 90) AS j FROM m JOIN o ON m.doc_id = o.doc_id AND o.r = m.r + 1) m JOIN o ON m.doc_id = o.doc_id AND o.r = m.r2)
SELECT doc_id, idx AS index, last(heading ORDER BY r) AS heading, last(parent ORDER BY r) AS parent, last(headings ORDER BY r) AS headings, last(n ORDER BY r)::BIGINT AS section_count FROM m GROUP BY doc_id, idx""")
def chapter_merge(spark, sf_dir):
    return structure.merge_chapters(structure.chapters(inputs.sections(spark, sf_dir))).select("doc_id", "index", "heading", "parent", _joined("headings").alias("headings"), "section_count")


@_query("max_chunk_size", f"""{_TITLED}, b AS (SELECT *, sum(coalesce(type = 'heading' AND text <> title AND level = 2, false)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM t),
 c AS (SELECT doc_id, k, count(*) AS n FROM b GROUP BY 1, 2) SELECT doc_id, coalesce(max(n) FILTER (WHERE k > 0), sum(n))::BIGINT AS max_size FROM c GROUP BY 1""")
def max_chunk_size(spark, sf_dir):
    return structure.max_chunk_size(inputs.sections(spark, sf_dir))


_KEYED = f"WITH s AS (SELECT doc_id, pos, type, level, CASE WHEN doc_id % 3 = 0 AND pos % 2 = 1 THEN concat(text, ' 流程步骤') WHEN doc_id % 3 = 1 AND pos % 3 = 1 THEN concat(text, ' 架构组件') ELSE text END AS text FROM ({SECTIONS_SQL}))"


@_query("diagram_suggestions", f"""{_KEYED}, t AS (SELECT s.*, coalesce(min_by(text, pos) FILTER (WHERE type = 'heading' AND level = 1) OVER (PARTITION BY doc_id), '') AS title FROM s),
 c AS (SELECT *, coalesce(last_value(CASE WHEN type = 'heading' AND level = 2 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), title) AS chapter FROM t),
 r AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN {i}" for i, (_, p, _) in enumerate(structure.RULES))} END AS rule FROM c WHERE type IN ('paragraph', 'heading', 'list_item') AND length(text) >= 12)
SELECT doc_id, chapter, min(pos) AS section_index, CASE rule {' '.join(f"WHEN {i} THEN '{d}'" for i, (_, _, d) in enumerate(structure.RULES))} END AS diagram_type, CASE rule {' '.join(f"WHEN {i} THEN '{n}'" for i, (n, _, _) in enumerate(structure.RULES))} END AS trigger, substring(min_by(text, pos), 1, 80) AS context, count(*) AS match_count
FROM r WHERE rule IS NOT NULL GROUP BY doc_id, chapter, rule""")  # fmt: skip
def diagram_suggestions(spark, sf_dir):
    more = F.when((F.col("doc_id") % 3 == 0) & (F.col("pos") % 2 == 1), " 流程步骤").when((F.col("doc_id") % 3 == 1) & (F.col("pos") % 3 == 1), " 架构组件").otherwise("")
    return structure.diagram_suggestions(inputs.sections(spark, sf_dir).withColumn("text", F.concat("text", more)))


# --- completeness
@_query("verify_notes", f"""WITH p AS ({PAIRS_SQL}), c AS (SELECT doc_id, source, note, length(regexp_replace(source, '\\s+', '', 'g')) AS a, list_distinct(regexp_extract_all(source, '\\d+(?:\\.\\d+)?')) AS nums FROM p)
SELECT doc_id, a::BIGINT AS source_chars, len(list_filter(nums, lambda x: NOT contains(note, x)))::BIGINT AS n_missing FROM c""")
def verify_notes(spark, sf_dir):
    return notes.verify_notes(inputs.pairs(spark, sf_dir)).select("doc_id", F.col("source_chars").cast("long").alias("source_chars"), F.size("missing_numbers").cast("long").alias("n_missing"))


@_query("conservation_ratio", f"""WITH p AS ({PAIRS_SQL}), c AS (SELECT doc_id, length(regexp_replace(source, '\\s+', '', 'g')) AS a, length(regexp_replace(note, '\\s+', '', 'g')) AS b FROM p)
SELECT doc_id, round(CASE WHEN a > 0 THEN b / a ELSE 0 END, 6) AS ratio, CASE WHEN a > 0 THEN b / a ELSE 0 END >= 0.8 AS passed FROM c""")
def conservation_ratio(spark, sf_dir):
    a, b = T.count_chars(F.col("source")), T.count_chars(F.col("note"))
    ratio = F.when(a > 0, b / a).otherwise(0.0)
    return inputs.pairs(spark, sf_dir).select("doc_id", F.round(ratio, 6).alias("ratio"), (ratio >= 0.8).alias("passed"))


_PROSE_HEAD = "regexp_replace(md, '(?s)\\A\\s*---\\n.*?\\n---\\n', '')"
_PROSE_TAIL = "translate(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '\\[!\\w+\\][-+]?', '', 'g'), '|', ' '), '(?m)^[#>\\s]+', '', 'g'), '(?m)^[-*]\\s+', '', 'g'), '(?m)^[-:\\s|]+$', '', 'g'), '*`>', '')"
_PROSE = {
    "document": _PROSE_TAIL.format(x=f"regexp_replace(regexp_replace(replace(regexp_replace({_PROSE_HEAD}, '(?s)```.*?```', '', 'g'), '```', ''), '(?s)\\$\\$.*?\\$\\$', '', 'g'), '\\$[^$\\n]+\\$', '', 'g')"),
    "web": _PROSE_TAIL.format(x=f"replace(regexp_replace({_PROSE_HEAD}, '```[^\\n]*\\n', '', 'g'), '```', '')"),
}
for _variant, _sql in _PROSE.items():

    @_query(f"prose_{_variant}", f"{_MD} SELECT note_id, length(regexp_replace({_sql}, '\\s+', '', 'g'))::BIGINT AS chars FROM n")
    def prose(spark, sf_dir, variant=_variant):
        return inputs.notes(spark, sf_dir).select("note_id", T.count_chars(T.strip_to_prose(F.col("md"), variant)).cast("long").alias("chars"))


@_query("long_enumerations", f"""{_MD}, e AS (SELECT note_id, unnest(regexp_extract_all(md, '[^，。；！？、\\n]+(?:、[^，。；！？、\\n]+)+')) AS r FROM n),
 i AS (SELECT note_id, list_filter(list_transform(string_split(r, '、'), lambda x: rtrim(trim(x), '…. ')), lambda x: length(x) BETWEEN 1 AND 12) AS l FROM e) SELECT note_id, array_to_string(l, '|') AS items FROM i WHERE len(l) >= 5""")
def long_enumerations(spark, sf_dir):
    return inputs.notes(spark, sf_dir).select("note_id", F.explode(T.long_enumerations(F.col("md"))).alias("l")).select("note_id", _joined("l").alias("items"))


# --- claims
@_query("frontmatter", f"""{_MD} SELECT note_id, regexp_extract(md, '(?m)^title: "(.*)"$', 1) AS title, regexp_extract(md, '(?m)^current_version: "(.*)"$', 1) AS version, replace(regexp_extract(md, '(?m)^tags: \\[(.*?)\\]', 1), ', ', '|') AS tags FROM n""")
def frontmatter(spark, sf_dir):
    md = F.col("md")
    return inputs.notes(spark, sf_dir).select("note_id", T.frontmatter_value(md, "title").alias("title"), T.frontmatter_value(md, "current_version").alias("version"), _joined(T.frontmatter_tags(md)).alias("tags"))


@_query("tech_inference", f"""{_MD}, f AS (SELECT note_id, lower(concat(regexp_extract(md, '(?m)^title: "(.*)"$', 1), ' ', regexp_extract(md, '(?m)^tags: \\[(.*?)\\]', 1), ' ', regexp_extract(md, '(?m)^current_version: "(.*)"$', 1))) AS x, regexp_extract(md, '(?m)^current_version: "(.*)"$', 1) AS v FROM n)
SELECT note_id, CASE {' '.join(f"WHEN contains(x, '{k}') THEN '{v}'" for k, v in T.TECH.items())} ELSE '' END AS tech, regexp_extract(v, '(\\d+\\.\\d+[\\.\\d]*)', 1) AS note_version FROM f""")
def tech_inference(spark, sf_dir):
    return notes.note_claims(inputs.notes(spark, sf_dir)).select("note_id", "tech", "note_version")


_BLOCKS = "```(\\w*)\\n((?s:.*?))```"


@_query("fenced_blocks", f"{_MD}, b AS (SELECT note_id, regexp_extract_all(md, '{_BLOCKS}', 1) AS l, regexp_extract_all(md, '{_BLOCKS}', 2) AS c FROM n) SELECT note_id, unnest(l) AS lang, md5(unnest(c)) AS content FROM b")
def fenced_blocks(spark, sf_dir):
    return inputs.notes(spark, sf_dir).select("note_id", F.explode(T.fenced_blocks(F.col("md"))).alias("b")).select("note_id", "b.lang", F.md5("b.content").alias("content"))


_JVM = f"{_MD}, b AS (SELECT note_id, unnest(regexp_extract_all(md, '{_BLOCKS}', 1)) AS l, unnest(regexp_extract_all(md, '{_BLOCKS}', 2)) AS c FROM n)"
_STATIC = "\\b([A-Z][A-Za-z0-9_]+)\\.([a-zA-Z][A-Za-z0-9_]+)\\s*[\\(<]"
_CLAIMS = {
    "imports": "SELECT note_id, unnest(regexp_extract_all(c, '(?m)^import\\s+([\\w\\.]+(?:\\.\\*)?)\\s*;?', 1)) AS x FROM b WHERE l IN ('java', 'scala', 'kotlin', 'groovy', '') UNION SELECT note_id, unnest(regexp_extract_all(c, '(?m)^(?:from|import)\\s+([\\w\\.]+)', 1)) FROM b WHERE l = 'python'",
    "classes": f"SELECT note_id, unnest(regexp_extract_all(c, '\\bnew\\s+([A-Z][A-Za-z0-9_]+)\\s*[(<]', 1)) AS x FROM b WHERE l IN ('java', 'scala', 'kotlin', 'groovy', '') UNION SELECT note_id, unnest(regexp_extract_all(c, '{_STATIC}', 1)) FROM b WHERE l IN ('java', 'scala', 'kotlin', 'groovy', '', 'python') UNION SELECT note_id, unnest(regexp_extract_all(md, '`([A-Z][A-Za-z0-9_]+(?:\\.[A-Za-z][A-Za-z0-9_]*)*)`', 1)) FROM n",
    "methods": f"SELECT note_id, unnest(regexp_extract_all(c, '{_STATIC}', 2)) AS x FROM b WHERE l IN ('java', 'scala', 'kotlin', 'groovy', '', 'python') UNION SELECT note_id, unnest(regexp_extract_all(c, '\\.([a-z][A-Za-z0-9_]+)\\s*\\(', 1)) FROM b WHERE l IN ('java', 'scala', 'kotlin', 'groovy', '', 'python')",
    "configs": "SELECT note_id, unnest(regexp_extract_all(c, '(?m)^([a-z][a-z0-9_.\\-]+)\\s*[:=]', 1)) AS x FROM b WHERE l IN ('yaml', 'yml', 'properties', 'ini', 'conf', 'toml')",
}
_KEEP = {"imports": "true", "classes": "length(x) > 2", "methods": "length(x) > 2 AND x NOT IN (" + ", ".join(f"'{x}'" for x in T.NOISE) + ")", "configs": "(contains(x, '.') OR contains(x, '_'))"}
for _kind, _sql in _CLAIMS.items():

    @_query(f"claims_{_kind}", f"{_JVM}, x AS ({_sql}) SELECT DISTINCT note_id, x AS name FROM x WHERE {_KEEP[_kind]}")
    def claims(spark, sf_dir, kind=_kind):
        return notes.note_claims(inputs.notes(spark, sf_dir)).select("note_id", F.explode(kind).alias("name"))


@_query("versions_mentioned", f"""{_MD}, b AS (SELECT note_id, regexp_replace(md, '(?s)\\A---\\n.*?\\n---\\n', '') AS md FROM n), v AS (SELECT note_id, unnest(regexp_extract_all(md, '\\b([A-Z][A-Za-z]+(?:\\s[A-Za-z]+)?)\\s+(\\d+\\.\\d+[\\.\\d]*)\\b', 1)) AS a, unnest(regexp_extract_all(md, '\\b([A-Z][A-Za-z]+(?:\\s[A-Za-z]+)?)\\s+(\\d+\\.\\d+[\\.\\d]*)\\b', 2)) AS b FROM b) SELECT DISTINCT note_id, concat(a, ' ', b) AS version FROM v""")
def versions_mentioned(spark, sf_dir):
    return notes.note_claims(inputs.notes(spark, sf_dir)).select("note_id", F.explode("versions_mentioned").alias("version"))


@_query("deprecated_names", f"{_MD} SELECT note_id, 'OldApi' || (note_id % 3)::VARCHAR AS name FROM n WHERE contains(md, '[!WARNING]')")
def deprecated_names(spark, sf_dir):
    return notes.note_claims(inputs.notes(spark, sf_dir)).select("note_id", F.explode("deprecated").alias("name"))


# --- lint and repair
@_query("lint_tally", f"""{_MD} SELECT 'ERROR' AS level, 'E1' AS code, count(*) AS n FROM n WHERE note_id % 8 = 3 UNION ALL SELECT 'WARN', 'W2', count(*) FROM n WHERE note_id % 8 = 3 UNION ALL SELECT 'WARN', 'W3', count(*) FROM n WHERE note_id % 8 = 4 UNION ALL SELECT 'WARN', 'W4', count(*) FROM n WHERE note_id % 8 = 4
UNION ALL SELECT 'ERROR', 'E3', count(*) FROM n WHERE note_id % 8 = 5 UNION ALL SELECT 'ERROR', 'E4', count(*) FROM n WHERE note_id % 8 = 6 UNION ALL SELECT 'ERROR', 'E5', count(*) FROM n WHERE note_id % 8 = 6 UNION ALL SELECT 'ERROR', 'E2', count(*) FROM n WHERE note_id % 8 = 7""")
def lint_tally(spark, sf_dir):
    return lint.lint_tally(lint.lint_issues(inputs.notes(spark, sf_dir)))


@_query("lint_unclosed", f"""{_MD}, l AS (SELECT note_id, string_split(md, chr(10)) AS l FROM n WHERE note_id % 8 = 7) SELECT note_id, list_position(l, '```mermaid')::INT AS line FROM l""")
def lint_unclosed(spark, sf_dir):
    return lint.lint_issues(inputs.notes(spark, sf_dir)).where("code = 'E2'").select("note_id", "line")


@_query("fence_ranges", f"""{_MD}, l AS (SELECT note_id, string_split(md, chr(10)) AS l FROM n), f AS (SELECT note_id, list_position(list_transform(l, lambda x: starts_with(x, '```')), true) AS a, list_position(l, '```') AS b FROM l) SELECT note_id, (a - 1)::INT AS s, (b - 1)::INT AS e FROM f WHERE a > 0 AND b > a""")
def fence_ranges(spark, sf_dir):
    return inputs.notes(spark, sf_dir).select("note_id", F.explode(lint.fence_ranges(split_lines(F.col("md")))).alias("f")).select("note_id", "f.s", "f.e")


@_query("table_repair", f"""{_MD} SELECT note_id, md5(CASE WHEN note_id % 8 = 7 THEN replace(md, chr(10) || '||b|', chr(10) || chr(10) || '| |b|') ELSE md END) AS fixed, CASE WHEN note_id % 8 = 7 THEN 2 ELSE 0 END AS fixes FROM n""")
def table_repair(spark, sf_dir):
    return inputs.notes(spark, sf_dir).select("note_id", lint.repair_tables(F.col("md")).alias("r")).select("note_id", F.md5("r.md").alias("fixed"), "r.fixes")


@_query("mermaid_repair", f"""{_MD}, b AS (SELECT note_id, regexp_extract(md, '```mermaid\\n((?s:.*?))```', 1) AS b FROM n) SELECT note_id, md5(CASE WHEN note_id % 8 = 3 THEN replace(b, chr(92) || 'n', '<br/>') ELSE b END) AS fixed FROM b WHERE b <> ''""")
def mermaid_repair(spark, sf_dir):
    block = F.regexp_extract("md", "```mermaid\\n((?s:.*?))```", 1)
    return inputs.notes(spark, sf_dir).select("note_id", block.alias("b")).where("b <> ''").select("note_id", F.md5(lint.repair_mermaid(F.col("b"))).alias("fixed"))


@_query("blank_and_heading_repair", f"{_MD} SELECT note_id, md5(regexp_replace(regexp_replace(concat(md, chr(10), chr(10), chr(10), md), '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^# (.+)$', '## \\1', 'g')) AS fixed FROM n")
def blank_and_heading_repair(spark, sf_dir):
    return inputs.notes(spark, sf_dir).select("note_id", F.md5(T.demote_h1(T.collapse_blank(F.concat("md", F.lit("\n\n\n"), "md")))).alias("fixed"))


# --- links and assets
@_query("note_urls", f"""{_MD}, m AS (SELECT note_id, regexp_extract(md, '!?\\[[^\\]]*\\]\\((https?://[^) \\t\\n]+)\\)', 1) AS u, regexp_matches(md, '!\\[[^\\]]*\\]\\(https?://') AS i, rtrim(regexp_extract(md, '[^(](https?://[^\\s)"''<>]+)', 1), '.,;)') AS bare FROM n)
SELECT note_id, 0 AS place, u AS url, i AS is_image FROM m UNION ALL SELECT note_id, 1, bare, false FROM m""")
def note_urls(spark, sf_dir):
    return notes.note_urls(inputs.notes(spark, sf_dir))


@_query("probe_plan", f"""{_MD}, m AS (SELECT note_id, regexp_extract(md, '!?\\[[^\\]]*\\]\\((https?://[^) \\t\\n]+)\\)', 1) AS url, regexp_matches(md, '!\\[[^\\]]*\\]\\(https?://') AS i FROM n UNION ALL SELECT note_id, rtrim(regexp_extract(md, '[^(](https?://[^\\s)"''<>]+)', 1), '.,;)'), false FROM n)
SELECT url, bool_or(i) AS is_image, count(DISTINCT note_id) AS n_notes FROM m GROUP BY url""")
def probe_plan(spark, sf_dir):
    return notes.probe_plan(notes.note_urls(inputs.notes(spark, sf_dir)))


@_query("content_groups", "SELECT md5(text) AS content_key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def content_groups(spark, sf_dir):
    return notes.content_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@_query("image_numbering", f"{_MD} SELECT note_id, 1 AS place, 'img/' || note_id::VARCHAR || '.png' AS path, 'p01_f' || lpad((note_id % 90)::VARCHAR, 2, '0') || '_img001' AS name FROM n")
def image_numbering(spark, sf_dir):
    rows = inputs.notes(spark, sf_dir).select("note_id", F.concat("md", F.lit("![a](img/"), F.col("note_id").cast("string"), F.lit(".png)")).alias("md"), (F.col("note_id") % 90).cast("int").alias("file_index"))
    return notes.image_refs(rows).select("note_id", "place", "path", "name")


@_query("code_score", "SELECT doc_id, (length(text) - length(translate(text, '{};()=<>.:/\"''#', '')))::BIGINT AS score FROM documents")
def code_score(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.code_score(F.col("text")).cast("long").alias("score"))


@_query("image_rules", "WITH i AS (SELECT doc_id, (doc_id * 37 % 5000)::INT AS w, (doc_id * 53 % 3000)::INT AS h FROM documents) SELECT doc_id, w > 0 AND w <= 700 AND h > 0 AND h <= 150 AS small, CASE WHEN greatest(w, h) > 2000 THEN floor(w * (2000 / greatest(w, h)))::INT ELSE w END AS rw, CASE WHEN greatest(w, h) > 2000 THEN floor(h * (2000 / greatest(w, h)))::INT ELSE h END AS rh FROM i")
def image_rules(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "cast(doc_id * 37 % 5000 as int) w", "cast(doc_id * 53 % 3000 as int) h")
    size = L.resized(F.col("w"), F.col("h"))
    return rows.select("doc_id", L.small_inline(F.col("w"), F.col("h")).alias("small"), size["w"].alias("rw"), size["h"].alias("rh"))


@_query("gates", f"""{_MD} SELECT note_id, length(md) > 1000 AS long_enough, 3 AS n_keys, 2 AS n_tags, false AS unanswered, 0 AS placeholders, false AS too_large FROM n""")
def gates(spark, sf_dir):
    return notes.gates(inputs.notes(spark, sf_dir)).drop("n_diagrams", "n_external")
