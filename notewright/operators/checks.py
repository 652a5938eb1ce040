"""Checks of finished notes, and what routes and plans them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rx import WS, find_all, split_lines, strip

# The pattern of an HTML card, and the end of a comment section's heading.
CARD = '(?s)<div[^>]*style="[^"]*display:(?:grid|flex)[^"]*"[^>]*>.*?</div>\\s*(?=<div|\\n##|\\n---|\\z)'
COMMENTS = "全部留言"
#: Headings of a level that make it the chapters' level, months until a note is reviewed in full, images of a batch.
MIN_CHAPTERS, QUICK_MONTHS, BATCH = 3, 6, 4


def mermaid_sources(md: Column) -> Column:
    return find_all(md, "(?s)```mermaid\\n(.*?)```", 1)


def literal_line_ends(md: Column) -> Column:
    """Lines of diagrams that hold a literal backslash and n."""
    return F.size(F.filter(F.flatten(F.transform(mermaid_sources(md), lambda b: F.split(b, "\n"))), lambda x: F.contains(x, F.lit("\\n"))))


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, f"(?U)\\A{WS}++", ""))


def mindmap_faults(md: Column) -> Column:
    """struct<unindented, many_roots>: mind maps whose root stands at the margin, and those with several roots."""
    lines = F.transform(mermaid_sources(md), lambda b: F.filter(F.split(b, "\n"), lambda x: strip(x) != ""))
    maps = F.filter(lines, lambda x: (F.size(x) > 1) & (strip(F.get(x, F.lit(0))) == "mindmap"))
    indents = F.transform(maps, lambda x: F.transform(F.slice(x, 2, F.size(x)), _indent))
    count = lambda test: F.size(F.filter(indents, test))
    return F.struct(count(lambda x: F.array_min(x) == 0).alias("unindented"), count(lambda x: F.size(F.filter(x, lambda y: y == F.array_min(x))) > 1).alias("many_roots"))


def cards(md: Column) -> Column:
    return find_all(md, CARD)


def split_cards(md: Column) -> Column:
    """Cards with a blank line inside, which ends them early."""
    return F.size(F.filter(cards(md), lambda x: x.rlike("\\n\\s*\\n")))


def visual_blocks(md: Column) -> Column:
    """struct<n, mindmaps, enough>: diagrams and cards; two blocks are enough if one is a mind map."""
    own = mermaid_sources(md)
    n, maps = F.size(own) + F.size(cards(md)), F.size(F.filter(own, lambda x: strip(x).rlike("\\Amindmap")))
    return F.struct(n.alias("n"), maps.alias("mindmaps"), ((n >= 2) & (maps >= 1)).alias("enough"))


def outside_resources(md: Column) -> Column:
    """Fences of a kind that isn't rendered, and images and styles from elsewhere."""
    return F.size(find_all(md, '```mindmap|!\\[[^\\]]*\\]\\(https?://|<img src="http|<style'))


def note_checks(notes: DataFrame) -> DataFrame:
    """(note_id, literal_line_ends, unindented, many_roots, split_cards, n_visual, mindmaps, enough_visual, outside, verdict) of notes (note_id, md).

    verdict: pass, warn for one or two failed checks, redo for three or more.
    """
    md = F.col("md")
    rows = notes.select("note_id", literal_line_ends(md).alias("literal_line_ends"), mindmap_faults(md).alias("m"), split_cards(md).alias("split_cards"), visual_blocks(md).alias("v"), outside_resources(md).alias("outside"))
    rows = rows.select("note_id", "literal_line_ends", "m.unindented", "m.many_roots", "split_cards", F.col("v.n").alias("n_visual"), "v.mindmaps", F.col("v.enough").alias("enough_visual"), "outside")
    failed = [F.col("literal_line_ends") > 0, (F.col("unindented") > 0) | (F.col("many_roots") > 0), F.col("split_cards") > 0, ~F.col("enough_visual"), F.col("outside") > 0]
    return rows.withColumn("verdict", severity(sum((x.cast("int") for x in failed), F.lit(0))))


def severity(failures: Column) -> Column:
    return F.when(failures == 0, "pass").when(failures <= 2, "warn").otherwise("redo")


def chapter_levels(sections: DataFrame) -> DataFrame:
    """(doc_id, chapter_level) of sections (doc_id, pos, type, level): the shallower of levels 1 (without the first heading of that level) and 2 with MIN_CHAPTERS headings; 0 is a flat text."""
    heading = F.col("type") == "heading"
    n = sections.groupBy("doc_id").agg(F.count_if(heading & (F.col("level") == 1)).alias("a"), F.count_if(heading & (F.col("level") == 2)).alias("b"))
    return n.select("doc_id", F.when(F.col("a") - 1 >= MIN_CHAPTERS, 1).when(F.col("b") >= MIN_CHAPTERS, 2).otherwise(0).alias("chapter_level"))


def cut_comments(sections: DataFrame) -> DataFrame:
    """Sections before the first heading that ends in COMMENTS; it and all after it go."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (F.col("type") == "heading") & F.endswith("text", F.lit(COMMENTS))
    return sections.withColumn("__cut", F.max(F.coalesce(ends, F.lit(False))).over(order)).where("not __cut").drop("__cut")


def title_parts(title: Column) -> Column:
    """struct<lecture, topic, course> of a page's title `lecture｜topic-course-site`; what is missing is an empty text."""
    parts = F.split(title, "-")
    head, course = parts[0], F.when(F.size(parts) >= 3, strip(parts[F.size(parts) - 2])).otherwise("")
    cut = F.split(head, "\\s*[｜|]\\s*", 2)
    return F.struct(F.when(F.size(cut) > 1, strip(cut[0])).otherwise("").alias("lecture"), strip(F.element_at(cut, -1)).alias("topic"), course.alias("course"))


def page_author(html: Column) -> Column:
    """The author by an article's info, else by a name element, else by a greeting; an empty text without one."""
    info = F.regexp_extract(html, '(?s)class="[^"]*articleInfo[^"]*"[^>]*>\\s*(?:<span[^>]*>)?\\s*([^<]+)', 1)
    name = F.regexp_extract(html, '(?s)class="[^"]*authorName[^"]*"[^>]*>\\s*([^<]+)', 1)
    hello = F.regexp_extract(html, "你好，我是\\s*([^，。,.<\\s]+)", 1)
    some = lambda c: F.when(strip(c) != "", strip(c))
    return F.coalesce(some(info), some(name), some(hello), F.lit(""))


def route_topics(topics: DataFrame, routes: dict[str, str], other: str = "") -> DataFrame:
    """`topics` with `folder`: that of the first route whose key the lower-case topic contains."""
    topic = F.lower("topic")
    return topics.withColumn("folder", F.coalesce(*(F.when(F.contains(topic, F.lit(k)), F.lit(v)) for k, v in routes.items()), F.lit(other)))


def is_conceptual(claims: DataFrame) -> DataFrame:
    """(note_id, conceptual) of note_claims' rows: no classes and no settings are claimed."""
    return claims.select("note_id", ((F.size("classes") == 0) & (F.size("configs") == 0)).alias("conceptual"))


def review_kind(written: Column, today: Column) -> Column:
    return F.when(F.months_between(today, written) <= QUICK_MONTHS, "quick").otherwise("full")


def image_batches(images: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """`images` with `batch`, from 0: BATCH images of a key at a time, in order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return images.withColumn("batch", F.floor((rank - 1) / BATCH).cast("int"))


def missing_headings(source: DataFrame, note: DataFrame) -> DataFrame:
    """(doc_id, heading): headings of `source` that `note` (both doc_id, heading) has not, compared in lower case without white space."""
    same = lambda d: d.withColumn("__key", F.lower(F.regexp_replace("heading", f"(?U){WS}++", "")))
    return same(source).join(same(note).select("doc_id", "__key").distinct(), ["doc_id", "__key"], "left_anti").select("doc_id", "heading")


def headings(notes: DataFrame, key: str = "note_id") -> DataFrame:
    """(note_id, line, level, heading) of the Markdown headings of notes."""
    lines = notes.select(key, F.posexplode(split_lines(F.col("md"))).alias("line", "x"))
    p = "\\A(#{1,6})\\s+(.*)"
    return lines.where(F.col("x").rlike(p)).select(key, "line", F.length(F.regexp_extract("x", p, 1)).alias("level"), strip(F.regexp_extract("x", p, 2)).alias("heading"))


def gather(results: DataFrame, key: str = "note_id", position: str = "place") -> DataFrame:
    """(key, results): what a parallel step gave, in the order of its input."""
    rest = [c for c in results.columns if c != key]
    return results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, *(c for c in rest if c != position)))).alias("results"))
