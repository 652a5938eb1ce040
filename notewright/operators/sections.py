"""From a document's raw paragraphs and tables to sections, and from sections to manifests and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as T

# Types whose text is prose.
PROSE_TYPES = ["paragraph", "heading", "list_item", "quote"]


def resolve_lists(paragraphs: DataFrame, numbers: DataFrame, levels: DataFrame) -> DataFrame:
    """`paragraphs` (num_id, ilvl) with format, ordered and list_level, by two left joins: `numbers` (num_id, abstract_id), `levels` (abstract_id, ilvl, format).

    Without a definition the format is bullet; a level that is no number is 0. All three are null for paragraphs outside lists.
    """
    level = F.coalesce(F.expr("try_cast(ilvl as int)"), F.lit(0))
    rows = paragraphs.withColumn("__level", F.when(F.col("num_id").isNotNull(), level))
    rows = rows.join(numbers.dropDuplicates(["num_id"]).withColumnRenamed("abstract_id", "__abstract"), "num_id", "left")
    known = levels.dropDuplicates(["abstract_id", "ilvl"]).select(F.col("abstract_id").alias("__a"), F.expr("try_cast(ilvl as int)").alias("__l"), "format")
    rows = rows.join(known, (F.col("__abstract") == F.col("__a")) & (F.col("__level") == F.col("__l")), "left").drop("__a", "__l", "__abstract")
    kind = F.when(F.col("num_id").isNotNull(), F.coalesce("format", F.lit("bullet")))
    return rows.withColumn("format", kind).withColumn("ordered", ~F.col("format").isin("bullet", "none")).withColumnRenamed("__level", "list_level")


def classify(elements: DataFrame) -> DataFrame:
    """(doc_id, pos, type, level, text, lang, ordered) of elements (doc_id, pos, kind, style, text, max_pt, bold, all_bold, fonts, ordered, list_level, rows, images).

    Paragraphs: image, heading, list item, code, paragraph, in that order. A table of one cell is code or a quote, or nothing but
    its images; other tables are Markdown. Empty text gives no section.
    """
    heading = L.heading_level(F.col("style"), F.col("max_pt"), F.col("bold"), F.col("all_bold"), F.col("text"))
    images = F.size("images") > 0
    own = L.section_type(images, heading, F.col("ordered").isNotNull(), L.is_code_paragraph(F.col("style"), F.col("fonts")), F.col("text"))
    single = (F.size("rows") == 1) & (F.size(F.col("rows")[0]) == 1)
    cell = F.when((F.col("kind") == "tbl") & single, L.single_cell(F.col("rows")[0][0]))
    rows = elements.withColumn("__level", heading).withColumn("__own", own).withColumn("__cell", cell)
    table = F.col("kind") == "tbl"
    kind = F.when(~table, F.col("__own")).when(~single, "table").when(images, "image").when(F.col("__cell.text") != "", F.col("__cell.type"))
    text = F.when(~table, F.col("text")).when(~single, L.markdown_table(F.col("rows"))).otherwise(F.col("__cell.text"))
    level = F.when(kind == "heading", F.col("__level")).when(kind == "list_item", F.col("list_level"))
    lang = F.when(kind == "code", F.coalesce("__cell.lang", F.lit("text")))
    return rows.select("doc_id", "pos", kind.alias("type"), level.cast("int").alias("level"), text.alias("text"), lang.alias("lang"), F.when(kind == "list_item", F.col("ordered")).alias("ordered")).where("type is not null")


def mark_repeated_images(images: DataFrame, drop: bool = False) -> DataFrame:
    """`images` (doc_id, pos, key) with `duplicate` for all but the first of a key in its document; drop: without those."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("pos"))
    rows = images.withColumn("duplicate", rank > 1)
    return rows.where("not duplicate").drop("duplicate") if drop else rows


def prose(sections: DataFrame) -> DataFrame:
    """(doc_id, source): the text of a document's prose sections, in order, a line each."""
    own = sections.where(F.col("type").isin(PROSE_TYPES) & (F.coalesce("text", F.lit("")) != ""))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("source"))


def manifests(sections: DataFrame, titles: DataFrame, split_levels: DataFrame) -> DataFrame:
    """(doc_id, title, chapter_level, total_sections, total_images, type_counts): a document's summary, a row each."""
    counts = sections.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    total = counts.groupBy("doc_id").agg(F.sum("n").alias("total_sections"), F.coalesce(F.sum(F.when(F.col("type") == "image", F.col("n"))), F.lit(0)).alias("total_images"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("type_counts"))
    return titles.join(split_levels, "doc_id").join(total, "doc_id").select("doc_id", "title", F.col("split_level").alias("chapter_level"), "total_sections", "total_images", "type_counts")


def raw_span_chars(html: F.Column) -> F.Column:
    """Characters of an editor page's spans, white space among them."""
    return F.length(T.span_text(html))
