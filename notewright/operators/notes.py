"""Checks and rewrites of notes: completeness, links, images, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rx import find_all

THRESHOLD = {"technical": 0.60, "conceptual": 0.80}
MAX_NOTE_BYTES = 5_242_880


def verify_notes(pairs: DataFrame, kind: str = "conceptual", variant: str = "document") -> DataFrame:
    """(doc_id, source_chars, note_chars, ratio, passed, missing_numbers, dropped_enumerations) of pairs (doc_id, source, note): one projection, no shuffle."""
    n_source, n_note = T.count_chars(F.col("source")), T.count_chars(T.strip_to_prose(F.col("note"), variant))
    rows = pairs.select("doc_id", "source", "note", n_source.alias("source_chars"), n_note.alias("note_chars"))
    ratio = F.when(F.col("source_chars") > 0, F.col("note_chars") / F.col("source_chars")).otherwise(0.0)
    return rows.select(
        "doc_id", "source_chars", "note_chars", ratio.alias("ratio"), (ratio >= THRESHOLD[kind]).alias("passed"),
        T.missing_numbers(F.col("source"), F.col("note")).alias("missing_numbers"), T.dropped_enumerations(F.col("source"), F.col("note")).alias("dropped_enumerations"),
    )


def note_claims(notes: DataFrame) -> DataFrame:
    """Technical claims of notes (note_id, md), for a freshness review."""
    md, body = F.col("md"), T.strip_frontmatter(F.col("md"))
    version = F.coalesce(T.frontmatter_value(md, "current_version"), F.lit(""))
    title = F.coalesce(T.frontmatter_value(md, "title"), F.lit(""))
    return notes.select(
        "note_id", title.alias("title"), T.infer_tech(title, F.array_join(T.frontmatter_tags(md), " "), version, version=version).alias("tech"), T.version_number(version).alias("note_version"),
        T.claim_classes(body).alias("classes"), T.claim_methods(body).alias("methods"), T.claim_configs(body).alias("configs"), T.claim_imports(body).alias("imports"),
        T.versions_mentioned(body).alias("versions_mentioned"), T.deprecated_names(body).alias("deprecated"), T.code_languages(body).alias("code_languages"),
    )


def web_tech(notes: DataFrame) -> DataFrame:
    """(note_id, tech) of notes on web pages, by title, course and tags."""
    md = F.col("md")
    own = [F.coalesce(T.frontmatter_value(md, k), F.lit("")) for k in ("title", "course")]
    return notes.select("note_id", T.infer_tech(*own, F.array_join(T.frontmatter_tags(md), " "), keywords=T.WEB_TECH).alias("tech"))


def freshness(claims: DataFrame, api: DataFrame, kind: str = "classes") -> DataFrame:
    """(note_id, name, category) of claimed names against a current API table (name, status): valid, changed, removed, or new for names that no note has."""
    own = claims.select("note_id", F.explode(kind).alias("name"))
    both = own.join(api.select("name", "status"), "name", "full_outer")
    return both.select("note_id", "name", F.when(F.col("note_id").isNull(), "new").when(F.col("status").isNull(), "removed").when(F.col("status") == "changed", "changed").otherwise("valid").alias("category"))


def note_urls(notes: DataFrame) -> DataFrame:
    """(note_id, place, url, is_image) of each distinct URL of a note."""
    return notes.select("note_id", F.posexplode(T.urls(F.col("md"))).alias("place", "u")).select("note_id", "place", "u.url", "u.is_image")


def probe_plan(urls: DataFrame) -> DataFrame:
    """(url, is_image, n_notes): each URL once for all notes that have it."""
    return urls.groupBy("url").agg(F.max("is_image").alias("is_image"), F.countDistinct("note_id").alias("n_notes"))


def image_refs(notes: DataFrame, prefix: str = "p01") -> DataFrame:
    """(note_id, place, alt, path, name) of local images, numbered within the note; `file_index` is taken from notes."""
    p = "!\\[([^\\]]*)\\]\\(([^)]+)\\)"
    refs = F.arrays_zip(find_all(F.col("md"), p, 1).alias("alt"), find_all(F.col("md"), p, 2).alias("path"))
    local = F.filter(refs, lambda r: ~r["path"].rlike("\\Ahttps?://"))
    rows = notes.select("note_id", "file_index", F.posexplode(local).alias("i", "r"))
    return rows.select("note_id", (F.col("i") + 1).alias("place"), "r.alt", "r.path", F.format_string(f"{prefix}_f%02d_img%03d", "file_index", F.col("i") + 1).alias("name"))


def rewrite_images(md: Column, mapping: Column, failed: str = " ⚠️上传失败") -> Column:
    """Local image references with the URL that map<path, url> has for them; others are marked in their alt text."""
    p = "!\\[[^\\]]*\\]\\([^)]+\\)"
    parts, refs = F.split(md, p), find_all(md, p)

    def one(r):
        alt, path = F.regexp_extract(r, "!\\[([^\\]]*)\\]", 1), F.regexp_extract(r, "\\(([^)]+)\\)", 1)
        url = mapping[path]
        return F.when(path.rlike("\\Ahttps?://"), r).when(url.isNotNull(), F.concat(F.lit("!["), alt, F.lit("]("), url, F.lit(")"))).otherwise(F.concat(F.lit("!["), alt, F.lit(failed + "]("), path, F.lit(")")))

    both = F.transform(F.arrays_zip(parts.alias("a"), F.transform(refs, one).alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit(""))))
    return F.array_join(both, "")


def content_groups(assets: DataFrame, content: str = "content") -> DataFrame:
    """(content_key, first_id, n) of assets (id, content): equal contents once."""
    return assets.groupBy(F.md5(F.col(content).cast("binary")).alias("content_key")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


def upload_status(assets: DataFrame, existing: DataFrame) -> DataFrame:
    """(content_key, status) against the keys that a store has already."""
    return assets.select("content_key").distinct().join(existing.select("content_key", F.lit(True).alias("there")), "content_key", "left").select("content_key", F.when(F.col("there"), "skipped").otherwise("upload").alias("status"))


def gates(notes: DataFrame) -> DataFrame:
    """Simple checks of finished notes (note_id, md)."""
    md = F.col("md")
    count = lambda p: F.size(find_all(md, f"(?dm)^.*{p}.*$"))
    keys = ["title", "source_doc", "source_version", "current_version", "tags", "date"]
    return notes.select(
        "note_id", (F.length(md) > 1000).alias("long_enough"), sum(F.when(F.coalesce(T.frontmatter_block(md), F.lit("")).rlike(f"(?dm)^{k}:"), 1).otherwise(0) for k in keys).alias("n_keys"), F.size(T.frontmatter_tags(md)).alias("n_tags"),
        ((count("\\[!QUESTION\\]") > 0) & (count("\\[!SUCCESS\\]") == 0)).alias("unanswered"), F.size(find_all(md, "<!-- FILL -->")).alias("placeholders"), (F.octet_length(md) > MAX_NOTE_BYTES).alias("too_large"),
        F.size(find_all(md, "```mermaid")).alias("n_diagrams"), F.size(find_all(md, "!\\[[^\\]]*\\]\\(http|<img src=\"http|<style>")).alias("n_external"),
    )
