"""Classification of paragraphs, cells and images from their features."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import find_all, strip

# Least font sizes of heading levels, and numbers that bound chapters and images.
LEVEL_PT = (22.0, 17.0, 15.5, 13.0)
MAX_SECTIONS, MIN_SECTIONS, MAX_IMAGE_PX = 90, 15, 2000
# Fonts of code.
MONOSPACE = ["courier", "courier new", "consolas", "monaco", "inconsolata", "source code pro", "jetbrains mono", "fira code", "lucida console", "menlo", "andale mono", "liberation mono", "dejavu sans mono"]
# First lines that name a language, and the language's name in a fence.
LANG_LABELS = {
    "shell": "bash", "bash": "bash", "sh": "bash", "shellsession": "bash", "cmd": "bat", "powershell": "powershell", "bat": "bat", "yaml": "yaml", "yml": "yaml",
    "plain text": "text", "plaintext": "text", "text": "text", "txt": "text", "sql": "sql", "mysql": "sql", "hql": "sql", "flinksql": "sql", "java": "java", "scala": "scala",
    "kotlin": "kotlin", "groovy": "groovy", "python": "python", "py": "python", "json": "json", "xml": "xml", "html": "html", "css": "css", "properties": "properties",
    "ini": "ini", "conf": "ini", "markdown": "markdown", "md": "markdown", "dockerfile": "dockerfile", "docker": "dockerfile", "c": "c", "c++": "cpp", "cpp": "cpp", "go": "go",
    "golang": "go", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "scala/java": "scala",
}
CODE_SIGNAL = "[{};=]|\\b(import|package|public|private|class|def|val|var|function|SELECT|INSERT|CREATE|FROM|WHERE|env\\.|System\\.|println|print\\()|^\\s*[#$/]"
_NUMBERED = "(?U)\\A(\\d+)((?:\\.\\d+)*)\\.?(?:\\s|、|\\z)"


def numbering_depth(text: Column) -> Column:
    """1 and the dots of a leading number; null without one."""
    t = strip(text)
    tail = F.regexp_extract(t, _NUMBERED, 2)
    return F.when(t.rlike(_NUMBERED), 1 + F.length(tail) - F.length(F.translate(tail, ".", "")))


def heading_level(style: Column, max_pt: Column, bold: Column, all_bold: Column, text: Column) -> Column:
    """0 to 4, from the style's name, else from size, weight and numbering."""
    digit = F.regexp_extract(style, "(\\d+)", 1)
    styled = F.when(digit == "", 1).otherwise(F.least(digit.cast("int"), F.lit(4)))
    depth, short = numbering_depth(text), F.length(text) < 80
    by_size = F.when(max_pt >= LEVEL_PT[0], 1).when(max_pt >= LEVEL_PT[1], 2).when(max_pt >= LEVEL_PT[2], 3).when((max_pt >= LEVEL_PT[3]) & short, 4).otherwise(0)
    unsized = F.when(bold & depth.isNotNull() & short, F.least(F.greatest(depth + 1, F.lit(2)), F.lit(4))).when(all_bold & (F.length(text) < 60), 4).otherwise(0)
    return F.when(F.startswith(style, F.lit("Heading")), styled).when(max_pt > 0, F.when(bold, by_size).otherwise(0)).otherwise(unsized).cast("int")


def pdf_heading_level(max_pt: Column, bold: Column, text: Column) -> Column:
    depth = numbering_depth(text)
    level = F.when(bold & (max_pt >= LEVEL_PT[0]), 1).when(bold & (max_pt >= LEVEL_PT[1]), 2).when(bold & (max_pt >= LEVEL_PT[2]), 3)
    return level.when(depth.isNotNull() & (F.length(text) < 80), F.least(F.greatest(depth + 1, F.lit(2)), F.lit(4))).otherwise(0).cast("int")


def run_max_pt(runs: Column) -> Column:
    """Largest size of array<struct<text, pt, bold>>, 0 if none has one."""
    return F.coalesce(F.array_max(F.transform(runs, lambda r: r["pt"])), F.lit(0.0))


def run_any_bold(runs: Column) -> Column:
    return F.exists(runs, lambda r: F.coalesce(r["bold"], F.lit(False)) & (strip(r["text"]) != ""))


def run_all_bold(runs: Column) -> Column:
    own = F.filter(runs, lambda r: strip(r["text"]) != "")
    return (F.size(own) > 0) & F.forall(own, lambda r: F.coalesce(r["bold"], F.lit(False)))


def is_code_paragraph(style: Column, fonts: Column) -> Column:
    return F.lower(style).rlike("code|preformat") | F.exists(fonts, lambda f: F.lower(f).isin(MONOSPACE))


def single_cell(text: Column) -> Column:
    """struct<type, lang, text> of a table's only cell: code with or without a language label, else a quote."""
    lines = F.split(text, "\n")
    label = F.create_map(*(F.lit(x) for kv in LANG_LABELS.items() for x in kv))[F.lower(strip(lines[0]))]
    trim = lambda c: F.regexp_replace(c, "\\A\\n++|\\n++\\z", "")
    code = lambda lang, body: F.struct(F.lit("code").alias("type"), lang.alias("lang"), trim(body).alias("text"))
    looks = text.rlike(CODE_SIGNAL) & (F.contains(text, F.lit("\n")) | (F.length(text) < 200))
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return F.when(label.isNotNull(), code(label, rest)).when(looks, code(F.lit("text"), text)).otherwise(F.struct(F.lit("quote").alias("type"), F.lit(None).cast("string").alias("lang"), strip(text).alias("text")))


def section_type(has_image: Column, level: Column, is_list: Column, is_code: Column, text: Column) -> Column:
    """Priority of a paragraph's type; null if there is nothing to emit."""
    return F.when(has_image, "image").when(strip(text) == "", None).when(level > 0, "heading").when(is_list, "list_item").when(is_code, "code").otherwise("paragraph")


def markdown_table(rows: Column, line_break: str = "<br/>") -> Column:
    """array<array<string>> as a Markdown table whose first row is the header; null cells are empty."""
    cells = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(line_break))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(cells, 1, 1), F.array(rule), F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))), "\n")).otherwise("")


def small_inline(w: Column, h: Column) -> Column:
    return (w > 0) & (w <= 700) & (h > 0) & (h <= 150)


def decorative(tag: Column, w: Column, h: Column, n_bytes: Column) -> Column:
    return (tag == "CONTENT") & (F.greatest(w, h) < 1500) & (n_bytes < 358400)


def cover_or_content(html: Column, name: Column) -> Column:
    first = F.locate('data-slate-string="true"', html)
    at = F.call_function("locate", name, html)
    return F.when((first > 0) & (at > 0) & (at < first), "COVER").otherwise("CONTENT")


def resized(w: Column, h: Column, limit: int = MAX_IMAGE_PX) -> Column:
    """struct<w, h> with the longer side at most `limit`, both cut to integers."""
    most = F.greatest(w, h)
    scaled = lambda x: F.when(most > limit, F.floor(x * (limit / most))).otherwise(x).cast("int")
    return F.struct(scaled(w).alias("w"), scaled(h).alias("h"))


def png_size(data: Column) -> Column:
    """struct<w, h> from a PNG's header; nulls for other data."""
    at = lambda i: F.conv(F.hex(F.substring(data, i, 4)), 16, 10).cast("long")
    png = F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A"
    return F.struct(F.when(png, at(17)).alias("w"), F.when(png, at(21)).alias("h"))


def jpeg_dimensions(raw: bytes) -> tuple[int, int] | None:
    """(width, height) from a JPEG's frame header; None for other data or without one."""
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 <= len(raw) and raw[at] == 0xFF:
        if raw[at + 1] in (0xC0, 0xC1, 0xC2):
            height, width = struct.unpack_from(">HH", raw, at + 5)
            return width, height
        at += 2 + struct.unpack_from(">H", raw, at + 2)[0]
    return None


def jpeg_size(data: Column) -> Column:
    """struct<w, h> of JPEG data; nulls for other data."""

    @F.pandas_udf("w long, h long")
    def size(column: pd.Series) -> pd.DataFrame:
        found = [(raw is not None and jpeg_dimensions(bytes(raw))) or (None, None) for raw in column]
        return pd.DataFrame(found, columns=["w", "h"]).astype("Int64")

    return size(data)


def probe_verdict(status: Column, content_type: Column, size: Column, is_image: Column) -> Column:
    """Whether a probed URL is fine: status 200, an image where one is expected, not empty (-1: size unknown)."""
    return F.coalesce((status == 200) & (~is_image | F.startswith(F.coalesce(content_type, F.lit("")), F.lit("image/"))) & (size != 0), F.lit(False))


def slide_lines(lines: Column) -> Column:
    """Slide lines as Markdown: bullets, quotes of short lines with operators, plain text; blank lines go."""
    def one(raw):
        s = strip(raw)
        bullet = F.substring(s, 1, 1).isin(*"•·–—▪◦‣⁃")
        quote = s.rlike("[≠×÷→←⇒⟹]") & F.length(s).between(4, 60)
        return F.when(bullet, F.concat(F.lit("- "), strip(F.substr(s, F.lit(2))))).when(quote, F.concat(F.lit("> [!QUOTE]\n> "), s)).otherwise(s)

    return F.transform(F.filter(lines, lambda x: strip(x) != ""), one)


def cover_abstract(lines: Column) -> Column:
    own = F.filter(F.transform(lines, strip), lambda x: x != "")
    head = F.concat(F.lit("> [!ABSTRACT] 课件摘要\n> **"), own[0], F.lit("**"))
    return F.when(F.size(own) == 0, "").when(F.size(own) == 1, F.concat(head, F.lit("\n"))).otherwise(F.concat(head, F.lit("  \n> "), F.array_join(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(1))), "  \n> "), F.lit("\n")))


def count_lines(md: Column, pattern: str) -> Column:
    return F.size(find_all(md, f"(?dm)^.*{pattern}.*$"))
