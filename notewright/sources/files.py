"""Files as tables: notes, saved web pages, word-processor documents and images."""

from __future__ import annotations

import email
import email.policy
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rx import split_lines

IMAGE_SUFFIXES_OCR = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff")
IMAGE_SUFFIXES_UPLOAD = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_notes(spark: SparkSession, folder: str, numbered: bool = False) -> DataFrame:
    """(note_id, path, md) of all .md files below a folder; numbered: only names that begin with a digit, but not with 00."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*.md" if numbered else "*.md").text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("md"), F.col("_metadata.file_name").alias("name"))
    return (rows.where(~F.startswith("name", F.lit("00"))) if numbered else rows).select(F.col("path").alias("note_id"), "path", "md")


def join_notes(notes: DataFrame, separator: str = "\n") -> DataFrame:
    """(folder, md): the notes of each folder, joined in the order of their paths."""
    folder = F.regexp_replace("path", "/[^/]*\\z", "")
    return notes.groupBy(folder.alias("folder")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "md"))), lambda x: x["md"]), separator).alias("md"))


def read_binary(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """binaryFile rows of the files below a folder that end in a suffix, in any case; others are never read."""
    glob = "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def read_or_errors(spark: SparkSession, paths: list[str], read) -> tuple[DataFrame, DataFrame]:
    """(rows of all paths that can be read, errors): read(spark, path) for each path; errors (path, level, code, message) are rows, not exceptions."""
    found, errors = None, []
    for path in paths:
        try:
            rows = read(spark, path)
        except AnalysisException as e:
            errors.append((path, "ERROR", "IO", str(e).splitlines()[0]))
            continue
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], "path string"), spark.createDataFrame(errors, "path string, level string, code string, message string")


def _mhtml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf.path, pdf.content, strict=True):
            seen = False
            for i, part in enumerate(email.message_from_bytes(bytes(content), policy=email.policy.compat32).walk()):
                kind, where = part.get_content_type(), part.get("Content-Location", "") or ""
                if part.is_multipart():
                    continue
                if kind == "text/html" and not seen:
                    seen = True
                    rows.append((path, i, kind, where, (part.get_payload(decode=True) or b"").decode("utf-8", "ignore"), None))
                elif kind.startswith("image/") and "resource/image" in where:
                    rows.append((path, i, kind, where, None, part.get_payload(decode=True)))
        yield pd.DataFrame(rows, columns=["path", "part", "content_type", "location", "html", "content"])


def read_mhtml(spark: SparkSession, folder: str) -> DataFrame:
    """(path, part, content_type, location, html, content): the first HTML part and the article's own images of each saved page."""
    return read_binary(spark, folder, (".mhtml", ".mht")).select("path", "content").mapInPandas(_mhtml, "path string, part int, content_type string, location string, html string, content binary")


def docx_features(raw: bytes) -> Iterator[tuple]:
    """(pos, kind, style, text, max_pt, bold, all_bold, fonts, num_id, ilvl, rows, images) of the elements of a document's body, in order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))} if "word/_rels/document.xml.rels" in z.namelist() else {}

    def text_of(p) -> str:
        out = []
        for x in p:
            plain = "".join(t.text or "" for t in x.iter(f"{_W}t"))
            target = rels.get(x.get(f"{_R}id"), "") if x.tag == f"{_W}hyperlink" else ""
            out.append(f"[{plain}]({target})" if plain and (target or "").startswith("http") else plain)
        return "".join(out)

    value = lambda e, tag: x.get(f"{_W}val") if (x := e.find(f".//{_W}{tag}")) is not None else None
    for pos, e in enumerate(body):
        if e.tag == f"{_W}p":
            runs = [(("".join(t.text or "" for t in r.iter(f"{_W}t"))), float(value(r, "sz") or 0) / 2, r.find(f"{_W}rPr/{_W}b") is not None, (r.find(f".//{_W}rFonts").get(f"{_W}ascii") or "") if r.find(f".//{_W}rFonts") is not None else "") for r in e.iter(f"{_W}r")]
            solid = [r for r in runs if r[0].strip()]
            images = [x.get(f"{_R}embed") for x in e.iter("{http://schemas.openxmlformats.org/drawingml/2006/main}blip")]
            yield pos, "p", value(e, "pStyle") or "", text_of(e).strip(), max([0.0, *(r[1] for r in runs)]), any(r[2] for r in solid), bool(solid) and all(r[2] for r in solid), [r[3] for r in runs if r[3]], value(e, "numId"), value(e, "ilvl"), None, [rels.get(i, i) for i in images]
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in c.iter(f"{_W}p")) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            yield pos, "tbl", "", "", 0.0, False, False, [], None, None, rows, []


def _docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf.path, pdf.content, strict=True):
            try:
                rows += [(path, *x) for x in docx_features(bytes(content))]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, TypeError) as e:
                rows.append((path, -1, "error", "", f"{type(e).__name__}: {e}", 0.0, False, False, [], None, None, None, []))
        yield pd.DataFrame(rows, columns=["path", "pos", "kind", "style", "text", "max_pt", "bold", "all_bold", "fonts", "num_id", "ilvl", "rows", "images"])


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """Raw features of the paragraphs and tables of .docx files, for operators.sections; a file that can't be read is one row of kind error."""
    ddl = "path string, pos int, kind string, style string, text string, max_pt double, bold boolean, all_bold boolean, fonts array<string>, num_id string, ilvl string, rows array<array<string>>, images array<string>"
    return read_binary(spark, folder, (".docx",)).where(~F.col("path").rlike("\\(1\\)\\.docx\\z")).select("path", "content").mapInPandas(_docx, ddl)


def note_lines(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", F.posexplode(split_lines(F.col("md"))).alias("line", "text"))
