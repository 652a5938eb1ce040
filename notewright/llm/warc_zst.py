"""WARC archives whose records are compressed one by one with an embedded dictionary.

An archive begins with a skippable frame that holds a Zstandard dictionary built from
its own records; each record is a frame of its own after that. Executors write
archives to the shared folder by the pyarrow file system of its URI; a task that runs
again writes files of other names, and only names in the committed manifest are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store, arrow_rows, lean, partitions, table

SKIPPABLE = 0x184D2A5D
#: Bytes of records in an archive (a larger record stands alone), and of its dictionary.
ARCHIVE_BYTES, DICTIONARY_BYTES = 8 << 20, 64 << 10
MIN_REVISIT = 100
LEVEL = 3
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, first: int | None, date: str = _DATE) -> bytes:
    """A WARC/1.1 record; a revisit has no payload, but the HTTP headers of the full one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    revisit = first is not None
    block = http if revisit else http + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{first}>"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record; fails unless its lengths are right."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(warc["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from all records of an archive; from few or small ones, their beginning as raw content."""
    total = sum(map(len, records))
    if len(records) >= 16 and total >= 8 * size:
        try:
            return zstandard.train_dictionary(size, records, k=256, d=8, f=18, accel=4).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[: min(size, max(8, total // 8))]


def write_archive(records: list[bytes]) -> bytes:
    """The file: skippable frame with the dictionary, then a frame a record."""
    raw = build_dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(packer.compress, records)])


def read_archive(raw: bytes) -> Iterator[bytes]:
    magic, size = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("an archive begins with its dictionary's frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    rest = memoryview(raw)[8 + size :]
    while len(rest):
        stream = unpacker.decompressobj()
        yield stream.decompress(rest)
        if not stream.eof:
            raise ValueError("a frame ends early")
        left = len(stream.unused_data)
        rest = rest[len(rest) - left :]


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, n_bytes, digest, first) of each page; payload is null and first the response's page_id for revisits."""
    full = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), full.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"))
    twice = rows.where(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = (F.col("n_bytes") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(twice, "digest", "left").select("page_id", "url", F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"), "n_bytes", "digest", F.when(again, F.col("first")).alias("first"))


def _writer(folder: str, date: str):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        task = TaskContext.get()
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        held, size, n = [], 0, 0

        def flush():
            nonlocal held, size, n
            name = f"{base}/part-{task.partitionId():06d}-{n:05d}-{uuid.uuid4().hex}.warc.zst"
            data = write_archive(held)
            with fs.open_output_stream(name) as f:
                f.write(data)
            out = arrow_rows(schema, path=[name], records=[len(held)], bytes=[len(data)])
            held, size, n = [], 0, n + 1
            return out

        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "payload", "n_bytes", "digest", "first")), strict=True):
                held.append(record(*(x.as_py() for x in row), date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str, date: str = _DATE) -> DataFrame:
    """(path, records, bytes) of the archives that hold a record for each row of `pages` (page_id, url, html), written below the URI `folder` when it is evaluated."""
    return plan_records(pages).mapInArrow(lean(_writer(folder, date)), "path string, records long, bytes long")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the records in the archives of a manifest; digests are computed from payloads where there are."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    number = re.compile(r"<urn:x-page:(-?\d*)>")

    def ident(value: str) -> int | None:
        found = number.fullmatch(value)[1]
        return int(found) if found else None

    def run(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                with fs.open_input_stream(path) as f:
                    raw = f.read()
                out = []
                for one in read_archive(raw):
                    warc, http, payload = parse_record(one)
                    n, digest = int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha256:")
                    if warc["WARC-Type"] == "response" and (n, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
                        raise ValueError(f"a payload in {path} isn't what was written")
                    out.append((ident(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], n, digest, warc["WARC-Type"], ident(warc["WARC-Refers-To"]) if "WARC-Refers-To" in warc else None, payload if warc["WARC-Type"] == "response" else None))
                yield arrow_rows(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    parts = max(partitions(manifest.sparkSession), 2)
    return manifest.select("path").repartition(parts, "path").mapInArrow(lean(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, store: Store | None = None) -> DataFrame:
    """The records of `pages` as read back from archives written to the shared folder (see read_archives).

    A null html or url is an empty one; a page without id has a record without number.
    Rows with the smallest page_id of a payload are all responses, should it come
    twice; of a payload that only pages without id have, all are. No pages, no archives.
    """
    store = store or Store(pages.sparkSession, "warc")
    folder = f"{store.root}/archives"
    return read_archives(store.keep(write_archives(pages, folder), "manifest"), folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive_pages of all pages, without urls and payloads."""
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
  f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1),
  r AS (SELECT d.*, f.first, coalesce(f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first, false) AS again FROM d LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r"""
