"""Removal of every repeated 200-byte string, with bucket-pointer refinement.

Windows of SPAN bytes that are equal have the same minimal GRAM hash, their anchor.
Runs of windows with one anchor travel as one entry, so a text sends an entry for
about 85 bytes. Entries with equal contents repeat as a whole and need no sorting;
what remains are anchors with several contents, where copies begin, end or differ.
The windows of those are ordered by bucket-pointer refinement: buckets of equal
q-grams, refined by sorting on the bucket pointers of later offsets, each round
reusing the pointers that the one before has set.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import U64, column_bytes, mix
from .store import Store, arrow_rows, bloom_joins, lean, partitions, table

SPAN, GRAM = 200, 32
SEGMENT = 1 << 19
BUCKET_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
CUT_ROWS = 4000
_BASE = 0xD1342543DE82EF95
_PLACE = U64((1 << 22) - 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64."""
    global _cache
    if len(_cache[0]) < n:
        size = 1 << n.bit_length()
        _cache = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, U64), np.full(size - 1, x, U64)))) for x in (U64(_BASE), U64(pow(_BASE, -1, 1 << 64))))
    return _cache[0][:n], _cache[1][:n]


_cache = (np.ones(0, U64), np.ones(0, U64))


def entries(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(text, first window, windows, anchor, content hash) of each run of windows with one anchor; texts are ranges of `data`."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none.view(U64), none.view(U64)
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[:n], out=sums[1:])
    value = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = (value & ~_PLACE) | np.arange(len(value), dtype=U64)
    width, have = span - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    anchor = (low & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - span + 1]
    valid = np.arange(n - span + 1) + span <= offsets[1:][text]
    start = np.flatnonzero(valid & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1])))
    last = np.flatnonzero(valid & np.concatenate(((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[1:], [True])))
    size = last - start + 1
    content = mix((sums[last + span] - sums[start]) * inverse[start] + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    return text[start], start, size, value[anchor[start]], content


def refine(data: np.ndarray, starts: np.ndarray, span: int = SPAN, q: int = 8) -> np.ndarray:
    """A number for each start; two are equal if and only if the `span` bytes from there are.

    Buckets first hold positions with equal q-grams. In each round, the buckets of
    more than one position are sorted on the pointers of the positions `depth` later,
    and split where those differ; the split buckets' pointers serve the next round, so
    the depth doubles. Positions alone in their bucket are never moved again.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(span + q, np.uint8)))
    word = np.zeros(n, U64)
    for k in range(q):
        word = word << U64(8) | padded[k : k + n]
    order = np.argsort(word, kind="stable")
    pointer = np.zeros(n + span, np.int64)
    _point(pointer, order, word[order])
    depth = q
    while depth < span:
        step = min(depth, span - depth)  # the last round overlaps the depth known already
        first = pointer[order]
        inner = np.concatenate((first[1:] == first[:-1], [False]))
        active = order[inner | np.concatenate(([False], inner[:-1]))]
        if not len(active):
            break
        own, later = pointer[active], pointer[active + step]
        by = np.lexsort((later, own))
        active, own, later = active[by], own[by], later[by]
        # A bucket's pointer is its last place; a part of it gets the last place of its own.
        group = np.flatnonzero(np.concatenate(((own[1:] != own[:-1]) | (later[1:] != later[:-1]), [True])))
        ends = np.flatnonzero(np.concatenate((own[1:] != own[:-1], [True])))
        after = ends[np.searchsorted(ends, group)] - group
        fresh = own[group] - after
        pointer[active] = np.repeat(fresh, np.diff(np.concatenate(([-1], group))))
        order = active
        depth += step
    return pointer[starts]


def _point(pointer: np.ndarray, order: np.ndarray, key: np.ndarray) -> None:
    last = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True])))
    pointer[order] = np.repeat(last, np.diff(np.concatenate(([-1], last))))


_SPANS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
_SPANS_DDL = "key long, start long, end long, anchor long, content long, bucket int, data binary"


def _segments(batch: pa.RecordBatch):
    """(keys, offsets in the text, bytes, ranges) of runs of texts of about SEGMENT bytes; longer texts are cut with an overlap."""
    data, off = column_bytes(batch["text"])
    keys = batch["key"].to_numpy()
    own, base, cuts, size = [], [], [], 0
    for i in np.flatnonzero(np.diff(off) >= SPAN).tolist():
        for lo in range(0, int(off[i + 1] - off[i]) - SPAN + 1, SEGMENT):
            a, b = int(off[i]) + lo, min(int(off[i]) + lo + SEGMENT + SPAN - 1, int(off[i + 1]))
            own.append(keys[i])
            base.append(lo)
            cuts.append((a, b))
            size += b - a
            if size >= SEGMENT:
                yield _joined(own, base, cuts, data)
                own, base, cuts, size = [], [], [], 0
    if own:
        yield _joined(own, base, cuts, data)


def _joined(own, base, cuts, data):
    return np.array(own, np.int64), np.array(base, np.int64), np.concatenate([data[a:b] for a, b in cuts]), np.concatenate(([0], np.cumsum([b - a for a, b in cuts])))


def _rows(**given) -> pa.RecordBatch:
    n = len(next(iter(given.values())))
    return arrow_rows(_SPANS, **{f.name: given.get(f.name, [None] * n) for f in _SPANS})


def _scan(buckets: int):
    """Spans that repeat within a run of texts, and packed entries by bucket: of equal contents one, counted as two."""

    def run(batches):
        for batch in batches:
            for keys, base, data, off in _segments(batch):
                text, start, size, anchor, content = entries(data, off)
                order = np.lexsort((content, anchor))
                text, start, size, anchor, content = (x[order] for x in (text, start, size, anchor, content))
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])))
                many = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1] > 1
                key, at = keys[text], start - off[text] + base[text]
                yield _rows(key=key[many], start=at[many], end=(at + size + SPAN - 1)[many])
                key, at, size, anchor, content = (x[new] for x in (key, at, size, anchor, content))
                count = np.where(many[new], 2, 1).astype(np.int32)
                bucket = (anchor % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
                blobs = [b"".join(x[order[a:b]].astype(t).tobytes() for x, t in ((anchor, "<u8"), (content, "<u8"), (key, "<i8"), (at, "<i8"), (size, "<i4"), (count, "<i4"))) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield _rows(bucket=bucket[order][edge[:-1]], data=blobs)

    return run


def _meet(batches):
    """Of a partition's buckets: spans of whole entries that repeat, and entries whose windows must be compared (with their anchor)."""
    parts = []
    for batch in batches:
        for blob in batch["data"]:
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            k = len(raw) // 40
            parts.append(tuple(raw[a * k : b * k].view(t) for a, b, t in ((0, 8, U64), (8, 16, U64), (16, 24, np.int64), (24, 32, np.int64), (32, 36, np.int32), (36, 40, np.int32))))
    if not parts:
        return
    anchor, content, key, at, size, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((content, anchor))
    anchor, content, key, at, size, count = (x[order] for x in (anchor, content, key, at, size, count))
    new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new = new_anchor | np.concatenate(([True], content[1:] != content[:-1]))
    own = np.cumsum(new) - 1
    total = np.bincount(own, count)
    kinds = np.bincount(np.cumsum(new_anchor) - 1, new)[np.cumsum(new_anchor) - 1]
    whole = (total[own] > 1) & (count == 1)
    compare = new & (kinds > 1)
    # Anchors with no content that came once are settled.
    group = np.cumsum(new_anchor) - 1
    single = np.bincount(group, total[own] == 1)[group] > 0
    compare &= single
    end = at + size + SPAN - 1
    for mask, more in ((whole, {}), (compare, {"anchor": anchor.view(np.int64), "content": np.minimum(total[own], 2).astype(np.int64)})):
        i = np.flatnonzero(mask)
        for lo in range(0, len(i), 100_000):
            j = i[lo : lo + 100_000]
            yield _rows(key=key[j], start=at[j], end=end[j], **{k: v[j] for k, v in more.items()})


def _compare(batches):
    """Rows come ordered by anchor: windows that come twice, as spans of the entries that came once."""
    held: list[tuple] = []
    size, last = 0, None

    def settle():
        data = np.frombuffer(b"".join(x[4] for x in held), np.uint8)
        length = np.array([len(x[4]) for x in held])
        begin = np.cumsum(length) - length
        windows = length - SPAN + 1
        entry = np.repeat(np.arange(len(held)), windows)
        inner = np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
        number = refine(data, begin[entry] + inner)
        weight = np.array([x[3] for x in held])[entry]
        hit = (np.bincount(number, weight)[number] > 1) & (weight == 1)
        run = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (entry[1:] != entry[:-1]))))
        stop = np.flatnonzero(hit & np.concatenate((~hit[1:] | (entry[1:] != entry[:-1]), [True])))
        start = np.array([x[2] for x in held])[entry]
        yield _rows(key=[held[i][1] for i in entry[run].tolist()], start=start[run] + inner[run], end=start[stop] + inner[stop] + SPAN)
        held.clear()

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("anchor", "key", "start", "count", "data")), strict=True):
            if size >= CHUNK_BYTES and row[0] != last:
                yield from settle()
                size = 0
            held.append(row)
            size, last = size + len(row[4]), row[0]
    if held:
        yield from settle()


def _cut(batches):
    schema = pa.schema([("key", pa.int64()), ("anchor", pa.int64()), ("start", pa.int64()), ("count", pa.int64()), ("data", pa.binary())])
    for batch in batches:
        out = []
        for raw, key, wanted in zip(batch["text"].cast(pa.large_binary() if pa.types.is_large_string(batch["text"].type) else pa.binary()), batch["key"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            view = memoryview(raw.as_buffer())
            for w in wanted:
                out.append((key, w["anchor"], w["start"], w["content"], bytes(view[w["start"] : w["end"]])))
                if len(out) == CUT_ROWS:
                    yield arrow_rows(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
                    out = []
        if out:
            yield arrow_rows(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def repeated_spans(docs: DataFrame, store: Store) -> DataFrame:
    """(key, spans) of the keyed texts `docs` (key, text) that have repeated bytes; spans may overlap."""
    spark = docs.sparkSession
    mass = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(partitions(spark), -(-int(mass) // BUCKET_BYTES))
    scan = store.keep(docs.mapInArrow(lean(_scan(4 * parts)), _SPANS_DDL), "scan")
    met = store.keep(scan.where("bucket is not null").repartition(parts, "bucket").mapInArrow(lean(_meet), _SPANS_DDL), "met")
    open_ = met.where("anchor is not null").groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "end", "content")).alias("wanted"))
    open_ = store.keep(open_, "open").where("size(wanted) > 0")
    with bloom_joins(spark):
        cut = docs.where("text is not null").join(open_, "key").mapInArrow(lean(_cut), "key long, anchor long, start long, count long, data binary")
        dealt = cut.repartition(parts, "anchor").sortWithinPartitions("anchor", "key", "start")
        fine = store.keep(dealt.mapInArrow(lean(_compare), _SPANS_DDL), "compared")
    all_ = scan.where("bucket is null").select("key", "start", "end").unionAll(met.where("anchor is null").select("key", "start", "end")).unionAll(fine.select("key", "start", "end"))
    return all_.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of id and text: rows that agree in both have equal spans, too."""
    return docs.withColumn("key", F.xxhash64(F.col("doc_id"), F.col("text")))


def dedup_bytes(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of `docs` (doc_id, text).

    Each byte covered by a SPAN-byte string that starts elsewhere, too, is removed;
    kept is the rest of the UTF-8 bytes. Null and empty texts have no bytes. Rows that
    agree in id and text repeat each other. An empty table gives an empty result.
    """
    store = store or Store(docs.sparkSession, "suffix")
    docs = _keyed(docs.selectExpr("cast(doc_id as long) doc_id", "text"))
    spans = repeated_spans(docs, store)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            raws = batch["text"].cast(pa.large_binary() if pa.types.is_large_string(batch["text"].type) else pa.binary())
            for doc, raw, own in zip(batch["doc_id"].to_pylist(), raws, batch["spans"].to_pylist(), strict=True):
                raw, cut = raw.as_py() or b"", _merge(own)
                kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(raw)], strict=True)) if cut else raw
                out.append((doc, len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            for lo in range(0, len(out), 2000):
                yield arrow_rows(schema, **dict(zip(schema.names, zip(*out[lo : lo + 2000], strict=True), strict=True)))

    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_bytes of all documents, without the bytes kept."""
    return dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")
