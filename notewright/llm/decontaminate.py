"""Benchmark decontamination with an Aho-Corasick automaton over normalised items.

Items are cut into windows of WINDOW words. Each distinct item word is one letter
of the automaton's alphabet, so a window is a pattern of as many letters and a
document is read once, a letter a word; a match's end is a word's index, from which
offsets in the original text follow.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .store import arrow_rows, lean, table

WINDOW = 10
#: An automaton holds about so many windows and words; further items go to further automata, loaded one at a time.
BLOCK_WINDOWS, BLOCK_WORDS = 200_000, 500_000

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
SCAN_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


def words(raw: bytes | None) -> list[bytes]:
    """Normalised words of UTF-8 bytes: A-Z lowered, other ASCII but digits and letters separates."""
    return raw.translate(_TABLE).split() if raw else []


class _Automaton:
    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.letters: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, ws in items:
            for w in ws:
                if w not in self.letters:
                    n = len(self.letters) + 1
                    self.letters[w] = chr(n if n < 0xD800 else n + 0x800)
            text = "".join(map(self.letters.__getitem__, ws))
            for i in range(max(1, len(text) - window + 1)):
                owners.setdefault(text[i : i + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, who in owners.items():
            self.automaton.add_word(pattern, (len(pattern), frozenset(who)))
        self.automaton.make_automaton()

    def find(self, ws: list[bytes], hit: np.ndarray, found: set[str]) -> None:
        for end, (n, who) in self.automaton.iter("".join(map(self.letters.get, ws, repeat("\0")))):
            hit[end + 1 - n : end + 1] = True
            found |= who


def _blocks(spark: SparkSession, items: DataFrame, window: int) -> list:
    """Broadcasts of items; the driver holds one block at a time."""
    out, block, n_windows, n_words = [], [], 0, 0
    for item, text in items.selectExpr("cast(item_id as string)", "text").where("item_id is not null and text is not null").toLocalIterator():
        if ws := words(text.encode()):
            block.append((item, ws))
            n_windows, n_words = n_windows + max(1, len(ws) - window + 1), n_words + len(ws)
            if n_windows >= BLOCK_WINDOWS or n_words >= BLOCK_WORDS:
                out.append(spark.sparkContext.broadcast(block))
                block, n_windows, n_words = [], 0, 0
    return [*out, spark.sparkContext.broadcast(block)] if block else out


def _scanner(blocks: list, window: int):
    """A function of one Arrow batch: (words of each text, hit words, items found)."""
    last: list = [None, None]

    def automaton(i: int) -> _Automaton:
        if last[0] != i:
            last[:] = None, None
            last[:] = i, _Automaton(blocks[i].value, window)
        return last[1]

    def scan(column: pa.Array) -> list[tuple[int, np.ndarray, set[str]]]:
        texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        out = []
        for i in range(max(1, len(blocks))):
            found_by = automaton(i) if blocks else None
            for k, raw in enumerate(texts):
                ws = words(raw.as_py())
                if not i:
                    out.append((len(ws), np.zeros(len(ws), bool), set()))
                if found_by and ws:
                    found_by.find(ws, out[k][1], out[k][2])
        return out

    return scan


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Character ranges of the original text from the first to the last word of each run of hit words."""
    at = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of each row of `docs` (doc_id, text).

    `items` has item_id and text; an item of fewer words than `window` is one window.
    spans are ranges of characters of the original text. Null and empty texts have no
    words and are clean. Items without id, text or words are never found. Rows of one
    item_id are one item; repeated documents each give a row. No items: all is clean.
    """
    blocks = _blocks(docs.sparkSession, items, window)

    def run(batches):
        scan = _scanner(blocks, window)
        for batch in batches:
            got, texts = scan(batch["text"]), batch["text"]
            hits = [int(h.sum()) for _, h, _ in got]
            yield arrow_rows(
                _SCHEMA, doc_id=batch["doc_id"], n_words=[n for n, _, _ in got], n_hit=hits, n_items=[len(f) for _, _, f in got],
                items_sha256=[hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for _, _, f in got], contaminated=[n > 0 for n in hits],
                spans=[_spans(texts[i].as_py(), got[i][1]) if n else [] for i, n in enumerate(hits)],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), SCAN_DDL)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no window of an item; null texts stay."""
    blocks = _blocks(docs.sparkSession, items, window)

    def run(batches):
        scan = _scanner(blocks, window)
        for batch in batches:
            yield batch.filter(pa.array([not h.any() for _, h, _ in scan(batch["text"])], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_contamination of all documents by all benchmark items."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
