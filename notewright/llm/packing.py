"""Best-fit packing after Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so an instance of any size is a histogram
of at most `capacity` counts. The driver solves that histogram: whole classes of
equal pieces are fixed at once where a small set provably dominates, the rest goes
best-fit decreasing. The plan is a list of bin patterns with multiplicities; each
piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Store, arrow_rows, lean, small_batches, table
from .word_bpe import WordBpe, WordCache

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
SLICE_BYTES = 2 << 20
BATCH_ROWS = 1000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


class _Lengths:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, many: int) -> None:
        self.n[length] -= many
        if not self.n[length]:
            del self.n[length]
            self.order.pop(bisect.bisect_left(self.order, length))

    def largest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.order, most)
        return self.order[i - 1] if i else None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[Counter, dict[int, int]]:
    """(bins fixed, counts left). A fixed bin dominates every other feasible set with its largest piece.

    For a largest piece j: alone if nothing fits beside it; with a piece that fills
    the bin exactly; with the largest piece that fits if no two others fit together;
    and if at most two fit, with the largest single if that is no smaller than the
    largest pair, or with that pair if its smaller piece is no smaller than any
    single piece that fits.
    """
    left, fixed = _Lengths(counts), Counter()
    for j in sorted(counts, reverse=True):
        while n := left.n.get(j, 0):
            room = capacity - j
            left.take(j, n)
            best = left.largest(room) if n == 1 or room < j else max(left.largest(room) or 0, j)
            if best is None:
                fixed[(j,)] += n
                break
            if best == j:  # only where its own kind fills the room best
                if 2 * j == capacity:
                    fixed[(j, j)] += n // 2
                    n %= 2
                    if n:
                        left.n[j] = 1
                        bisect.insort(left.order, j)
                        continue
                    break
                _put_back(left, j, n)
                break
            if best == room:
                many = min(n, left.n[best])
                left.take(best, many)
                fixed[(j, best)] += many
                if n > many:
                    _put_back(left, j, n - many)
                continue
            small = _two_smallest(left, j, n - 1)
            if small is None or sum(small) > room:  # one piece at most fits
                many = min(n, left.n[best])
                left.take(best, many)
                fixed[(j, best)] += many
                if n > many:
                    _put_back(left, j, n - many)
                continue
            _put_back(left, j, n)
            if 3 * small[0] > room:  # two pieces at most fit
                pair = _largest_pair(left, j, room)
                if pair and best >= sum(pair):
                    left.take(j, 1)
                    left.take(best, 1)
                    fixed[(j, best)] += 1
                    continue
                if pair and pair[1] >= best and left.n.get(pair[0], 0) >= 1 + (pair[0] == pair[1]):
                    left.take(j, 1)
                    left.take(pair[0], 1)
                    left.take(pair[1], 1)
                    fixed[(j, *pair)] += 1
                    continue
            break
    return fixed, left.n


def _put_back(left: _Lengths, length: int, many: int) -> None:
    if length not in left.n:
        bisect.insort(left.order, length)
        left.n[length] = 0
    left.n[length] += many


def _two_smallest(left: _Lengths, j: int, more: int) -> tuple[int, int] | None:
    """The two smallest pieces left, `more` of length j among them."""
    found = []
    for k in [*left.order[:2], *([j] if more else [])]:
        found += [k] * min(2, left.n.get(k, 0) + (more if k == j else 0))
    found.sort()
    return (found[0], found[1]) if len(found) > 1 else None


def _largest_pair(left: _Lengths, j: int, room: int) -> tuple[int, int] | None:
    """The two pieces (larger first), other than one of length j, with the largest sum that fits."""
    spare = lambda k: left.n[k] - (k == j)
    order = [k for k in left.order if spare(k)]
    best, a, b = None, 0, len(order) - 1
    while a <= b:
        if order[a] + order[b] > room or (a == b and spare(order[a]) < 2):
            b -= 1
            continue
        if best is None or order[a] + order[b] > sum(best):
            best = (order[b], order[a])
        a += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over classes of equal pieces and of bins with equal contents."""
    rooms: dict[int, Counter] = {}
    order: list[int] = []

    def add(room: int, bin_: tuple[int, ...], many: int) -> None:
        if room not in rooms:
            rooms[room] = Counter()
            bisect.insort(order, room)
        rooms[room][bin_] += many

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    add(capacity - each * length, (length,) * each, full)
                if rest:
                    add(capacity - rest * length, (length,) * rest, 1)
                break
            room = order[i]
            for bin_ in sorted(rooms[room]):
                many = min(left, rooms[room][bin_])
                rooms[room][bin_] -= many
                if not rooms[room][bin_]:
                    del rooms[room][bin_]
                add(room - length, (*bin_, length), many)
                left -= many
                if not left:
                    break
            if not rooms[room]:
                del rooms[room]
                order.pop(bisect.bisect_left(order, room))
    return sum(rooms.values(), Counter())


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Bins (tuples of lengths) with multiplicities that hold exactly the pieces counted."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """Where the r-th piece of a length goes: arrays by (length, first rank)."""

    def __init__(self, bins: Counter):
        rows, base, seen = [], 0, Counter()
        for bin_, many in sorted(bins.items(), reverse=True):
            at = 0
            for length, k in sorted(Counter(bin_).items(), reverse=True):
                rows.append((length, seen[length], k, base, at))
                seen[length] += k * many
                at += k * length
            base += many
        rows.sort()
        self.n_bins = base
        self.length, self.first, self.each, self.base, self.at = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset)."""
        big = np.int64(1) << 48
        i = np.searchsorted(self.length * big + self.first, length * big + rank, side="right") - 1
        k = rank - self.first[i]
        return self.base[i] + k // self.each[i], self.at[i] + k % self.each[i] * length


def _tokenize(path: str, capacity: int):
    def run(batches):
        cache, part, seen = WordCache(WordBpe(path)), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, raw = batch["doc_id"].to_pylist(), [x or b"" for x in batch["text"].cast(pa.large_binary() if pa.types.is_large_string(batch["text"].type) else pa.binary()).to_pylist()]
            lo = 0
            while lo < len(raw):
                hi, total = lo + 1, len(raw[lo])
                while hi < len(raw) and total + len(raw[hi]) <= SLICE_BYTES:
                    total += len(raw[hi])
                    hi += 1
                rows = []
                for doc, got in zip(ids[lo:hi], cache.encode(raw[lo:hi]), strict=True):
                    flow = np.append(got, END_ID).astype("<u4")
                    for piece, start in enumerate(range(0, len(flow), capacity)):
                        own = flow[start : start + capacity]
                        rows.append((doc, piece, start, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)])))
                        seen[len(own)] += 1
                yield arrow_rows(_PIECES, **dict(zip(_PIECES.names, zip(*rows, strict=True), strict=True)))
                lo = hi

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, store: Store | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each row of `docs` (doc_id, text).

    A row's ids are its tokens and END_ID; only longer ones are cut, at multiples of
    `capacity`. A null or empty text is one piece, END_ID. Repeated rows and rows
    without doc_id each have their pieces. Sequences overlap nowhere, have no gaps
    and are numbered from 0. An empty table gives an empty result.

    Pieces are written once with their rank within task and length; the ranks within
    a length follow from sums over tasks. A length that very many pieces have is
    counted and placed in as many tasks as wrote it.
    """
    spark = docs.sparkSession
    store = store or Store(spark, "packing")
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    with small_batches(spark, BATCH_ROWS):
        pieces = store.keep(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(_tokenize(path, capacity)), _PIECES_DDL), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    own = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"))
    plan = spark.sparkContext.broadcast(Places(plan_bins(dict(pieces.groupBy("length").count().collect()), capacity)))
    schema = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for batch in batches:
            at = plan.value.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in schema.names[:5]), *map(pa.array, at)], schema=schema)

    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack of all documents."""
    return pack(table(spark, sf_dir, "documents"))
