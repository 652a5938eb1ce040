"""Marginal likelihood of texts under a subword lattice.

Pieces and first scores come from an existing vocabulary file; the scores are then
re-estimated on the training texts by expectation-maximisation. A word's probability
sums over all its segmentations, by the forward recursion in log space. No piece
spans two words, so a text's lattice is a chain of its words' lattices, and its log
probability the sum over words and the end token.

A lattice alone gives frequent words too little, so training words are edges of their
own: a word that was seen c times among N of a class has (c - d) / N of its own, and
shares the discounts, d V / N, through its lattice (V: distinct words, d: n1 / (n1 + 2
n2), from the words seen once and twice). Classes are the CLASSES languages with most
training texts; a text's probability is marginal over its class, too, so the language
of the text that is scored isn't an input. lattice_score is the lattice alone.

Words are counted once; what needs a word's count or probability in a text looks the
most frequent words up in a broadcast of fixed size and joins the others.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import LOWER
from .store import Store, arrow_rows, lean, partitions, table
from .word_bpe import ABSENT, HashIndex

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
#: Most frequent words that are broadcast, of at most so many bytes each: 13 MB of text at most.
HEAD, HEAD_BYTES = 200_000, 64
ROUNDS = 2
SMOOTHING = 0.1
CELLS = 1 << 21
CLASSES = 8
SLICE_BYTES = 4 << 20
#: Words that a lattice takes at once, if they have no more than SLICE_BYTES.
WORDS, OUT_ROWS = 1 << 16, 10_000

_LOWER = LOWER.tobytes()
_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


@lru_cache(maxsize=1)
def _pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a leading space for a word's begin) and their scores in the file.

    Left out: pieces with A-Z, which lowered text never has, or with a space inside.
    Every byte that is no piece itself has its fallback piece.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            raw = sp.id_to_piece(i).replace("▁", " ").encode()
            if raw and raw == raw.translate(_LOWER) and b" " not in raw[1:]:
                found.setdefault(raw, sp.get_score(i))
    for b in range(256):
        found.setdefault(bytes([b]), min(found.values()) - 1)
    return list(found), np.array(list(found.values()))


def first_scores(path: str) -> np.ndarray:
    """Natural log probabilities of the pieces: the file's scores are ranks, read as a Zipf law."""
    scores = _pieces(path)[1]
    weight = 1 / (scores.max() - scores + 10)
    return np.log(weight / weight.sum())


def _keys(raw: np.ndarray) -> np.ndarray:
    """A hash of each row's bytes."""
    out = np.zeros(len(raw), np.uint64)
    for k in range(raw.shape[1]):
        out = out * _BASE + raw[:, k] + np.uint64(1)
    return (out * np.uint64(2) + np.uint64(1) + (np.uint64(raw.shape[1]) << np.uint64(56))).view(np.int64)


@lru_cache(maxsize=1)
def _index(path: str) -> tuple[list[int], np.ndarray, np.ndarray, HashIndex]:
    """What a Lattice needs to find pieces, whatever their scores: made once in a worker, as it takes longer than many a task's words."""
    pieces = _pieces(path)[0]
    sizes, place = np.array([len(p) for p in pieces]), {p: i for i, p in enumerate(pieces)}
    lengths = sorted(set(sizes.tolist()))
    keys = np.zeros(len(pieces), np.int64)
    for size in lengths:
        own = np.flatnonzero(sizes == size)
        keys[own] = _keys(np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).reshape(-1, size))
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(lengths), _BASE))))
    return lengths, np.array([place[bytes([b])] for b in range(256)], np.int64), powers, HashIndex(keys)


class Lattice:
    """Lattices of many words of one byte length at once."""

    def __init__(self, path: str, logp: np.ndarray):
        self.logp = np.append(logp, -np.inf)
        self.lengths, self.single, self.powers, self.index = _index(path)

    def edges(self, raw: np.ndarray) -> dict[int, np.ndarray]:
        """By piece length, the piece that ends a substring of each row at each place, or the last place of logp."""
        rows, n = raw.shape
        full = np.zeros((rows, n + 1), np.uint64)
        for k in range(n):
            full[:, k + 1] = full[:, k] * _BASE + raw[:, k] + np.uint64(1)
        none, out = len(self.logp) - 1, {1: self.single[raw]}
        for size in self.lengths:
            if 1 < size <= n:
                h = full[:, size:] - full[:, :-size] * self.powers[size]
                key = (h * np.uint64(2) + np.uint64(1) + (np.uint64(size) << np.uint64(56))).view(np.int64)
                got = self.index.index(key.ravel()).reshape(key.shape)
                if (got != ABSENT).any():
                    out[size] = np.where(got == ABSENT, none, got).astype(np.int64)
        return out

    def forward(self, edges: dict[int, np.ndarray], rows: int, n: int) -> np.ndarray:
        """Log of the summed probability of all segmentations of each prefix."""
        alpha = np.full((rows, n + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            terms = np.stack([alpha[:, j - size] + self.logp[ids[:, j - size]] for size, ids in edges.items() if size <= j])
            top = terms.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha

    def backward(self, edges: dict[int, np.ndarray], rows: int, n: int) -> np.ndarray:
        beta = np.full((rows, n + 1), -np.inf)
        beta[:, n] = 0
        for i in range(n - 1, -1, -1):
            terms = np.stack([beta[:, i + size] + self.logp[ids[:, i]] for size, ids in edges.items() if i + size <= n])
            top = terms.max(axis=0)
            beta[:, i] = top + np.log(np.exp(terms - top).sum(axis=0))
        return beta

    def blocks(self, words: list[bytes]):
        """(places, bytes) of words of equal length, each with its leading space."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            n = int(size[own[0]]) + 1 if len(own) else 1
            step = max(1, CELLS // (n * len(self.lengths)))
            for lo in range(0, len(own), step):
                at = own[lo : lo + step]
                yield at, np.frombuffer(b"".join(b" " + words[k] for k in at.tolist()), np.uint8).reshape(len(at), n)

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for at, raw in self.blocks(words):
            out[at] = self.forward(self.edges(raw), *raw.shape)[:, -1]
        return out

    def expected(self, words: list[bytes], weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over weighted words."""
        out = np.zeros(len(self.logp))
        for at, raw in self.blocks(words):
            edges = self.edges(raw)
            alpha, beta = self.forward(edges, *raw.shape), self.backward(edges, *raw.shape)
            for size, ids in edges.items():
                r, i = np.nonzero(ids < len(self.logp) - 1)
                p = ids[r, i]
                share = np.exp(alpha[r, i] + self.logp[p] + beta[r, i + size] - alpha[r, -1]) * weight[at[r]]
                out += np.bincount(p, share, len(out))
        return out[:-1]


def _words(raw: bytes | None) -> list[bytes]:
    return raw.translate(_LOWER).split() if raw else []


def _gather(batches):
    """The batches, joined to WORDS rows or more unless they have SLICE_BYTES: a lattice takes little longer for many words of a length than for few."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= WORDS or sum(b.nbytes for b in held) >= SLICE_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held and sum(b.num_rows for b in held):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def _count_words(batches):
    """Partial counts of a task by word and class; the empty word stands for the end token."""
    schema = pa.schema([("word", pa.binary()), ("class", pa.int32()), ("c", pa.int64()), ("n", pa.int64())])
    counts: dict[tuple[int, bool], Counter] = {}

    def flush():
        for (k, out), own in counts.items():
            n = np.fromiter(own.values(), np.int64, len(own))
            yield arrow_rows(schema, **{"word": list(own), "class": np.full(len(own), k, np.int32), "c": n * (not out), "n": n})
        counts.clear()

    for batch in batches:
        for doc, k, raw in zip(batch["doc_id"].to_pylist(), batch["class"].to_pylist(), _binary(batch["text"]), strict=True):
            into = counts.setdefault((k, held_out(doc)), Counter())
            into.update(_words(raw.as_py()))
            into[b""] += 1
            if sum(map(len, counts.values())) > 500_000:
                yield from flush()
    yield from flush()


def _fit(words: DataFrame, path: str, rounds: int) -> tuple[np.ndarray, float]:
    """(log probabilities of pieces, of the end token) from all training words; 32,000 sums come to the driver."""
    spark, logp, end = words.sparkSession, first_scores(path), np.log(1e-3)
    ends = words.where("word = X''").select("c").first()
    ends = ends[0] if ends else 0
    seen = words.where("c > 0 and word <> X''").select("word", "c").repartition(max(partitions(spark), 2))
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(logp)

        def run(batches, now=now):
            lattice, total = Lattice(path, now.value), np.zeros(len(now.value))
            for batch in _gather(batches):
                total += lattice.expected(batch["word"].to_pylist(), batch["c"].to_numpy().astype(float))
            used = np.flatnonzero(total)
            yield arrow_rows(pa.schema([("piece", pa.int32()), ("uses", pa.float64())]), piece=used.astype(np.int32), uses=total[used])

        uses = np.zeros(len(logp))
        for piece, x in seen.mapInArrow(lean(run), "piece int, uses double").groupBy("piece").agg(F.sum("uses")).collect():
            uses[piece] = x
        uses += SMOOTHING
        total = uses.sum() + ends + 1
        logp, end = np.log(uses / total), np.log((ends + 1) / total)
    return logp, float(end)


class _Classes:
    """Discounted word counts of each class over a lattice."""

    def __init__(self, size: list[int], kinds: list[int], once: list[int], twice: list[int], texts: list[int], end: float):
        self.n = len(size)
        self.size, self.kinds = np.array(size, float), np.array(kinds, float)
        once_, twice_ = np.array(once, float), np.array(twice, float)
        self.discount = np.where(once_ > 0, np.clip(once_ / np.maximum(once_ + 2 * twice_, 1), 0.1, 0.95), 0.5)
        self.prior = np.log10(np.array(texts, float) / max(1, sum(texts)))
        self.end = np.log10(np.array(texts, float) / self.size) if self.n else np.zeros(0)

    def logs(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 of each word's probability in each class, from its counts there and its lattice's log10."""
        with np.errstate(divide="ignore"):
            own = np.log10(np.maximum(counts - self.discount, 0))
        shared = np.log10(self.discount * self.kinds) + lattice[:, None]
        top = np.maximum(own, shared)
        return top + np.log10(10 ** (own - top) + 10 ** (shared - top)) - np.log10(self.size)


def score_texts(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS, head: int = HEAD, class_column: str = "lang", store: Store | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score) of each row of `docs` (doc_id, text, lang).

    Tokens are lowered words and one end token. base_score is an add-one word model's,
    score the model's, both log10 of the whole text's probability. Null and empty
    texts have the end token alone. Texts of held-out ids (crc32 of the id as text,
    modulo 7, is 2; a null id counts as an empty text) train neither model. Repeated
    rows are counted and scored as often as they come. No rows give no rows. Texts
    without a language, or of one beyond the CLASSES most frequent, form one class.
    """
    spark = docs.sparkSession
    store = store or Store(spark, "lattice")
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(class_column).cast("string").alias("name"))
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    names = [r[0] for r in docs.where(~out & F.col("name").isNotNull()).groupBy("name").count().orderBy(F.desc("count"), "name").limit(CLASSES).collect()]
    number = F.lit(len(names))
    for i, name in enumerate(names):
        number = F.when(F.col("name").eqNullSafe(name), i).otherwise(number)
    docs = docs.select("doc_id", "text", number.alias("class"))
    counts = [F.sum(F.when(F.col("class") == i, F.col("c")).otherwise(0)) for i in range(len(names) + 1)]
    words = docs.mapInArrow(lean(_count_words), "word binary, class int, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.array(*counts).alias("by"))
    words = store.keep(words, "words")
    ends = words.where("word = X''").select("c", "by").first() or (0, [0] * len(counts))
    cells = [[F.sum(F.col("by")[i]), F.count_if(F.col("by")[i] > 0), F.count_if(F.col("by")[i] == 1), F.count_if(F.col("by")[i] == 2)] for i in range(len(counts))]
    total, kinds, *rest = (int(x or 0) for x in words.agg(F.sum("c"), F.count_if(F.col("c") > 0), *(x for c in cells for x in c)).first())
    per = [(*rest[4 * i : 4 * i + 4], ends[1][i]) for i in range(len(counts))]
    used = [i for i, x in enumerate(per) if x[0]]
    logp, end = _fit(words, path, rounds)
    classes = _Classes(*([per[i][j] for i in used] for j in range(5)), end / np.log(10))
    known = spark.sparkContext.broadcast((logp, classes, used))

    def score_words(batches):
        logp, classes, used = known.value
        lattice = Lattice(path, logp)
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int64()), ("logp", pa.float64()), ("by", pa.list_(pa.float64()))])
        for batch in _gather(batches):
            own = lattice.word_logs(batch["word"].to_pylist()) / np.log(10)
            count = batch["by"].flatten().to_numpy().astype(float).reshape(len(own), -1)[:, used]
            by = classes.logs(count, own)
            for i in range(0, len(own), OUT_ROWS):
                part = batch.slice(i, OUT_ROWS)
                yield arrow_rows(schema, word=part["word"], c=part["c"], n=part["n"], logp=own[i : i + OUT_ROWS], by=list(by[i : i + OUT_ROWS]))

    scored = store.keep(words.where("word <> X''").repartition(max(partitions(spark), 2)).mapInArrow(lean(score_words), "word binary, c long, n long, logp double, by array<double>"), "scored")
    # Words above a count, so that `head` of them come to the driver at most: the count follows from a histogram of some hundred classes.
    able = scored.where(f"octet_length(word) <= {HEAD_BYTES}").withColumn("class", F.floor(32 * F.log2("n")))
    least, many = None, 0
    for kind, n in sorted(able.groupBy("class").count().collect(), reverse=True):
        many += n
        if many > head:
            break
        least = kind
    top = able.where(F.lit(False) if least is None else F.col("class") >= least).drop("n", "class").toArrow()
    common = spark.sparkContext.broadcast((top["word"].to_pylist(), top["c"].to_numpy(), top["logp"].to_numpy(), np.array(top["by"].to_pylist(), float).reshape(top.num_rows, len(used))))
    floor = float(np.log10(total + kinds + 1))
    end_base, end_log, end_known, k = float(np.log10(ends[0] + 1)) - floor, end / np.log(10), int(ends[0] > 0), len(used)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lattice", pa.float64()), ("by", pa.list_(pa.float64())), ("word", pa.binary())])

    def score_docs(batches):
        words, count, own, by = common.value
        place = {w: i for i, w in enumerate(words)}.get
        cell = np.column_stack((count > 0, np.log10(count + 1) - floor, own, by)) if len(words) else np.zeros((0, 3 + k))
        cell = np.vstack((cell, np.zeros(3 + k)))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, raws, lo = batch["doc_id"].to_pylist(), _binary(batch["text"]).to_pylist(), 0
            while lo < len(raws):
                hi, size = lo + 1, len(raws[lo] or b"")
                while hi < len(raws) and size + len(raws[hi] or b"") <= SLICE_BYTES:
                    size += len(raws[hi] or b"")
                    hi += 1
                split = [_words(x) for x in raws[lo:hi]]
                n = np.array([len(x) for x in split])
                flat = list(chain.from_iterable(split))
                at = np.fromiter(map(place, flat, repeat(-1)), np.int64, len(flat))
                sums, full = np.zeros((hi - lo, 3 + k)), np.flatnonzero(n)
                if len(full):
                    sums[full] = np.add.reduceat(cell[at], (np.cumsum(n) - n)[full], axis=0)
                own_rows = row + np.arange(hi - lo)
                yield arrow_rows(schema, row=own_rows, doc_id=ids[lo:hi], n_tokens=n + 1, n_known=np.rint(sums[:, 0]).astype(np.int64) + end_known, base=sums[:, 1] + end_base, lattice=sums[:, 2] + end_log, by=list(sums[:, 3:]), word=[None] * (hi - lo))
                rare = Counter(zip(np.repeat(own_rows, n)[at < 0].tolist(), (flat[i] for i in np.flatnonzero(at < 0).tolist()), strict=True))
                none = [None] * len(rare)
                yield arrow_rows(schema, row=[x for x, _ in rare], doc_id=none, n_tokens=list(rare.values()), n_known=none, base=none, lattice=none, by=none, word=[w for _, w in rare])
                row += hi - lo
                lo = hi

    found = store.keep(docs.select("doc_id", "text").mapInArrow(lean(score_docs), "row long, doc_id long, n_tokens long, n_known long, base double, lattice double, by array<double>, word binary"), "found")
    times = F.col("k")
    more = found.where("word is not null").select("row", F.col("n_tokens").alias("k"), "word").join(scored.select("word", "c", "logp", "by"), "word")
    more = more.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("known2"), F.sum(times * (F.log10(F.col("c") + 1) - F.lit(floor))).alias("base2"), F.sum(times * F.col("logp")).alias("lattice2"),
        *(F.sum(times * F.col("by")[i]).alias(f"by{i}") for i in range(k)),
    )
    both = found.where("word is null").drop("word").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    terms = [F.col("by")[i] + F.coalesce(F.col(f"by{i}"), F.lit(0.0)) + F.lit(float(classes.prior[i] + classes.end[i])) for i in range(k)]
    best = F.greatest(*terms) if k > 1 else terms[0] if k else None
    score = best + F.log10(sum((F.pow(F.lit(10.0), t - best) for t in terms), F.lit(0.0))) if k else plus("lattice", "lattice2")
    return both.select("doc_id", out.alias("held_out"), "n_tokens", plus("n_known", "known2").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "base2").alias("base_score"), score.alias("score"), plus("lattice", "lattice2").alias("lattice_score"))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_texts of all documents."""
    return score_texts(table(spark, sf_dir, "documents"))
