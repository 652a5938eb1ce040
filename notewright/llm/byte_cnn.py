"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; filters run over overlapping chunks (CHUNK bytes,
a chunk every STRIDE) that cover the whole text. Each filter's largest value over all
chunks of the text, and its mean, go into one logistic unit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import column_bytes, slices
from .store import arrow_rows, lean, table

CHUNK, STRIDE, EMBED, FILTERS = 16, 8, 8, 32
FOLDS = 5
THRESHOLD = 0.3
#: The bounded sample to train on: so many labelled texts of both labels together at most, of so many bytes together at most.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 12_000_000
STEPS, EPOCHS, BATCH, RATE, DECAY = 800, 25, 32, 3e-3, 0.02
SLICE_BYTES = 1 << 20


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


class ByteCnn:
    """Parameters, forward and backward pass. Byte 256 pads a text's last chunk."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32), "filter": rng.normal(0, (CHUNK * EMBED) ** -0.5, (CHUNK * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32), "out": np.zeros(2 * FILTERS, np.float32), "base": np.zeros(1, np.float32),
        }
        self.p["embed"][256] = 0

    @staticmethod
    def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of each chunk, first chunk of each text). A text has one chunk at least."""
        size = np.diff(offsets)
        count = np.maximum(1, -(-(size - CHUNK) // STRIDE) + 1)
        first = np.concatenate(([0], np.cumsum(count)))
        text = np.repeat(np.arange(len(size)), count)
        start = (np.arange(first[-1]) - first[text]) * STRIDE
        place = start[:, None] + np.arange(CHUNK)
        inside = place < size[text][:, None]
        where = np.minimum(place + offsets[text][:, None], max(len(data) - 1, 0))
        return np.where(inside, data[where] if len(data) else 0, 256).astype(np.int16), first

    def features(self, chunk: np.ndarray, first: np.ndarray):
        x = self.p["embed"][chunk].reshape(len(chunk), -1)
        h = np.maximum(x @ self.p["filter"] + self.p["bias"], 0)
        top = np.maximum.reduceat(h, first[:-1], axis=0)
        mean = np.add.reduceat(h, first[:-1], axis=0) / np.diff(first)[:, None]
        return x, h, np.concatenate((top, mean), axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each text; the whole text is read."""
        out = np.zeros(len(offsets) - 1)
        for lo, hi in slices(np.diff(offsets), SLICE_BYTES):
            if offsets[hi] - offsets[lo] > 2 * SLICE_BYTES:  # one long text: its chunks in runs
                out[lo] = self._long(data[offsets[lo] : offsets[hi]])
            else:
                out[lo:hi] = self.features(*self.chunks(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))[2] @ self.p["out"] + self.p["base"][0]
        return 1 / (1 + np.exp(-out))

    def _long(self, data: np.ndarray) -> float:
        total = max(1, -(-(len(data) - CHUNK) // STRIDE) + 1)
        top, mass, step = np.zeros(FILTERS), np.zeros(FILTERS), SLICE_BYTES // STRIDE
        for lo in range(0, total, step):
            n = min(step, total - lo)
            part = data[lo * STRIDE : (lo + n - 1) * STRIDE + CHUNK]
            feature = self.features(*self.chunks(part, np.array([0, len(part)])))[2][0]
            top, mass = np.maximum(top, feature[:FILTERS]), mass + feature[FILTERS:] * n
        return float(np.concatenate((top, mass / total)) @ self.p["out"] + self.p["base"][0])

    def gradient(self, chunk: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        x, h, f = self.features(chunk, first)
        p = 1 / (1 + np.exp(-(f @ self.p["out"] + self.p["base"][0])))
        d = ((p - label) / len(label)).astype(np.float32)
        df = d[:, None] * self.p["out"]
        count = np.diff(first)
        text = np.repeat(np.arange(len(count)), count)
        best = h == np.repeat(f[:, :FILTERS], count, axis=0)
        best &= h > 0
        ties = np.maximum(np.add.reduceat(best, first[:-1], axis=0, dtype=np.int32), 1)
        dh = (best * (df[:, :FILTERS] / ties)[text] + (df[:, FILTERS:] / count[:, None])[text] * (h > 0)).astype(np.float32)
        dx = (dh @ self.p["filter"].T).reshape(-1, EMBED)
        flat = chunk.ravel()
        embed = np.stack([np.bincount(flat, dx[:, k], 257) for k in range(EMBED)], axis=1).astype(np.float32)
        embed[256] = 0
        return {"embed": embed, "filter": x.T @ dh, "bias": dh.sum(axis=0), "out": f.T @ d, "base": d.sum(keepdims=True)}

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 7) -> None:
        """Adam on the mean log loss, with decay of the weights."""
        rng, m, v, order = np.random.default_rng(seed), {}, {}, np.zeros(0, np.int64)
        steps = min(STEPS, -(-EPOCHS * len(texts) // BATCH))
        for t in range(1, steps + 1):
            if len(order) < BATCH:
                order = np.concatenate((order, rng.permutation(len(texts))))
            own, order = order[:BATCH].tolist(), order[BATCH:]
            rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
            data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
            g = self.gradient(*self.chunks(data, np.concatenate(([0], np.cumsum([len(texts[i]) for i in own])))), labels[own].astype(np.float32))
            for k, x in g.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                v[k] = 0.999 * v.get(k, 0) + 0.001 * x * x
                self.p[k] *= 1 - rate * DECAY * (k in ("filter", "out"))
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> ByteCnn:
    """A network fitted on a bounded sample of labelled texts that aren't held out.

    The sample takes, of either label, the rows with the smallest hashes of their ids;
    about `rows` in all, and as many of those as `most_bytes` hold; texts of over an
    eighth of that only get scored. Conflicting labels
    of one document and labels other than 0 and 1 aren't used. Without examples of
    both labels the network says the share of label 1, or 0.5.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 0").orderBy(*order).limit(rows // 2).unionAll(known.where("y = 1").orderBy(*order).limit(rows - rows // 2)).select("doc_id", "y")
    share = float(known.agg(F.avg("y")).first()[0] or 0.5)
    texts, ys, used = [], [], 0
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw")).where(F.octet_length("raw") <= most_bytes // 8).join(F.broadcast(chosen), "doc_id")
    sample = got.orderBy(F.xxhash64("doc_id"), "raw").limit(rows).toArrow()
    for raw, y in zip(sample["raw"], sample["y"].to_pylist(), strict=True):
        if used + len(raw.as_buffer()) <= most_bytes:
            texts.append(raw.as_py())
            ys.append(y)
            used += len(texts[-1])
    net, y = ByteCnn(), np.array(ys)
    if len(set(ys)) == 2:
        net.fit(texts, y)
        # The sample holds the labels in other shares than the corpus does.
        net.p["base"] += np.float32(np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(y.mean() / (1 - y.mean())))
    else:
        net.p["base"] += np.float32(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return net


def score_quality(docs: DataFrame, net: ByteCnn, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs` (doc_id, text). Null and empty texts are one chunk of padding; repeated rows score alike."""
    model = docs.sparkSession.sparkContext.broadcast(net.p)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        own = ByteCnn()
        own.p = model.value
        for batch in batches:
            score = own.score(*column_bytes(batch["text"]))
            yield arrow_rows(schema, doc_id=batch["doc_id"], held_out=[held_out(i) for i in batch["doc_id"].to_pylist()], score=score, predicted=(score >= threshold).astype(np.int32))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_quality of all documents by a network that train() fits."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
