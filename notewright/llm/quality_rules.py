"""Quality rules whose cutoffs limit false rejection on labelled holdouts.

Each rule compares a statistic of a text with a cutoff from a fixed grid. In each
stratum (language), a rule may cut off a number of blocks between neighbouring values
of the good texts, fixed by their number alone; it takes the strictest cutoff with
fewer good texts above. Blocks have an exact joint distribution (Wald's and Tukey's
tolerance regions; ties and the grid only make it safer), however the cutoffs were
found from the same texts: all rules together reject more than the allowed rate with
a small chance, with no correction over rules and cutoffs, only over strata that are
large enough for a block. Where there are fewer blocks than rules, the first rules
have one each; a rule without a block or a cutoff rejects nothing in that stratum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import WHITE, Words, column_bytes, slices, window_hashes
from .store import Store, arrow_rows, lean, table

#: Share of good documents of a stratum that all rules together may reject, and the chance that this fails.
ALPHA, DELTA = 0.02, 0.05
BASE_WORDS, BASE_REPEAT = 50, 50
SLICE_BYTES = 1 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules: a value that grows with badness, in Spark SQL over STATS, and its cutoffs from strict to lax.
_SHARES = [round(0.02 * 1.15**i, 6) for i in range(28)]
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [round(0.05 * 1.2**i, 6) for i in range(24)]),
    "repeats": ("n_repeat_words / n_words", _SHARES),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", _SHARES),
    "long_words": ("word_chars / n_words", [round(4.0 * 1.06**i, 6) for i in range(28)]),
    "short_words": ("n_words / greatest(word_chars, 1)", [round(0.1 * 1.06**i, 6) for i in range(28)]),
    "short_text": ("1.0 / n_words", [round(1 / n, 9) for n in range(400, 49, -10)]),
}


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text of an Arrow string column, over the whole texts; a null text has zeros."""
    data, off = column_bytes(column)
    out = {k: np.zeros(len(column), np.int64) for k in STATS}
    for lo, hi in slices(np.diff(off), SLICE_BYTES):
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        words = Words(part, at, lower=False)
        runs, bounds, whole = window_hashes(words.hashes(), 3), words.bounds.tolist(), part.tobytes()

        def total(mask: np.ndarray, at=at) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[at]
            return sums[1:] - sums[:-1]

        out["n_words"][lo:hi] = np.diff(words.bounds)
        out["word_chars"][lo:hi] = total(((part & 0xC0) != 0x80) & ~WHITE[part])
        out["n_symbols"][lo:hi] = total(_SYMBOL[part])
        for i in range(hi - lo):
            lines = [x for x in whole[at[i] : at[i + 1]].split(b"\n") if x and not x.isspace()]
            out["n_lines"][lo + i], out["n_dup_lines"][lo + i] = len(lines), len(lines) - len(set(lines))
            a, b = bounds[i], bounds[i + 1]
            if b - a > 3:
                run = runs[a : b - 2]
                order = np.argsort(run, kind="stable")
                same = run[order[1:]] == run[order[:-1]]
                if same.any():
                    twice = np.zeros(b - a + 1, np.int32)
                    hit = np.zeros(len(run), bool)
                    hit[order[1:][same]] = hit[order[:-1][same]] = True
                    np.add.at(twice, np.flatnonzero(hit), 1)
                    np.add.at(twice, np.flatnonzero(hit) + 3, -1)
                    out["n_repeat_words"][lo + i] = np.count_nonzero(np.cumsum(twice))
    return out


def upper_bound(k: int, n: int, miss: float) -> float:
    """Exact upper confidence bound of a binomial rate, seen k of n times; fails with a chance of `miss` at most."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def below(p: float) -> float:  # log of P(X <= k)
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(terms)
        return top + math.log(sum(math.exp(t - top) for t in terms))

    lo, hi = 0.0, 1.0
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) > math.log(miss) else (lo, mid)
    return hi


def blocks(n: int, alpha: float, miss: float) -> int:
    """The most order-statistic blocks that n good texts allow to cut off: their joint rate is above `alpha` with a chance of `miss` at most.

    That chance is P(X < blocks), X binomial of n and alpha.
    """
    total, done = -math.inf, 0
    while done <= n:
        term = math.lgamma(n + 1) - math.lgamma(done + 1) - math.lgamma(n - done + 1) + done * math.log(alpha) + (n - done) * math.log1p(-alpha)
        top = max(total, term)
        total = top + math.log(math.exp(total - top) + math.exp(term - top))
        if total > math.log(miss):
            break
        done += 1
    return done


def choose_cutoffs(rejected: dict[tuple[str, str], list[int]], good: dict[str, int], alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule). rejected: how many good texts lie above each of the rule's cutoffs."""
    able = dict(good)
    while small := [x for x, n in able.items() if not blocks(n, alpha, delta / len(able))]:
        del able[min(small, key=lambda x: (able[x], x))]
    share = {x: blocks(n, alpha, delta / len(able)) for x, n in able.items()}
    out = {}
    for (stratum, rule), counts in rejected.items():
        each, more = divmod(share.get(stratum, 0), len(RULES))
        own = each + (list(RULES).index(rule) < more)
        for cutoff, k in zip(RULES[rule][1], counts, strict=True):  # strict to lax: k falls
            if k < own:
                out[stratum, rule] = cutoff
                break
    return out


def _stats_of(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((k, pa.int64()) for k in STATS)])

    def run(batches):
        for batch in batches:
            yield arrow_rows(schema, doc_id=batch["doc_id"], lang=batch["lang"], **text_stats(batch["text"]))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "text").mapInArrow(lean(run), "doc_id long, lang string, " + ", ".join(f"{k} long" for k in STATS))


BASE_FAILED = f"(n_words < {BASE_WORDS} or 100 * n_repeat_words > {BASE_REPEAT} * n_words)"


def fit_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """Cutoffs from all labelled rows of `stats`; rows that fail the base rules are not looked at.

    Only counts by stratum, rule and grid cell come to the driver. A stratum too small
    for any bound to hold (under ln(1/delta) / alpha rows) is left out.
    """
    good = stats.join(labels.where("quality = 1").selectExpr("cast(doc_id as long) doc_id").distinct(), "doc_id", "left_semi").where(f"lang is not null and not {BASE_FAILED}")
    cells = [F.struct(F.lit(rule).alias("rule"), sum(F.when(F.expr(value) > c, 1).otherwise(0) for c in grid).cast("int").alias("above")) for rule, (value, grid) in RULES.items()]
    counts = good.select("lang", F.explode(F.array(*cells)).alias("x")).groupBy("lang", "x.rule", "x.above").count()
    sizes = good.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= math.log(1 / delta) / alpha)
    rejected: dict[tuple[str, str], list[int]] = {}
    totals: dict[str, int] = {}
    for lang, rule, above, k, n in counts.join(sizes, "lang").select("lang", "rule", "above", "count", "n").toLocalIterator():
        totals[lang] = n
        row = rejected.setdefault((lang, rule), [0] * len(RULES[rule][1]))
        for i in range(above):
            row[i] += k
    return choose_cutoffs(rejected, totals, alpha, delta)


def _verdict(cutoffs: dict[tuple[str, str], float]) -> F.Column:
    """Kept by the base rules and by every rule's cutoff of the row's stratum."""
    bad = F.expr(BASE_FAILED)
    for rule, (value, _) in RULES.items():
        if own := {lang: c for (lang, r), c in cutoffs.items() if r == rule}:
            cutoff = F.create_map(*(F.lit(x) for kv in sorted(own.items()) for x in kv))
            bad = bad | F.coalesce(F.expr(value) > cutoff[F.col("lang")], F.lit(False))
    return ~bad


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, store: Store | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row of `docs` (doc_id, text, lang).

    Null and empty texts have no words and fail the base rules. Rows without a
    language, or of one with too few labels, are judged by the base rules alone.
    Repeated rows each give a row; an empty table gives none. Labels other than
    quality 1, and nulls, count for nothing; several for one document count once.
    """
    store = store or Store(docs.sparkSession, "quality")
    stats = store.keep(_stats_of(docs), "stats")
    cutoffs = fit_cutoffs(stats, labels, alpha, delta)
    return stats.select("doc_id", *STATS[:5], F.expr(BASE_FAILED).alias("base_failed"), _verdict(cutoffs).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, store: Store | None = None) -> DataFrame:
    """The rows of `docs`, all columns, that quality_rules keeps. The texts are read twice and never shuffled."""
    store = store or Store(docs.sparkSession, "quality")
    cutoffs = fit_cutoffs(store.keep(_stats_of(docs), "stats"), labels, alpha, delta)

    def run(batches):
        for batch in batches:
            s = text_stats(batch["text"])
            n = np.maximum(s["n_words"], 1)
            value = {"symbols": s["n_symbols"] / n, "repeats": s["n_repeat_words"] / n, "dup_lines": s["n_dup_lines"] / np.maximum(s["n_lines"], 1), "long_words": s["word_chars"] / n, "short_words": s["n_words"] / np.maximum(s["word_chars"], 1), "short_text": 1.0 / n}
            bad = (s["n_words"] < BASE_WORDS) | (100 * s["n_repeat_words"] > BASE_REPEAT * s["n_words"])
            lang = np.array(batch["lang"].cast(pa.string()).to_pylist(), object)  # null is no stratum, "" is one
            for (stratum, rule), cutoff in cutoffs.items():
                bad |= (lang == stratum) & (value[rule] > cutoff)
            yield batch.filter(pa.array(~bad))

    return docs.mapInArrow(lean(run), docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules of all documents by all labels."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
