"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. Similar ones are put into groups around a
pivot; the matrix holds, for each token, the groups whose token union has it. A
query document's tokens are counted against the matrix, which bounds its overlap
with every member of a group; only groups that can hold a partner are opened.

Tokens have one global order: by hash, but those known to be frequent come last, the
most frequent at the very end. Two sets of n >= m tokens that link share 3 (n + m) / 7
of them or more, so they share one of their first n - 3 (n + m) / 7 + 1 and m - 3 (n +
m) / 7 + 1 tokens in that order (for n = m a seventh of them). What many documents
share therefore counts for little unless a document consists of hardly anything else.

Steps, all linear in the input but for pairs that pass the bounds:

1. One scan gives each document's set size and fingerprint, so equal sets count
   once, and tokens that come often within a task. MAX_HOT of them are broadcast at
   most; which ones those are affects cost alone.
2. A second scan sends the beginning of each set (EXTENT of it where tokens aren't
   frequent, else what the bound above needs) to buckets by token, packed in numpy
   arrays. Frequent tokens are dealt over all buckets. Tokens of one set go. A token's
   `cap` is the size of the largest partner for which it stands early enough.
3. Each token's pivot is the set with the fewest rare tokens, as an original is among
   its edited copies; each set joins the pivot that it shares most tokens with, if they
   really link. That is the partition into groups.
4. Matrix rows (token, group, size band) bound the overlap of queries with smaller
   members of other groups. Groups that qualify are opened: their members are counted
   against the query token by token, and those that can link are compared.
5. Members of one group are compared with each other by what sets each apart from the
   pivot. Most pairs are that near to it that they link for certain: those are counted
   by a histogram, the rest in blocks, so a large group is no single task.
6. Links of sets give components, whose label is the smallest doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesets import U64, Words, column_bytes, mix, shingle_sets, slices
from .components import components
from .store import Store, arrow_rows, bloom_joins, lean, partitions, table

SHINGLE = 5
SLICE_BYTES = 1 << 20
#: Tokens are frequent if they come more than once among WINDOW_TOKENS of a task, MIN_OFTEN times in all such windows.
WINDOW_TOKENS, MIN_OFTEN, MAX_HOT = 1 << 22, 8, 1 << 20
#: The share of a set whose tokens are sent, as far as they are rare.
EXTENT = 0.27
BUCKET_POSTINGS = 1 << 19
BLOCK = 64
#: Members of a group that are compared with each other at once, of at most so many tokens.
MEMBERS, MEMBER_TOKENS = 512, 1 << 22
#: A size band is so many times wider than the one before.
BAND = 1.04
_ANY = 1 << 30

_SETS = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
_POST = pa.schema([("token", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("cap", pa.int32())])


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, off = column_bytes(batch["text"])
    for lo, hi in slices(np.diff(off), SLICE_BYTES):
        yield lo, list(shingle_sets(Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), SHINGLE))


def _fingerprint(s: np.ndarray) -> np.int64:
    return np.array([mix(s).sum(dtype=U64) ^ mix(np.array([len(s)], U64))[0]], U64).view(np.int64)[0]


def _scan_sets(batches):
    """Kind 0: (doc_id, fingerprint, size) of each row; kind 1: (token, times) of tokens that come often in a window."""
    held: dict[int, np.ndarray] = {}

    def often():
        tokens, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
        held.clear()
        tokens, n = tokens[n > 1].view(np.int64), n[n > 1].astype(np.int64)
        return arrow_rows(_SETS, kind=np.ones(len(tokens), np.int8), a=tokens, b=n, c=n)

    size = 0
    for batch in batches:
        ids = batch["doc_id"]
        for lo, sets in _batches(batch):
            fps = [int(_fingerprint(s)) for s in sets]
            yield arrow_rows(_SETS, kind=np.zeros(len(sets), np.int8), a=ids.slice(lo, len(sets)), b=np.array(fps, np.int64), c=np.array([len(s) for s in sets], np.int64))
            for fp, s in zip(fps, sets, strict=True):
                if fp not in held:
                    held[fp] = s
                    size += len(s)
            if size >= WINDOW_TOKENS:
                yield often()
                size = 0
    if held:
        yield often()


def prefix_length(n):
    """Tokens of which one is shared with any partner, for sets of n."""
    return n - (3 * n + 3) // 4 + 1


def _frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens in order, rank by frequency) of the most frequent tokens, MAX_HOT of them at most."""
    often = scan.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("df")).where(F.col("df") >= MIN_OFTEN).withColumn("class", F.floor(8 * F.log2("df")))
    least, total = None, 0
    for kind, n in sorted(often.groupBy("class").count().collect(), reverse=True):  # some hundred classes at most
        total += n
        if total > MAX_HOT:
            break
        least = kind
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.int32)
    got = often.where(F.col("class") >= least).select("token", "df").toArrow()
    token, df = got["token"].to_numpy().view(U64), got["df"].to_numpy()
    by = np.lexsort((token, df))
    rank = np.empty(len(by), np.int32)
    rank[by] = np.arange(len(by), dtype=np.int32)
    order = np.argsort(token)
    return token[order], rank[order]


def _extent(n: np.ndarray) -> np.ndarray:
    """Tokens sent of a set of n, if so many are rare."""
    return np.maximum(prefix_length(n), -(-n * round(100 * EXTENT) // 100))


def _beginning(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(tokens sent, how many of them are rare, cap of each) of a set."""
    n, rare = len(s), len(s)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        last = hot[at] == s
        if last.any():
            rare = n - int(np.count_nonzero(last))
            s = np.concatenate((s[~last], s[last][np.argsort(rank[at[last]])]))
    need = prefix_length(n)
    k = min(_extent(n), rare)
    place = np.arange(max(k, need))
    return s[: len(place)], k, np.where(place < k, _ANY, (4 * n - 7 * place) // 3).astype(np.int32)


def _postings(frequent, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def run(batches):
        hot, rank = frequent.value
        for batch in batches:
            for _, sets in _batches(batch):
                got = {}
                for s in sets:
                    if len(s) and (fp := int(_fingerprint(s))) not in got:
                        got[fp] = (*_beginning(s, hot, rank), len(s))
                if not got:
                    continue
                size = np.array([len(x[0]) for x in got.values()])
                token, cap = (np.concatenate([x[i] for x in got.values()]) for i in (0, 2))
                fp, n, k = (np.repeat(np.array(x, t), size) for x, t in ((list(got), np.int64), ([x[3] for x in got.values()], np.int32), ([x[1] for x in got.values()], np.int32)))
                key = mix(token)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                    key = np.where(hot[at] == token, mix(fp.view(U64)), key)
                bucket = (key % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, token, fp, n, k, cap = bucket[order], token[order].view(np.int64), fp[order], n[order], k[order], cap[order]
                less = (_extent(n) - k).astype(np.int32)  # zeros for most, which compress well
                edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                yield arrow_rows(schema, bucket=bucket[edge[:-1]], data=[b"".join(x[a:b].tobytes() for x in (token, fp, n, less, cap)) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])

    return run


def _nameless(batches):
    for batch in batches:
        for lo, sets in _batches(batch):
            fps = np.array([_fingerprint(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), batch["text"].slice(lo, len(sets)).cast(pa.string())], names=["fp", "text"])


def _shared(frequent):
    """Postings of the tokens that more than one set has; frequent ones are all kept, as other buckets may hold the rest."""

    def run(batches):
        hot, parts = frequent.value[0], []
        for batch in batches:
            for blob in batch["data"]:
                raw = np.frombuffer(blob.as_buffer(), np.uint8)
                m = len(raw) // 28
                parts.append(tuple(raw[a * m : b * m].view(t) for a, b, t in ((0, 8, np.int64), (8, 16, np.int64), (16, 20, np.int32), (20, 24, np.int32), (24, 28, np.int32))))
        if not parts:
            return
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        parts.clear()
        columns[3] = (_extent(columns[2]) - columns[3]).astype(np.int32)
        order = np.lexsort((columns[1], columns[0]))
        token, fp = columns[0][order], columns[1][order]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])))
        order, token = order[new], token[new]
        same = token[1:] == token[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        if len(hot):
            at = np.minimum(np.searchsorted(hot, token.view(U64)), len(hot) - 1)
            keep |= hot[at] == token.view(U64)
        order = order[keep]
        for i in range(0, len(order), 100_000):
            yield arrow_rows(_POST, **{f.name: x[order[i : i + 100_000]] for f, x in zip(_POST, columns, strict=True)})

    return run


def _compare(apart: bool):
    """Rows come by (hub, block), a hub's own row first; the hub's set meets each member's. With `apart`, linked members come with the tokens that only one of the two has."""
    schema = pa.schema([("hub", pa.int64()), ("fp", pa.int64()), ("n_hub", pa.int64()), ("n", pa.int64()), ("common", pa.int64()), ("apart", pa.binary())])

    def run(batches):
        key, own = None, np.zeros(0, U64)
        for batch in batches:
            hubs, blocks, fps, roles = (batch[c].to_pylist() for c in ("hub", "block", "fp", "role"))
            out = []
            for lo, sets in _batches(batch):
                for i, s in enumerate(sets, lo):
                    if _fingerprint(s) != fps[i]:
                        continue  # another text under the same doc_id
                    if roles[i] == 0:
                        key, own = (hubs[i], blocks[i]), s
                    elif key == (hubs[i], blocks[i]):
                        other = np.setxor1d(own, s, assume_unique=True)
                        common = (len(own) + len(s) - len(other)) // 2
                        out.append((hubs[i], fps[i], len(own), len(s), common, other.tobytes() if apart and 100 * common >= 75 * (len(own) + len(s) - common) else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield arrow_rows(schema, **dict(zip(schema.names, cols, strict=True)))

    return run


def _verify(store: Store, docs: DataFrame, nameless: DataFrame | None, reps: DataFrame, pairs: DataFrame, name: str, apart: bool = False) -> DataFrame:
    """(hub, fp, n_hub, n, common, apart) of the pairs (hub, fp) of fingerprints, from the texts.

    A hub's members are dealt in blocks of about BLOCK, each with a copy of the hub.
    Texts are fetched by doc_id, and from `nameless` by fingerprint where no row has one.
    """
    spark = docs.sparkSession
    pairs = store.keep(pairs.where("hub <> fp").distinct(), f"{name}-pairs")
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = pairs.join(blocks, "hub").select("hub", F.expr("cast(pmod(xxhash64(fp), blocks) as int)").alias("block"), "fp", F.lit(1).alias("role"))
    hub = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("fp"), F.lit(0).alias("role"))
    wanted = store.keep(member.unionByName(hub).join(reps.select("fp", "rep"), "fp").withColumn("used", F.lit(1)), f"{name}-wanted").where("used > 0")
    # A Bloom filter of the wanted ids keeps the other texts out of the shuffle. Spark makes one of a side with a
    # filter it holds to be selective: a comparison is, a boolean column alone isn't.
    with bloom_joins(spark):
        rows = docs.select(F.col("doc_id").alias("rep"), "text").where("text is not null").join(wanted, "rep").select("hub", "block", "fp", "role", "text")
        if nameless is not None:
            rows = rows.unionByName(nameless.join(wanted.where("rep is null"), "fp").select("hub", "block", "fp", "role", "text"))
        dealt = rows.repartition(max(partitions(spark), 2), "hub", "block").sortWithinPartitions("hub", "block", "role")
        found = dealt.mapInArrow(lean(_compare(apart)), "hub long, fp long, n_hub long, n long, common long, apart binary")
        return store.keep(found.dropDuplicates(["hub", "fp"]) if apart else found.distinct(), f"{name}-compared")


_LINK = "100 * common >= 75 * (n_hub + n - common)"


def _seen(n: str, k: str, m: str, km: str) -> str:
    """SQL: tokens that two linked sets of n and m tokens share at least among those sent, of which k and km are rare."""
    return f"greatest(1, least(3 * ({n} + {m}) / 7 - {n} + {k}, 3 * ({n} + {m}) / 7 - {m} + {km}) - 1e-6)"


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of the sets `a` shares with each of the sets `b`."""
    rows, cols = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    token, at = np.unique(np.concatenate((*a, *b)), return_inverse=True)
    ta, tb = at[: len(rows)], at[len(rows) :]
    ka, kb = np.bincount(ta, minlength=len(token)), np.bincount(tb, minlength=len(token))
    out = np.zeros((len(a), len(b)), np.int64)
    # Tokens of many pairs are multiplied as a matrix, others give their pairs one by one.
    heavy = 64 * ka * kb > out.size
    place = np.where(heavy, np.cumsum(heavy) - 1, -1)
    pa_, pb = place[ta], place[tb]
    for lo in range(0, int(np.count_nonzero(heavy)), 4096):
        sides = []
        for x, p, of in ((a, pa_, rows), (b, pb, cols)):
            own = (p >= lo) & (p < lo + 4096)
            sides.append(np.zeros((len(x), 4096), np.float32))
            sides[-1][of[own], p[own] - lo] = 1
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    own = np.flatnonzero((pa_ < 0) & (kb[ta] > 0))
    order = np.argsort(tb, kind="stable")
    begin = np.cumsum(kb) - kb
    for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(kb[ta[own]]) >> 20)) + 1):
        times = kb[ta[part]]
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.repeat(rows[part], times) * len(b) + cols[order[np.repeat(begin[ta[part]], times) + step]]
        out += np.bincount(pairs, minlength=out.size).reshape(out.shape)
    return out


def _meet(batches):
    """Rows come by (hub, x, y): a block of members of a hub's group, on side 0, meets another, on side 1, or itself where there is none. Pairs that link for certain aren't counted."""
    schema = pa.schema([("fp", pa.int64()), ("links", pa.int64()), ("docs", pa.int64())])
    key, rows = None, []

    def count():
        sides = []
        for side in (0, 1):
            own = [r for r in rows if r["side"] == side]
            sides.append(([np.frombuffer(r["apart"], U64) for r in own], *(np.array([r[c] for r in own], np.int64) for c in ("fp", "n", "common", "near", "w"))))
        alone = not sides[1][0]
        (a, fa, na, ca, va, wa), (b, fb, nb, cb, vb, wb) = sides[0], sides[0] if alone else sides[1]
        if not a:
            return
        n_hub = rows[0]["n_hub"]
        both = ca[:, None] + cb - n_hub + _overlaps(a, b)
        link = (100 * both >= 75 * (na[:, None] + nb - both)) & (va[:, None] + vb < 7 * n_hub)
        if alone:
            np.fill_diagonal(link, False)
        yield arrow_rows(schema, fp=fa, links=link.sum(axis=1), docs=link @ wb)
        if not alone:
            yield arrow_rows(schema, fp=fb, links=link.sum(axis=0), docs=wa @ link)

    for batch in batches:
        for r in batch.to_pylist():
            if (r["hub"], r["x"], r["y"]) != key:
                if rows:
                    yield from count()
                key, rows = (r["hub"], r["x"], r["y"]), []
            rows.append(r)
    if rows:
        yield from count()


def _within(store: Store, near: DataFrame, reps: DataFrame) -> DataFrame:
    """(fp, links, docs): of members of a group the other members that they link with, and the rows that have those sets.

    Two sets that share c and d tokens with their pivot, of n_hub, share c + d - n_hub
    or more with each other. With near = 7 c - 3 n, they link for certain if their
    near's sum to 7 n_hub. Of two others one is below half of that, and those are few.
    """
    member = store.keep(near.where(_LINK).join(reps.select("fp", "w"), "fp").withColumn("near", F.expr("7 * common - 3 * n")), "members")
    steps = member.groupBy("hub", "n_hub", "near").agg(F.count("*").alias("k"), F.sum("w").alias("kw"))
    # For each value of near, how many are at or above the rest of 7 n_hub: a running sum over a hub's different values.
    asked = steps.select("hub", F.col("near").alias("ask"), F.expr("7 * n_hub - near").alias("at"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("kw"), F.col("k").alias("own"), F.expr("2 * near >= 7 * n_hub").alias("high"))
    given = steps.select("hub", F.lit(None).cast("long").alias("ask"), F.col("near").alias("at"), "k", "kw", F.lit(0).cast("long").alias("own"), F.lit(False).alias("high"))
    above = Window.partitionBy("hub").orderBy(F.desc("at"), F.col("ask").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("hub")
    sums = given.unionByName(asked).select("hub", "ask", "own", "high", F.sum("k").over(above).alias("sure"), F.sum("kw").over(above).alias("sure_w"), F.sum("k").over(whole).alias("all"))
    sums = sums.where("ask is not null and all > 1").withColumn("open", F.expr("sure - if(high, 1, 0) < all - 1")).withColumnRenamed("ask", "near")
    sums = store.keep(sums, "nearness")
    certain = member.join(sums, ["hub", "near"]).select("fp", F.expr("sure - if(high, 1, 0)").alias("links"), F.expr("sure_w - if(high, w, 0)").alias("docs"))
    # Blocks of low members (below half) meet each other and the blocks of the high ones.
    size = F.expr(f"greatest(16, least({MEMBERS}, {MEMBER_TOKENS} div n_hub))")
    blocks = sums.where("open").groupBy("hub").agg(F.sum(F.expr("if(high, 0, own)")).alias("low"), F.sum(F.expr("if(high, own, 0)")).alias("up"))
    dealt = member.join(sums.where("open").select("hub", "near", "high"), ["hub", "near"]).join(blocks, "hub")
    dealt = dealt.withColumn("low", F.ceil(F.col("low") / size)).withColumn("up", F.ceil(F.col("up") / size)).withColumn("block", F.expr("if(high, low + pmod(xxhash64(fp), up), pmod(xxhash64(fp), low))"))
    meets = F.expr("if(high, transform(sequence(0L, low - 1), i -> struct(i as x, block as y, 1 as side)), transform(sequence(0L, low + up - 1), i -> struct(least(i, block) as x, greatest(i, block) as y, if(i < block, 1, 0) as side)))")
    dealt = dealt.withColumn("meet", F.explode(meets)).select("hub", "meet.*", "fp", "n_hub", "n", "common", "near", "w", "apart")
    met = dealt.repartition(max(partitions(near.sparkSession), 2), "hub", "x", "y").sortWithinPartitions("hub", "x", "y").mapInArrow(lean(_meet), "fp long, links long, docs long")
    return certain.unionByName(met)


def jaccard_join(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, n_linked_docs) of each row of `docs` (doc_id, text; more columns are ignored).

    Two texts link if their sets of five-word shingles have a Jaccard similarity of
    0.75 or more; component_id is the smallest doc_id reachable by links. n_links
    counts all other sets that the row's set links with directly, n_linked_docs the
    other rows that the row links with: those that have these sets, or its own.

    Null and empty texts have n_shingles 0 and are their own component. Repeated
    rows give repeated result rows in one component. A row without doc_id takes
    the component of its text, which is null if no row with that text, and no
    partner, has a doc_id. An empty table gives an empty result.
    """
    return _join(docs, store or Store(docs.sparkSession, "jaccard"), True)


def _join(docs: DataFrame, store: Store, count: bool) -> DataFrame:
    """jaccard_join; without `count`, links that components don't need aren't looked for, and the columns that count links aren't there."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = store.keep(docs.mapInArrow(lean(_scan_sets), "kind byte, a long, b long, c long"), "sets")
    sets = scan.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("fp"), F.col("c").alias("n"))
    reps = store.keep(sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("w")), "reps")
    lost, nameless = reps.where("rep is null").select("fp"), None
    if not lost.isEmpty():
        found = docs.where("doc_id is null and text is not null").select("text").mapInArrow(lean(_nameless), "fp long, text string")
        nameless = store.keep(found.join(lost, "fp", "left_semi").dropDuplicates(["fp"]), "nameless")
    mass = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = spark.sparkContext.broadcast(_frequent(scan))
    # Packed postings: about BUCKET_POSTINGS in a partition, however large the input.
    parts = max(partitions(spark), -(-int(mass) // (3 * BUCKET_POSTINGS)))
    packed = docs.mapInArrow(lean(_postings(frequent, 4 * parts)), "bucket int, data binary").repartition(parts, "bucket")
    post = store.keep(packed.mapInArrow(lean(_shared(frequent)), "token long, fp long, n int, k int, cap int"), "postings")
    # Groups. Half of what partners share is enough here, as tokens that both have in common with another pivot aren't counted.
    fits = "4 * n >= 3 * n_hub and 4 * n_hub >= 3 * n and n <= cap_hub and n_hub <= cap"
    pivot = post.groupBy("token").agg(F.min(F.struct("k", "fp", "n", "cap")).alias("p")).select("token", *(F.col(f"p.{a}").alias(b) for a, b in (("fp", "hub"), ("n", "n_hub"), ("k", "k_hub"), ("cap", "cap_hub"))))
    shared = post.join(pivot, "token").where(f"fp <> hub and {fits}").groupBy("fp", "n", "k", "hub", "n_hub", "k_hub").agg(F.count("*").alias("c"))
    star = shared.where(f"2 * c >= {_seen('n', 'k', 'n_hub', 'k_hub')}").groupBy("fp").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    near = _verify(store, docs, nameless, reps, star.select("hub", "fp"), "groups", count)
    member = near.where(_LINK).select("fp", "hub")  # a hub that belongs to another still has a group of its own
    label = member.select("fp", "hub", F.lit(False).alias("leads")).unionByName(member.select(F.col("hub").alias("fp"), F.lit(None).cast("long").alias("hub"), F.lit(True).alias("leads")))
    label = label.groupBy("fp").agg(F.max("hub").alias("hub"), F.max("leads").alias("leads"))
    group = post.join(label, "fp", "left").select(
        "token", "fp", "n", "k", "cap", F.coalesce("hub", "fp").alias("g"), (F.col("hub").isNotNull() | F.coalesce("leads", F.lit(False))).alias("many"), F.floor(F.log("n") / math.log(BAND)).cast("int").alias("band")
    )
    group = store.keep(group, "grouped")
    # Matrix, bound and qualifying groups: a query looks for smaller or equal sets.
    matrix = group.where("cap >= n").groupBy("token", F.col("g").alias("to"), "band", "many").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("cap").alias("reach"), F.max(F.expr("4 * n / 7 - k")).alias("m"))
    query = group.select("token", "fp", "n", "k", "cap", "g")
    near_enough = "g <> to and lo <= n and 4 * hi >= 3 * n and n <= reach and lo <= cap"
    met = query.join(matrix, "token").where(near_enough).groupBy("fp", "n", "k", "to", "band", "many").agg(F.count("*").alias("c"), F.min("lo").alias("lo"), F.max("m").alias("m"))
    opened = store.keep(met.where("c >= greatest(1, least(3 * (n + greatest(lo, 0.75 * n)) / 7 - n + k, 3 * n / 7 - m) - 1e-6)").select("fp", "n", "to", "band", "many", "lo"), "opened")
    single = opened.where("not many and (lo < n or (lo = n and to < fp))").select(F.col("fp").alias("hub"), F.col("to").alias("fp"))
    # Only the tokens by which a group qualified are looked for in its members.
    union = matrix.where("many").groupBy("token", "to").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("reach").alias("reach"))
    asked = query.join(union, "token").where(near_enough).select("token", "to", "fp", "n", "k", "cap").join(opened.where("many").select("fp", "to").distinct(), ["fp", "to"], "left_semi")
    asked = asked.select("token", F.col("to").alias("g"), F.col("fp").alias("hub"), F.col("n").alias("n_hub"), F.col("k").alias("k_hub"), F.col("cap").alias("cap_hub"))
    inner = asked.join(group.where("many and cap >= n").select("token", "fp", "n", "k", "cap", "g"), ["token", "g"]).where(f"(n < n_hub or (n = n_hub and fp < hub)) and {fits}")
    inner = inner.groupBy("hub", "n_hub", "k_hub", "fp", "n", "k").agg(F.count("*").alias("c")).where(f"c >= {_seen('n', 'k', 'n_hub', 'k_hub')}").select("hub", "fp")
    tested = _verify(store, docs, nameless, reps, single.unionByName(inner), "opened")
    return _finish(store, sets, reps, near.unionByName(tested), _within(store, near, reps) if count else None)


def _finish(store: Store, sets: DataFrame, reps: DataFrame, compared: DataFrame, within: DataFrame | None) -> DataFrame:
    links = store.keep(compared.where(_LINK).select(F.greatest("hub", "fp").alias("a"), F.least("hub", "fp").alias("b")).distinct(), "links")
    comp = components(store, links, "all")
    low = comp.join(reps, comp.node == reps.fp).groupBy("component").agg(F.min("rep").alias("component_id"))
    named = comp.join(low, "component").select(F.col("node").alias("fp"), "component_id")
    counts = []
    if within is not None:
        ends = links.select(F.col("a").alias("fp"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("fp"), F.col("a").alias("other")))
        ends = ends.join(reps.select(F.col("fp").alias("other"), "w"), "other").select("fp", F.lit(1).cast("long").alias("links"), F.col("w").alias("docs"))
        named = named.join(ends.unionByName(within).groupBy("fp").agg(F.sum("links").alias("n_links"), F.sum("docs").alias("docs")), "fp")
        counts = [F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("docs", F.lit(0)) + F.col("w") - 1).alias("n_linked_docs")]
    label = store.keep(reps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), *counts), "labels")
    got = sets.join(label, "fp", "left")
    alone = F.col("n") == 0
    counts = [F.when(alone, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in label.columns[2:]]
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *counts)


def representatives(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """The rows of `docs`, all columns, less near duplicates: of each component the row with its smallest doc_id stays.

    Of repeated rows of that doc_id one stays. Rows without words or without doc_id stay.
    Only rows that go are looked for in the texts' table, by their ids.
    """
    store = store or Store(docs.sparkSession, "jaccard")
    found = _join(docs, store, False)
    away = found.where("n_shingles > 0 and doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__away")).distinct()
    twice = found.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("__twice")).agg(F.count("*").alias("n")).where("n > 1").select("__twice")
    rest = docs.join(store.keep(away, "away"), F.col("doc_id") == F.col("__away"), "left_anti")
    if twice.isEmpty():
        return rest
    many = rest.join(twice, F.col("doc_id") == F.col("__twice"), "left_semi").dropDuplicates(["doc_id"])
    return rest.join(twice, F.col("doc_id") == F.col("__twice"), "left_anti").unionByName(many)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_join over all documents."""
    return jaccard_join(table(spark, sf_dir, "documents"))
