"""Connected components by alternating stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def components(store: Store, edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the smallest node that is reachable.

    Each round replaces edges by edges to the smallest neighbour (large star, then
    small star); every step is a minimum per node, which combines before the shuffle,
    and a join that Spark can split, so a node with very many edges is no hot task.
    A graph of n nodes takes about log(n) rounds. No edges give no rows.
    """
    cur = store.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen = _mark(cur)
    for i in range(1, rounds + 1):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        nxt = store.keep(small.where("a <> b").distinct(), f"{name}-{i}")
        now = _mark(nxt)
        store.drop(f"{name}-{i - 1}")
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
