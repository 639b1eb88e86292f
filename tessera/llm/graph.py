"""Connected components without collecting links: large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, unsettle


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (columns a, b, of whole numbers, not null).

    Nodes without an edge aren't in the result. A node with very many links is no hot key: minima are added up before
    they shuffle, and the joins read written tables on both sides, whose large partitions Spark splits.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    state = _state(now)
    while state[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = settle(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low2 = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        after = settle(large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct())
        for done in (now, low, large, low2):
            unsettle(done)
        now, was = after, state
        state = _state(now)
        if state == was:
            break
    # Stars now: every node points at its component's smallest.
    return settle(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")).first()
    return row["n"], row["x"], row["y"]
