"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(edges: DataFrame, work: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, written; component is the smallest node reachable.

    Edges become stars around each component's smallest node in a number of rounds that grows with the logarithm of the
    longest path. A hub's edges are never gathered: its minimum is aggregated where they lie, and joined by key.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = work.cut(e)
    last = None
    while True:
        n, s, v = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, s, v) == last:
            break
        last = (n, s, v)
        # Large star: every node's larger neighbours move to its smallest neighbour (itself included).
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        big = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every node and its smaller neighbours move to the smallest of them.
        low = big.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = big.join(low, big["u"] == low["x"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = work.cut(small.unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        work.drop(e)
        e = nxt
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = work.cut(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops))
    work.drop(e)
    return out
