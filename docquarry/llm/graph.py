"""Connected components by alternating large-star and small-star steps, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import common

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    Loops and nulls are ignored. Each round halves the depth of the deepest
    tree at least; edges are written to the shared folder after each, so the
    plan stays short. A hub's edges meet its minimum in a partial aggregate,
    and the join back to them is one that Spark can split when it is skewed.
    """
    e = edges.filter(f"{a} <> {b}").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    e, before = common.cut(e, "edges"), None
    for _ in range(MAX_ROUNDS):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        e, before = common.cut(small.unionByName(least.select(F.col("m").alias("u"), "v")).distinct(), "edges"), now
    raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
