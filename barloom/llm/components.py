"""Connected components of an edge table by alternating large and small stars.

In each round every node first passes its smallest neighbour to its larger ones (large star), then
to its smaller ones (small star); the rounds end when the edges stay as they are, each node then
pointing at its component's smallest. Rounds grow with the logarithm of the longest chain. Edges
never leave the executors: each round is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Takes edges whose a is larger than b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(a, b) links of long ids to (node, root): every linked node and the smallest node it reaches."""
    now = scratch.keep(edges.where("a <> b").select("a", "b").distinct(), f"{name}-0")
    state, turn = None, 0
    while True:
        turn += 1
        now = scratch.keep(_small_star(_large_star(now).distinct()).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") % 1000003).cast("long"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
