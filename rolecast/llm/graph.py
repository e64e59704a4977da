"""Connected components of an edge table, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, join_hot


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour above u links to the least vertex around u."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(both.filter("b > a"), least, "a", "n", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour below u, and u, links to the least vertex below u."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    sides = join_hot(down, least, "a", "n", n).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return sides.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of edges(a, b): root is the least vertex that it reaches.

    Rounds of large and small stars; each halves the depth or more, so the number of rounds grows with
    the logarithm of the longest chain. A vertex with many neighbours is no group (``join_hot``). Each round is cut into the shared folder and only two numbers
    come to the driver. Self-loops and repeated edges are allowed; null ends are dropped.
    """
    loops = edges.filter("a is not null and b is not null")
    now = cut(loops.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        now = cut(_small_star(_large_star(now, state[0]), state[0]))
        state, before = _state(now), state
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
