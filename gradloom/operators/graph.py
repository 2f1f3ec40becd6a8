"""Connected components of a link table, distributed: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.lineage import cut


def _stars(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star step over rows (u, v), u > v: neighbours are tied to the least of their star.

    The minima are written before the join, so that both of its sides are plain shuffles
    and Spark can split the rows of a hub.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars", 2 * n)
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "stars", n)
        joined = edges.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, rounds: int = 40, most: int | None = None) -> DataFrame:
    """``node, component`` (the least node of its component) for every node of ``links`` (a, b).

    Stops when a round changes nothing; the number of rounds grows with the logarithm of
    the size. Only a count and a checksum reach the driver. ``most`` is the number of links at
    most, if the caller knows.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", most)

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return r["n"], r["x"]

    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        n = before[0]
        edges = cut(_stars(cut(_stars(edges, True, n), "large", n), False, n), "small", n)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
