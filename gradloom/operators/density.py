"""Density clusters of vectors: mutual-reachability spanning tree, condensed tree, excess of mass.

Rows of a bucket are dealt into blocks of bounded size and every two blocks meet in one task, twice: first for each row's distance to its
second nearest other (its core distance), then for the least spanning tree of the two blocks alone, under the mutual
reachability (the largest of both core distances and the distance). Edges of the whole tree are among those of the parts, as an edge that
is the largest of a circle in a part is the largest of that circle in the whole. Rounds of joins (each component takes its least edge out)
leave the tree; a bucket of one block has it already. What is left is a bucket's tree, an edge for each row and no vectors: one task cuts it
where clusters of two and more part, and selects those clusters that keep more mass than what they part into.

Ties have one result: edges are ordered by weight and ends, and merges of equal distance are one merge. Distances count to 12 places.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradloom.functions.classify import tier
from gradloom.lineage import cut
from gradloom.operators.graph import components
from gradloom.operators.similarity import BLOCK, _matrix
from gradloom.workers import ship

NEIGHBOURS, LEAST = 2, 1e-12  # a distance of less counts as this much, so that copies have a finite density


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Each row once for every block of its place that its own block meets."""
    sizes = rows.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = rows.join(sizes, "place").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))


def _units(table: pa.Table) -> np.ndarray:
    v = _matrix(table["v"])
    n = np.linalg.norm(v, axis=1)
    return v / np.where(n == 0, 1, n)[:, None]


def _far(u: np.ndarray, i: int) -> np.ndarray:
    return np.maximum(np.round(1 - u @ u[i], 12), LEAST)


def core_distances(rows: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """``key, core``: the distance to the ``k``-th nearest other row of the place, or to the farthest where there are fewer; null for a row alone."""

    def near(table: pa.Table) -> pa.Table:
        u, keys, own = _units(table), table["key"].to_numpy(), table["own"].to_numpy()
        one = table["x"][0].as_py() == table["y"][0].as_py()
        at, far = [], []
        for i in range(len(u)):
            ok = np.ones(len(u), dtype=bool) if one else own != own[i]  # rows of its own block meet it where that block is alone
            ok[i] = False
            d = _far(u, i)[ok]
            d = np.sort(np.partition(d, k - 1)[:k] if len(d) > k else d)
            at.append(np.full(len(d), keys[i]))
            far.append(d)
        return pa.table({"key": pa.array(np.concatenate(at), pa.int64()), "d": pa.array(np.concatenate(far), pa.float64())})

    found = _dealt(rows, block).groupBy("place", "x", "y").applyInArrow(near, "key long, d double")
    w = Window.partitionBy("key").orderBy("d")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("key").agg(F.max("d").alias("core"))


def spanning_tree(u: np.ndarray, core: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, float]]:
    """The least spanning tree by mutual reachability; of equal edges the one with the lesser ends comes first."""
    n = len(u)
    outside = np.ones(n, dtype=bool)
    weight, low, high = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    tree, i = [], 0
    for _ in range(n - 1):
        outside[i] = False
        w = np.maximum(np.maximum(_far(u, i), core), core[i])
        lo, hi = np.minimum(keys, keys[i]), np.maximum(keys, keys[i])
        less = outside & ((w < weight) | ((w == weight) & ((lo < low) | ((lo == low) & (hi < high)))))
        weight[less], low[less], high[less] = w[less], lo[less], hi[less]
        open_ = np.flatnonzero(outside)
        first = open_[weight[open_] == weight[open_].min()]
        i = int(first[np.lexsort((high[first], low[first]))[0]])
        tree.append((int(low[i]), int(high[i]), float(weight[i])))
    return tree


def reachability_tree(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``place, a, b, w``: the spanning tree of each place of ``rows`` (place, key, v)."""
    core = cut(core_distances(rows, block=block), "core")
    dealt = _dealt(rows.join(core, "key", "left"), block)

    def tree(table: pa.Table) -> pa.Table:
        edges = spanning_tree(_units(table), np.nan_to_num(table["core"].to_numpy(zero_copy_only=False), nan=0.0), table["key"].to_numpy())
        a, b, w = zip(*edges, strict=True) if edges else ((), (), ())
        return pa.table({"place": pa.array([table["place"][0].as_py()] * len(edges), pa.string()), "whole": pa.array([table["blocks"][0].as_py() == 1] * len(edges), pa.bool_()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "w": pa.array(w, pa.float64())})

    edges = cut(dealt.groupBy("place", "x", "y").applyInArrow(tree, "place string, whole boolean, a long, b long, w double").distinct(), "edges")
    done = edges.where("whole").drop("whole")
    left = edges.where("NOT whole").select("place", "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    while left.limit(1).count():  # each round at least halves the components
        ends = left.select("place", "a", "b", "w", F.explode(F.array("ca", "cb")).alias("c"))
        best = cut(ends.groupBy("c").agg(F.min(F.struct("w", "a", "b", "place")).alias("e")).select("e.place", "e.a", "e.b", "e.w").distinct(), "chosen")
        done = done.unionByName(best)
        chosen = left.join(best.select("a", "b"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        of = cut(components(chosen), "components")
        for c in ("ca", "cb"):
            left = left.join(of.withColumnsRenamed({"node": c, "component": "now"}), c, "left").withColumn(c, F.coalesce("now", c)).drop("now")
        left = cut(left.where("ca != cb"), "left")
    return done


def excess_of_mass(a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int = 2) -> dict[int, int]:
    """The least key of the cluster of each key, from a spanning tree; keys that aren't there are noise.

    Going up from the least distance, clusters of ``least`` keys or more that meet make a new one; one that meets none grows.
    The mass of a cluster is what each of its keys adds from where it came in (as a density, one over the distance)
    down to where the cluster ends in a larger one. A cluster stands if it has no less mass than those below it that stand together;
    that of all keys doesn't.
    """
    order = np.lexsort((b, a, w))
    parent: dict[int, int] = {int(x): int(x) for x in np.concatenate([a, b])}
    members: dict[int, list[int]] = {x: [x] for x in parent}
    #: of the root of each set with ``least`` keys: the sum of the densities at which its keys came in, and the mass and members of what stands below it
    node: dict[int, tuple[float, float, list[list[int]]]] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def ended(root: int, density: float) -> tuple[float, list[list[int]]]:
        """Mass and members of what stands of a set that ends in a larger one at ``density``."""
        came, below, standing = node.pop(root)
        mass = came - len(members[root]) * density
        return (below, standing) if below > mass else (mass, [list(members[root])])

    at = 0
    while at < len(order):
        level = w[order[at]]
        density = 1 / level
        touched: dict[int, list[int]] = {}
        while at < len(order) and w[order[at]] == level:  # merges of one distance are one
            x, y = find(int(a[order[at]])), find(int(b[order[at]]))
            at += 1
            gx, gy = touched.pop(x, [x]), touched.pop(y, [y])
            if len(gx) < len(gy):
                x, y = y, x
            parent[y] = x
            touched[x] = gx + gy
        for root, sets in touched.items():
            size, big = sum(len(members[s]) for s in sets), [s for s in sets if s in node]
            if len(big) == 1:  # it grows: those that join come in at this density
                came, below, standing = node.pop(big[0])
                grown = (came + (size - len(members[big[0]])) * density, below, standing)
            else:
                parts = [ended(s, density) for s in big]
                grown = (size * density, sum(m for m, _ in parts), [c for _, cs in parts for c in cs])
            largest = max(sets, key=lambda s: len(members[s]))
            all_ = members.pop(largest)
            for s in sets:
                if s != largest:
                    all_ += members.pop(s)
            members[root] = all_
            if size >= least:
                node[root] = grown
    out: dict[int, int] = {}
    for _, _, standing in node.values():  # the cluster of all keys doesn't stand, what is below it does
        for c in standing:
            first = min(c)
            out |= dict.fromkeys(c, first)
    return out


def density_clusters(vectors: DataFrame, key: str, vector: str, bucket: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``bucket, key, cluster`` (its least key), ``noise, frequency, tier`` of every row with a vector; noise is a cluster of its own, of the last tier.

    Keys are whole numbers, distinct over all buckets; a bucket of nulls is a bucket; a zero vector is at distance 1 from every other.
    """
    ship(vectors.sparkSession)
    place = F.to_json(F.struct(*bucket) if bucket else F.struct(F.lit(0).alias("all")))
    rows = cut(vectors.select(*bucket, place.alias("place"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull()), "vectors")
    tree = reachability_tree(rows.select("place", "key", "v"), block)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        of = excess_of_mass(part["a"].to_numpy(), part["b"].to_numpy(), part["w"].to_numpy())
        return pd.DataFrame({"key": pd.Series(list(of.keys()), dtype="int64"), "cluster": pd.Series(list(of.values()), dtype="int64")})

    found = tree.groupBy("place").applyInPandas(run, "key long, cluster long")
    each = rows.select(*bucket, "key").join(found, "key", "left").select(*bucket, F.col("key").alias(key), F.coalesce("cluster", "key").alias("cluster"), F.col("cluster").isNull().alias("noise"))
    n = F.count(F.lit(1)).over(Window.partitionBy("cluster", "noise"))
    return each.withColumn("frequency", n).withColumn("tier", tier(F.col("frequency")))
