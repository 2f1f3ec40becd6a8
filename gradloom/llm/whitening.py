"""Whitening of embeddings by principal components.

Entries become integers, ``x = floor(1024 * c) + 100000``. One aggregation counts and sums them,
a second one, whose expressions are generated, sums the products of every pair of dimensions of the
upper triangle, centred by the mean rounded to an integer: so the products and their sums are
integers, exact in doubles up to 2^53 whatever the order of the rows, and the rest of the centring
(half a unit at most) is taken off in the covariance. LAPACK decomposes the matrix, dims x dims,
on the driver; rows meet its first components as generated expressions. What a table costs is a
scan for each step and no shuffle of rows.

:func:`fit` runs two jobs when it is called, :func:`identity_error` one.

Defined results: vectors that are null or empty, of another length than most (of two equally
frequent ones the shorter counts), or that hold nulls, NaN or infinities take no part; rows that repeat
an id stay rows of their own, a null id stays; entries beyond the range of a long end at its bounds;
a deviation that doesn't fit a long is null; a component without variance (an eigenvalue that rounding
can't tell from zero, as of equal vectors) gives no rows; an empty table gives none; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Sums of one aggregation at most: up to 90 dimensions take one, more dimensions a scan for each so many pairs.
PAIRS = 4096
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Model:
    """What is fitted: bounded by the dimensions, not by the rows."""

    n: int
    sums: list[int]  # of x, by dimension
    centre: list[int]  # the means, rounded
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float

    def rest(self) -> list[float]:
        """What the rounded centre lacks of the mean."""
        return [(s - self.n * c) / self.n for s, c in zip(self.sums, self.centre, strict=True)]


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, x`` (array of long) of the rows that take part, and the vectors' length."""
    kind = rows.schema[vector].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vector).cast("array<float>" if narrow else "array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    good = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)))
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = most["d"] if most else 0
    # the bounds keep the sum below a long's end; floor itself ends at a long's bounds
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(F.lit(float(SCALE)) * c.cast("double"), F.lit(-9.2e18)), F.lit(9.2e18))) + F.lit(SHIFT).cast("long"))
    return good.where(F.size("v") == dims).select("vec_id", x.alias("x")), dims


def covariance(x: DataFrame, dims: int, n: int, sums: list[int], centre: list[int]) -> np.ndarray:
    """The covariance (divisor ``n``) from sums of centred products of every pair of dimensions."""
    y = x.select(*[(F.get("x", F.lit(d)) - F.lit(centre[d]).cast("long")).cast("double").alias(f"y{d}") for d in range(dims)])
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    out, rest = np.zeros((dims, dims)), [(s - n * c) / n for s, c in zip(sums, centre, strict=True)]
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        found = y.agg(*[F.expr(f"sum(y{i} * y{j})").alias(f"s{i}_{j}") for i, j in part]).first()
        for (i, j), s in zip(part, found, strict=True):
            out[i, j] = out[j, i] = s / n - rest[i] * rest[j]
    return out


def fit(x: DataFrame, dims: int, components: int = COMPONENTS) -> Model | None:
    """The components of ``x`` (:func:`quantised`) by falling eigenvalue; None of no rows."""
    wide = x.select(*[F.get("x", F.lit(d)).cast("decimal(20,0)").alias(f"x{d}") for d in range(dims)])
    n, *sums = wide.agg(F.count(F.lit(1)), *[F.sum(f"x{d}") for d in range(dims)]).first()
    if not n:
        return None
    sums = [int(s) for s in sums]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    v = covariance(x, dims, n, sums, centre)
    e, u = np.linalg.eigh(v)  # rising
    e, u = e[::-1], u[:, ::-1]
    least = max(e[0], 0.0) * dims * np.finfo(float).eps
    k = min(components, int((e > least).sum()))
    u = u[:, :k] * np.where(u[np.abs(u[:, :k]).argmax(0), np.arange(k)] < 0, -1.0, 1.0)  # the largest entry is positive
    return Model(n, sums, centre, e[:k].copy(), u, float(np.trace(v)))


def project(x: DataFrame, model: Model) -> DataFrame:
    """``vec_id, x, w1, w2, ...``: each row's whitened components, as generated expressions."""
    y = [f"(CAST(get(x, {d}) - {c}L AS DOUBLE) - ({r!r}D))" for d, (c, r) in enumerate(zip(model.centre, model.rest(), strict=True))]
    w = [" + ".join(f"{t} * ({float(a)!r}D)" for t, a in zip(y, model.vectors[:, k], strict=True)) for k in range(len(model.values))]
    return x.select("vec_id", "x", *[F.expr(f"({s}) / {math.sqrt(e)!r}D").alias(f"w{k + 1}") for k, (s, e) in enumerate(zip(w, model.values, strict=True))])


def identity_error(projected: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened components' covariance minus the identity, measured over all rows."""
    k = len(model.values)
    pairs = [(i, j) for i in range(1, k + 1) for j in range(i, k + 1)]
    found = projected.agg(*[F.expr(f"sum(w{i})") for i in range(1, k + 1)], *[F.expr(f"sum(w{i} * w{j})") for i, j in pairs]).first()
    mean = [s / model.n for s in found[:k]]
    return max(abs(s / model.n - mean[i - 1] * mean[j - 1] - (i == j)) for (i, j), s in zip(pairs, found[k:], strict=True))


def deviation(model: Model) -> F.Column:
    """Sum over dimensions of (n * x - S)^2, exact; null where it doesn't fit a long."""
    far = F.zip_with("x", F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in model.sums]), lambda x, s: F.try_subtract(F.try_multiply(F.lit(model.n).cast("decimal(18,0)"), x.cast("decimal(19,0)")), s).cast("decimal(38,0)"))
    small = F.transform(far, lambda a: a.try_cast("decimal(19,0)"))  # a square of more has no place in a long anyway
    total = F.aggregate(small, F.lit(0).cast("decimal(38,0)"), lambda t, a: F.try_add(t, F.try_multiply(a, a)).cast("decimal(38,0)"))
    return total.try_cast("long")


def whiten(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``RESULT``: a row for each vector that takes part and each of its first ``components``."""
    x, dims = quantised(rows, key, vector)
    model = fit(x, dims, components) if dims else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], RESULT)
    projected = project(x, model)
    error = identity_error(projected, model)
    # outer: a plain explode would compute all of this once more in a filter on its size
    each = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k + 1}").alias("whitened"), F.lit(float(e) / model.trace).alias("explained")) for k, e in enumerate(model.values)])
    return projected.select("vec_id", deviation(model).alias("deviation"), each.alias("each")).select("vec_id", "deviation", F.explode_outer("each").alias("c")).select(
        "vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error")
    )


def op13(rows: DataFrame) -> DataFrame:
    """The contract of ``op13_whitening``."""
    return whiten(rows)
