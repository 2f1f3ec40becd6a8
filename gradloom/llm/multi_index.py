"""Nearest neighbours by largest inner product with an inverted multi-index.

Both halves of the vectors are quantised by codebooks of 64 centroids; a vector's cell is
the pair of its centroids. A query walks the cells in falling order of the summed inner
products with the two centroids, with a heap over the pairs (multi-sequence algorithm), and
stops when the cells it has seen hold a stated share of the index. What those cells hold is
reranked with exact inner products.

The codebooks are fitted on at most ``sample`` vectors (those with the least hashed ids);
every row is indexed. Codebooks grow with the square root of the index. On the test tables,
whose vectors have next to no cluster structure (the nearest of 50,000 has cosine 0.5), half of
the index must be seen for a recall of 0.95; on clustered vectors far less does. ``share`` sets
it, for tables of every size alike.

Equal vectors have equal scores and ties go to the smaller id, so of each distinct vector
only the k + 1 smallest ids can be results and the others add nothing: a vector that a
third of the rows repeat costs k + 1 entries, without losing a result. Entries are dealt
into blocks of bounded size along the cells; a block meets the queries that see one of its cells,
as a vector and the least sum that they still see. Entries move once for each ``GROUP`` queries and
queries once for each block: what is moved is the work, rows times queries, divided by those sizes,
and for tables of up to 300,000 rows in proportion to the table.

:func:`search` runs jobs (deduplication, fit, index) when it is called.

Defined results: vectors that are null, all zero, of another length than most, or that hold
nulls, NaN or infinities take no part; rows that repeat an id and a vector are one row; an
id with several vectors is a candidate with each; fewer than k candidates give them all; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gradloom.llm.common import cut
from gradloom.workers import ship

CODES, MOST_CODES, SAMPLE, BLOCK, GROUP, SHARE = 64, 512, 10_000, 8192, 16_384, 0.6
_EPS = 1e-9
RESULT = "query_id long, rank int, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; empty centroids stay where they are."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = assign(x, c)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, want: int) -> tuple[list[int], float]:
    """Cells (i * len(second) + j) in falling order of first[i] + second[j] until they hold ``want`` entries; the last sum."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    held_in = counts.tolist()
    heap, out, held, last, width = [(-(x[0] + y[0]), 0, 0)], [], 0, math.inf, len(b)
    while heap and held < want:
        last, i, j = heapq.heappop(heap)
        cell = a[i] * width + b[j]
        if held_in[cell]:
            out.append(cell)
            held += held_in[cell]
        if not j and i + 1 < len(a):  # the row below begins when its upper neighbour's first cell is taken
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
        if j + 1 < width:
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
    return out, -last


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first dimension to the last: equal vectors score equal."""
    s = np.zeros(len(v))
    for d in range(v.shape[1]):
        s += q[:, d] * v[:, d]
    return s


def _matrix(column) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``vec_id, v`` of the usable rows, and the vectors' length."""
    kind = rows.schema[vector].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vector).cast("array<float>" if narrow else "array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    good = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)))
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = most["d"] if most else 0
    return good.where(F.size("v") == dims), dims


def search(rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", codes: int | None = None, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest of ``rows`` for each of ``queries`` (same columns), without the query's own id."""
    spark: SparkSession = rows.sparkSession
    ship(spark)
    good, dims = valid(rows, key, vector)
    if not dims:
        return spark.createDataFrame([], RESULT)
    kind = dict(good.dtypes)["v"]
    # of equal vectors the k + 1 smallest ids; the row limit works before the shuffle too
    same = Window.partitionBy("h").orderBy("vec_id", "v")
    entries = cut(good.dropDuplicates(["vec_id", "v"]).withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("vec_id", "v"), "entries")
    total = entries.count()
    asked = valid(queries, key, vector)[0].where(F.size("v") == dims).dropDuplicates(["vec_id", "v"])

    fit = np.array([r["v"] for r in entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()], dtype=np.float64)  # bounded sample
    half = max(1, dims // 2)
    codes = codes or max(CODES, min(MOST_CODES, math.isqrt(total) // 4))
    one, two = kmeans(fit[:, :half], codes), kmeans(fit[:, half:], codes) if dims > 1 else np.zeros((1, 0))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            own = assign(x[:, :half], one) * len(two) + assign(x[:, half:], two)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32())], names=["vec_id", "v", "cell"])

    indexed = cut(entries.mapInArrow(cells, f"vec_id long, v {kind}, cell int"), "index")
    counts = np.zeros(len(one) * len(two), dtype=np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most codes * codes rows
        counts[r["cell"]] = r["count"]
    want = max(4 * k, math.ceil(share * total))
    begin = np.cumsum(counts) - counts
    n_asked = asked.count()
    groups = max(1, math.ceil(n_asked / GROUP))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                x = _matrix(part.column(1))
                f, s = x[:, :half] @ one.T, x[:, half:] @ two.T
                blocks: list[int] = []
                of: list[int] = []
                least = np.empty(part.num_rows)
                for i in range(part.num_rows):
                    seen, least[i] = walk(f[i], s[i], counts, want)
                    firsts, lasts = begin[seen] // BLOCK, (begin[seen] + counts[seen] - 1) // BLOCK
                    own = sorted({y for u, v in set(zip(firsts.tolist(), lasts.tolist(), strict=True)) for y in range(u, v + 1)})
                    blocks += own
                    of += [i] * len(own)
                rows_of = part.take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), rows_of.column(2), rows_of.column(0), rows_of.column(1), pa.array(least[of])], names=["block", "grp", "query_id", "q", "least"])

    def rerank(entry: pa.Table, query: pa.Table) -> pa.Table:
        ids_out, found_out, score_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if entry.num_rows and query.num_rows:
            ids, v, cell = entry["vec_id"].to_numpy(), _matrix(entry["v"]), entry["cell"].to_numpy()
            i_of, j_of = np.divmod(cell, len(two))
            q, asked_ids, least = _matrix(query["q"]), query["query_id"].to_numpy(), query["least"].to_numpy()
            for at in range(0, len(q), 64):  # bounded: 64 queries and a block
                part, own = q[at : at + 64], asked_ids[at : at + 64]
                f, s = part[:, :half] @ one.T, part[:, half:] @ two.T
                sums = f[:, i_of] + s[:, j_of]
                scale = _EPS * (1 + np.abs(f).max() + (np.abs(s).max() if s.size else 0))
                scores = np.where((sums >= least[at : at + 64, None] - scale) & (ids[None] != own[:, None]), part @ v.T, -np.inf)
                for i, row in enumerate(scores):
                    near = row[row > -np.inf]
                    if not len(near):
                        continue
                    edge = np.partition(near, len(near) - k)[len(near) - k] if len(near) > k else near.min()
                    which = np.flatnonzero(row >= edge - _EPS * max(1.0, float(np.abs(near).max())))
                    exact = inner(np.broadcast_to(part[i], (len(which), part.shape[1])), v[which])
                    best = np.lexsort((ids[which], -exact))[:k]
                    ids_out.append(np.full(len(best), own[i]))
                    found_out.append(ids[which][best])
                    score_out.append(exact[best])
        return pa.table({"query_id": pa.array(np.concatenate(ids_out), pa.int64()), "vec_id": pa.array(np.concatenate(found_out), pa.int64()), "score": pa.array(np.concatenate(score_out), pa.float64())})

    starts = F.element_at(F.lit(begin.tolist()), F.col("cell") + 1)
    sizes = F.element_at(F.lit(counts.tolist()), F.col("cell") + 1)
    left = indexed.withColumn("block", F.floor((starts + F.pmod(F.xxhash64("vec_id"), sizes)) / BLOCK)).withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = asked.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups).cast("long"))).repartition(max(1, math.ceil(n_asked / 128)), "vec_id").mapInArrow(probes, f"block long, grp long, query_id long, q {kind}, least double")
    found = left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(rows: DataFrame) -> DataFrame:
    """The contract of ``op8_multi_index``: the 20 nearest of every row whose id is divisible by 20."""
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
