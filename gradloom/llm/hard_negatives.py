"""Hard negatives by bit-sliced integer products.

Components become integers (``floor(256 * c)``) in two's complement and are stored as bit-planes: of
each bit one packed word for 64 dimensions. A row's product with an anchor is summed over its
planes, the most significant first: a plane adds the count of bits that it shares with each plane of
the anchor, and what the planes below can still add lies between the sums of the anchor's negative and
positive components times the value of those planes. So every candidate has an interval that halves with
each plane. It is dropped once the interval lies outside of what is asked for, or below the k-th best of those
that certainly qualify; what is left after the last plane is exact.

What is asked for are *goals* of an anchor: the first ``k`` rows of its own label (its positives), or of
other labels with a score between two bounds (negatives of one positive). Rows are dealt into blocks of bounded
size and anchors into groups; a block meets a group in one task, and gives at most ``k`` rows for each goal. A
sixteenth of the rows is searched first, so that the others start from a bound that an anchor has
already reached, and give few rows that the end drops. What is moved is a row's planes (80 bytes for 64 dimensions of 10
bits) for each group of ``GROUP`` anchors.

:func:`mine` runs jobs (bit width, index, positives) when it is called.

Defined results: rows with a null label, a null or empty vector, a vector of another length than most, null or non-finite
components, or components so large that a product need not fit in a long take no part; a row without an id takes no part; rows that
repeat an id, a label and a vector are one row; an id that has several of them is a candidate, and an anchor, with
each; an anchor without rows of its label, or positives without negatives in range, give no rows; an empty table
gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gradloom.llm.common import cut
from gradloom.workers import ship

SCALE, BLOCK, GROUP, FIRST = 256, 8192, 4096, 16
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FAR = 2**62


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """``vec_id, label, q`` (array of long) of the rows that take part, and the vectors' length."""
    kind = rows.schema[vector].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vector).cast("array<float>" if narrow else "array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    good = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v")).where(F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = most["d"] if most else 0
    widest = math.isqrt(_FAR // max(1, dims)) // 2  # a product of two such rows fits in a long, and so do its interval's ends
    q = F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    flipped = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10).cast("long"))).otherwise(F.col("label"))
    out = good.where(F.size("v") == dims).select("vec_id", flipped.alias("label"), q.alias("q"))
    return out.where(F.forall("q", lambda c: F.abs(c) < widest)), dims


def planes(q: np.ndarray, bits: int) -> np.ndarray:
    """Bit-planes of ``q`` (rows x dims) in two's complement: bits x words x rows, the least significant plane first."""
    words = -(-q.shape[1] // 64)
    out = np.empty((bits, words, len(q)), dtype=np.uint64)
    for k in range(bits):
        bytes_ = np.packbits((q >> k) & 1, axis=1)
        wide = np.zeros((len(q), words * 8), dtype=np.uint8)
        wide[:, : bytes_.shape[1]] = bytes_
        out[k] = wide.view(np.uint64).T
    return out


def weights(bits: int) -> list[int]:
    """The value of each plane; that of the sign is negative."""
    return [2**k for k in range(bits - 1)] + [-(2 ** (bits - 1))]


def best(ids: np.ndarray, labels: np.ndarray, sliced: np.ndarray, anchor: np.ndarray, anchor_id: int, label: int, low_sum: int, high_sum: int, same: bool, k: int, goals: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each goal (least score, greatest score, bound already reached) the first ``k`` rows: their places and scores.

    ``sliced`` are the block's planes, ``anchor`` the anchor's (bits x words), ``low_sum`` and ``high_sum`` the sums
    of its negative and positive components.
    """
    bits, value = len(sliced), weights(len(sliced))
    at = np.flatnonzero(((labels == label) == same) & (ids != anchor_id))
    score = np.zeros(len(at), dtype=np.int64)
    used = [j for j in range(bits) if anchor[j].any()]
    for p in range(bits - 1, -1, -1):
        here = sliced[p][:, at]
        for j in used:
            shared = np.bitwise_count(here & anchor[j][:, None])
            score += (value[p] * value[j]) * (shared[0] if len(shared) == 1 else shared.sum(0)).astype(np.int64)
        below = 2**p - 1
        low, high = score + low_sum * below, score + high_sum * below
        keep = np.zeros(len(at), dtype=bool)
        for least, greatest, reached in goals:
            bound = max(least, reached)
            if (high_sum - low_sum) * below <= greatest - least:  # else no interval lies within
                sure = low[(low >= least) & (high <= greatest)]
                if len(sure) > k:
                    bound = max(bound, int(np.partition(sure, len(sure) - k)[len(sure) - k]))
            keep |= (high >= bound) & (low <= greatest)
        if not keep.all():
            at, score = at[keep], score[keep]
        if not len(at):
            break
    out = []
    for least, greatest, reached in goals:
        fit = np.flatnonzero((score >= max(least, reached)) & (score <= greatest))
        first = fit[np.lexsort((ids[at[fit]], -score[fit]))[:k]]
        out.append((at[first], score[first]))
    return out


def search(indexed: DataFrame, anchors: DataFrame, bits: int, words: int, k: int, same: bool, rows: int, n_anchors: int) -> DataFrame:
    """``anchor, goal, vec_id, score``: the first ``k`` of ``indexed`` (vec_id, label, planes) for each goal of each anchor.

    ``anchors``: anchor (its number), vec_id, label, planes, low_sum, high_sum, goals (array of least, greatest, reached).
    """
    blocks, groups = max(1, math.ceil(rows / BLOCK)), max(1, math.ceil(n_anchors / GROUP))

    def run(block: pa.Table, group: pa.Table) -> pa.Table:
        found: dict[str, list] = {"anchor": [], "goal": [], "vec_id": [], "score": []}
        if block.num_rows and group.num_rows:
            ids, labels = block["vec_id"].to_numpy(), block["label"].to_numpy()
            sliced = np.ascontiguousarray(np.frombuffer(b"".join(block["planes"].to_pylist()), dtype=np.uint64).reshape(len(ids), bits, words).transpose(1, 2, 0))
            for a in group.select(["anchor", "vec_id", "label", "planes", "low_sum", "high_sum", "goals"]).to_pylist():
                goals = [(g["least"], g["greatest"], g["reached"]) for g in a["goals"]]
                own = np.frombuffer(a["planes"], dtype=np.uint64).reshape(bits, words)
                for i, (at, score) in enumerate(best(ids, labels, sliced, own, a["vec_id"], a["label"], a["low_sum"], a["high_sum"], same, k, goals)):
                    found["anchor"].append(np.full(len(at), a["anchor"]))
                    found["goal"].append(np.full(len(at), i))
                    found["vec_id"].append(ids[at])
                    found["score"].append(score)
        none = [np.empty(0, np.int64)]
        return pa.table({n: pa.array(np.concatenate(v or none).astype(np.int64)) for n, v in found.items()})

    left = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id", "label"), F.lit(blocks).cast("long"))).withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = anchors.withColumn("grp", F.pmod(F.xxhash64("anchor"), F.lit(groups).cast("long"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(run, "anchor long, goal long, vec_id long, score long")


def first_of_goals(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank``, up to ``k`` for each goal of an anchor."""
    w = Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _goal(least: Column, greatest: Column) -> Column:
    return F.struct(least.cast("long").alias("least"), greatest.cast("long").alias("greatest"), F.lit(-_FAR).cast("long").alias("reached"))


def _two_rounds(indexed: DataFrame, anchors: DataFrame, bits: int, words: int, k: int, same: bool, rows: int, n: int) -> DataFrame:
    """The first ``k`` for each goal: a share of the rows first, the others from the bound reached there."""
    share = F.pmod(F.xxhash64(F.lit("first"), F.col("vec_id")), F.lit(FIRST)) == 0
    first = cut(first_of_goals(search(indexed.where(share), anchors, bits, words, k, same, -(-rows // FIRST), n), k).drop("rank"), "first")
    full = first.groupBy("anchor", "goal").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("reached")).where(F.col("n") == k)
    bound = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("goal", "reached"))).alias("bounds"))  # a goal for each positive at most
    tight = F.transform("goals", lambda g, i: g.withField("reached", F.coalesce(F.try_element_at("bounds", i.cast("long")), g["reached"])))
    later = anchors.join(bound, "anchor", "left").withColumn("goals", F.when(F.col("bounds").isNull(), F.col("goals")).otherwise(tight)).drop("bounds")
    return first_of_goals(first.unionByName(search(indexed.where(~share), later, bits, words, k, same, rows, n)), k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``RESULT``: for each anchor (a condition on ``vec_id``) and each of its first ``positives`` rows of the same label, the
    first ``negatives`` rows of other labels whose score is between ``least`` and ``most`` hundredths of the positive's."""
    spark: SparkSession = rows.sparkSession
    ship(spark)
    good, dims = quantised(rows, key, vector, label)
    if not dims:
        return spark.createDataFrame([], RESULT)
    good = cut(good.dropDuplicates(["vec_id", "label", "q"]), "quantised")
    stated = good.agg(F.count(F.lit(1)), F.max(F.array_max("q")), F.min(F.array_min("q"))).first()
    if not stated[0]:
        return spark.createDataFrame([], RESULT)
    total, bits, words = stated[0], max(stated[1], -stated[2] - 1, 0).bit_length() + 1, -(-dims // 64)

    def slice_(batches):
        for b in batches:
            q = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            packed = np.ascontiguousarray(planes(q, bits).transpose(2, 0, 1))
            low, high = np.minimum(q, 0).sum(1), np.maximum(q, 0).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(low), pa.array(high)], names=["vec_id", "label", "planes", "low_sum", "high_sum"])

    sliced = cut(good.select("vec_id", "label", "q").mapInArrow(slice_, "vec_id long, label long, planes binary, low_sum long, high_sum long"), "planes")
    indexed = sliced.select("vec_id", "label", "planes")
    everything = F.array(_goal(F.lit(-_FAR), F.lit(_FAR)))
    anchors = cut(sliced.where(is_anchor).select(F.xxhash64("vec_id", "label", "planes").alias("anchor"), "*").withColumn("goals", everything), "anchors")
    n = anchors.count()

    near = cut(_two_rounds(indexed, anchors, bits, words, positives, True, total, n), "positives")
    each = F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))))
    pairs = near.groupBy("anchor").agg(each.alias("found"))  # ``positives`` at most
    # 100 * score is at least ``least`` and at most ``most`` times the positive's: bounds as whole numbers, as products of integers
    goals = F.transform("found", lambda p: _goal(F.ceil(p["positive_score"].cast("decimal(28,0)") * least / 100), F.floor(p["positive_score"].cast("decimal(28,0)") * most / 100)))
    asked = cut(anchors.drop("goals").join(pairs, "anchor").withColumn("goals", goals), "goals")
    hard = _two_rounds(indexed, asked.drop("found"), bits, words, negatives, False, total, n)
    of = asked.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("found").alias("goal", "p")).withColumn("goal", F.col("goal").cast("long"))
    return hard.join(of, ["anchor", "goal"]).select("anchor_id", "p.positive_id", "rank", F.col("vec_id").alias("negative_id"), "p.positive_score", F.col("score").alias("negative_score"))


def op11(rows: DataFrame) -> DataFrame:
    """The contract of ``op11_bit_sliced``: anchors are the rows whose id is divisible by 100."""
    return mine(rows, F.col("vec_id") % 100 == 0)
