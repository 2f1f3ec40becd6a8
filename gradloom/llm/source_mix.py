"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; a flow
routes the patterns' tokens to the sources' quotas. A pattern can be used up to three times
and each repetition costs more than the one before (convex costs), so documents repeat only
where a quota needs it and where overlap leaves least to repeat. Within a pattern, documents
are ordered by a seeded hash; thresholds on that hash, exact to one document, realise the
flow. All that reaches the driver has the size of the patterns, whose number is checked.

Defined results: a null text has size 0; a document of size 0 takes no words and follows its
hash like any other; sources are ordered by
code point, null last; rows that repeat a key have the same hash and are taken or left
together (so are rows without a key); the same input and seed give the same mix whatever
the partitions; an empty table gives an empty mix; other columns are kept by :func:`select`.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.llm.common import GAP, cut, fresh

MOST = 3  # times a document may be used
COSTS = (0, 1, 3)  # of the first, second and third use: convex
MAX_PATTERNS = 20_000
_BITS = 48  # of a 60-bit hash below its bucket: 4096 buckets


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the whole by weight; what exceeds ``most`` times a source's size is shared anew by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def min_cost_flow(capacity: list[int], member: list[list[int]], quota: list[int], costs: tuple[int, ...] = COSTS) -> list[dict[int, int]]:
    """Tokens that each pattern gives to each of its sources: as much of the quotas as can be met,
    at least cost. Successive shortest paths with potentials; pattern p has an arc of its
    capacity for each use, with that use's cost."""
    n_p, n_s = len(capacity), len(quota)
    end = 1 + n_p + n_s
    graph: list[list[list[int]]] = [[] for _ in range(end + 1)]  # to, capacity, cost, place of the reverse arc

    def arc(a: int, b: int, cap: int, cost: int) -> None:
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, cap in enumerate(capacity):
        for cost in costs:
            arc(0, 1 + p, cap, cost)
        for s in member[p]:
            arc(1 + p, 1 + n_p + s, sum(capacity) * len(costs) + 1, 0)
    for s, q in enumerate(quota):
        arc(1 + n_p + s, end, q, 0)
    height = [0] * (end + 1)
    while True:
        far, came = [math.inf] * (end + 1), [None] * (end + 1)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i, (b, cap, cost, _) in enumerate(graph[a]):
                if cap and (new := d + cost + height[a] - height[b]) < far[b]:
                    far[b], came[b] = new, (a, i)
                    heapq.heappush(heap, (new, b))
        if far[end] == math.inf:
            break
        height = [h + (f if f < math.inf else 0) for h, f in zip(height, far, strict=True)]
        push, b = math.inf, end
        while b:
            a, i = came[b]
            push, b = min(push, graph[a][i][1]), a
        b = end
        while b:
            a, i = came[b]
            graph[a][i][1] -= push
            graph[b][graph[a][i][3]][1] += push
            b = a
    out: list[dict[int, int]] = [{} for _ in range(n_p)]
    for p in range(n_p):
        for b, _, _, back in graph[1 + p]:
            if b > n_p and b != end and (f := graph[b][back][1]):
                out[p][b - 1 - n_p] = f
    return out


@dataclass(frozen=True)
class Plan:
    """``rows``: pattern, its source, whole uses and the hash threshold that end the source's share."""

    rows: list[tuple[int, int, int, int]]
    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    patterns: list[tuple[str | None, ...]]


def _hash(key: str, seed: int) -> Column:
    """60 bits of an MD5, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame, key: str, size: Column, sources: Column, seed: int) -> DataFrame:
    """key, size, pattern and hash of every row: all that planning needs of the corpus."""
    return docs.select(F.col(key).alias("key"), size.cast("long").alias("size"), F.array_sort(F.array_distinct(sources)).alias("pattern"), _hash(key, seed).alias("h"))


def make_plan(sized: DataFrame, weight=lambda i: 1 + i % 3, most: int = MOST) -> Plan:
    """Reads ``sized`` (see :func:`_sized`, written to the shared folder) a few times, all by partial aggregation."""
    by = sized.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(by) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; group the sources first")
    order = lambda x: (x is None, (x or "").encode())
    by.sort(key=lambda r: [order(x) for x in r["pattern"]])
    patterns, caps = [tuple(r["pattern"]) for r in by], [int(r["n"] or 0) for r in by]
    sources = sorted({x for p in patterns for x in p}, key=order)
    at = {s: i for i, s in enumerate(sources)}
    member = [[at[x] for x in p] for p in patterns]
    # a document counts for its first source in sizes and total, so that overlap is not counted twice
    sizes = [0] * len(sources)
    for m, c in zip(member, caps, strict=True):
        if m:
            sizes[m[0]] += c
    goal = targets(sizes, [weight(i) for i in range(len(sources))], most)
    flow = min_cost_flow(caps, member, [round(t) for t in goal], COSTS[:most])
    ends, borders = [], []
    for p, f in enumerate(flow):
        total = 0
        for s in sorted(f):
            total += f[s]
            whole, rest = divmod(total, caps[p])
            ends.append((p, s, whole, rest))
            if rest:
                borders.append((p, len(ends) - 1, rest))
    cuts = _thresholds(sized, patterns, borders) if borders else {}
    return Plan([(p, s, whole, cuts.get(i, -1)) for i, (p, s, whole, _) in enumerate(ends)], sources, sizes, goal, patterns)


def _pattern_rows(df: DataFrame, patterns: list[tuple]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(i, list(p)) for i, p in enumerate(patterns)], "pid int, pattern array<string>")


def _null_safe(pattern: Column) -> Column:
    """Arrays with null elements do not join as equal; their JSON text does."""
    return F.to_json(pattern, {"ignoreNullFields": "false"})


def _with_pid(df: DataFrame, patterns: list[tuple]) -> DataFrame:
    ids = _pattern_rows(df, patterns).select("pid", _null_safe(F.col("pattern")).alias("pj"))
    return df.withColumn("pj", _null_safe(F.col("pattern"))).join(F.broadcast(ids), "pj").drop("pj")  # at most MAX_PATTERNS rows


def _thresholds(sized: DataFrame, patterns: list[tuple], borders: list[tuple[int, int, int]]) -> dict[int, int]:
    """The hash up to which a pattern's documents hold ``rest`` tokens, for each border.

    A histogram over 4096 hash buckets finds the bucket of each border; only that bucket's
    documents are put in order, and the document nearest to the border decides.
    """
    spark = sized.sparkSession
    rows = _with_pid(sized, patterns).withColumn("bucket", F.shiftright("h", _BITS))
    hist = cut(rows.groupBy("pid", "bucket").agg(F.sum("size").alias("n")), "histogram")
    w = Window.partitionBy("pid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = spark.createDataFrame(borders, "pid int, border int, rest long")
    crossing = hist.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(wanted), "pid").where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
    crossing = crossing.select("pid", "bucket", "border", (F.col("rest") - F.col("upto") + F.col("n")).alias("need"))
    inside = cut(rows.join(F.broadcast(crossing), ["pid", "bucket"]).groupBy("border", "need", "bucket", "h").agg(F.sum("size").alias("n")), "border")
    v = Window.partitionBy("border").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    taken = inside.withColumn("upto", F.sum("n").over(v)).withColumn("in", F.col("upto") - F.col("n") / 2 <= F.col("need"))
    # nothing of the bucket: the threshold is just before it
    best = taken.groupBy("border", "bucket").agg(F.max(F.when(F.col("in"), F.col("h"))).alias("h"))
    return {r["border"]: r["h"] if r["h"] is not None else (r["bucket"] << _BITS) - 1 for r in best.collect()}


def _with_uses(df: DataFrame, plan: Plan, pattern: Column, h: Column, uses: str) -> DataFrame:
    """``df`` with how often a document is used, by its pattern's last border; a pattern is a row of a
    small table (at most ``MAX_PATTERNS``), and every row of ``df`` stays."""
    last: dict[int, tuple[int, int]] = {}
    for p, _, whole, cut_ in plan.rows:
        last[p] = max(last.get(p, (0, -1)), (whole, cut_))
    pj, whole, cut_at = fresh(df, "__pj", "__whole", "__cut")
    rows = _pattern_rows(df, plan.patterns).select("pid", _null_safe(F.col("pattern")).alias(pj))
    ends = df.sparkSession.createDataFrame([(p, *x) for p, x in last.items()], f"pid int, {whole} long, {cut_at} long")
    joined = df.withColumn(pj, _null_safe(pattern)).join(F.broadcast(rows.join(ends, "pid").drop("pid")), pj, "left")
    n = F.coalesce(F.col(whole) + (h <= F.col(cut_at)).cast("int"), F.lit(0)).cast("long")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], n.alias(uses))


def mix(docs: DataFrame, key: str = "doc_id", size: Column | None = None, sources: Column | None = None, seed: int = 7, weight=lambda i: 1 + i % 3) -> tuple[DataFrame, Plan]:
    """(key, size, pattern, uses of every row; the plan). The plan is made when this is called."""
    size = n_words(F.col("text")) if size is None else size
    sources = F.array("source") if sources is None else sources
    sized = cut(_sized(docs, key, size, sources, seed), "sized")
    plan = make_plan(sized, weight)
    return _with_uses(sized, plan, F.col("pattern"), F.col("h"), "uses").select("key", "size", "pattern", "uses"), plan


def select(docs: DataFrame, key: str = "doc_id", text_col: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix uses it."""
    _, plan = mix(docs, key, n_words(F.col(text_col)), F.array(F.col(source)), seed)
    copy, uses = fresh(docs, "__copy", "__uses")
    used = _with_uses(docs, plan, F.array(F.col(f"`{source}`").cast("string")), _hash(key, seed), uses).where(F.col(uses) > 0)
    return used.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(uses)))).drop(copy, uses)


def op7(docs: DataFrame) -> DataFrame:
    """The contract of ``op7_flow_mix``: each document belongs to one source."""
    rows, plan = mix(docs)
    spark = docs.sparkSession
    info = spark.createDataFrame([([s], z, t) for s, z, t in zip(plan.sources, plan.sizes, plan.targets, strict=True)] or [([""], 0, 0.0)], "pj array<string>, source_size long, target double").withColumn("pj", _null_safe(F.col("pj")))
    joined = rows.withColumn("pj", _null_safe(F.col("pattern"))).join(F.broadcast(info), "pj")  # a row for each source, at most MAX_PATTERNS
    return joined.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("uses")).alias("taken"))
