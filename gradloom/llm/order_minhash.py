"""Near-duplicate classes by Order MinHash and banded alignment.

k-mers are runs of five words, labelled by which occurrence they are in their text. A
sketch takes the three labelled k-mers with the least hashes and keeps them in text order
(Marcais et al.'s OMH), so two texts share it with a probability that falls with their edit
distance. Texts that share one of 16 sketches are candidates. A candidate pair is verified
by aligning the two k-mer sequences: as labels make every k-mer unique, the best alignment
inside the band of diagonals that the threshold allows is a longest increasing subsequence.
Texts are linked when the aligned k-mers are 0.8 or more of all k-mers of the two.

At similarity 0.8 a pair misses all 16 sketches once in 90,000 pairs, at 0.9 never in
practice. Equal texts are one node, so copies never meet. A bucket of n nodes first gives at
most 3 n pairs. Its hub is the node that shares most sketches over all buckets: in a group of
variants that is the original, whose sketches most variants keep. Each node meets the
bucket's hub; buckets are dealt into parts of about 64, in which each node also meets the
part's first and its neighbour. Pairs are verified in two rounds, first each node's most
frequent partner, then those that still connect different components.

What is left are nodes of buckets that hold several components. For these an exact join by
prefixes follows, whose rows grow with the nodes and not with the square of a bucket: each
text's k-mers are put in one order of all texts, the rarest first; two texts as similar as 0.8
share a k-mer among the first ninth of the smaller one's and the first fifth of the larger
one's, and where they first do, enough must be left on both sides. Of the pairs that pass, those
between components are verified until none is left: the classes are those of all pairs that share
a sketch.

Defined results: a null text is an empty one; texts without words are only equal to texts
of the same characters; a text of fewer than five words is a single k-mer. Nodes are
128-bit hashes of whole texts. Every input row gives one row, also rows that repeat a key
or have none; a class is named by the least key of its rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.llm.common import cut, fresh
from gradloom.operators.graph import components
from gradloom.workers import batches_of, ship

K, SKETCHES, MINIMA, SIMILAR, PART, FEW = 5, 16, 3, 0.8, 64, 10_000
SLOTS = 1 << 16  # of the table of k-mer frequencies
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, (SKETCHES, 2), dtype=np.uint64) | np.uint64(1)
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes(text: str | None) -> np.ndarray:
    """A 32-bit hash of each word; bytes.split() cuts at just the blanks that end a word."""
    return np.fromiter(map(zlib.crc32, (text or "").encode("utf-8", "surrogatepass").split()), dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Occurrence-labelled k-mers, in text order; all distinct."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = words.astype(np.uint64)
    size = min(k, n)
    h = np.zeros(n - size + 1, dtype=np.uint64)
    for i in range(size):
        h = (h + w[i : n - size + 1 + i] + np.uint64(1)) * _P
        h ^= h >> np.uint64(29)
    h = _mix(h + np.uint64(size))
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if not new.all():
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        nth = np.empty(len(s), dtype=np.uint64)
        nth[order] = np.arange(len(s)) - first
        h = np.where(nth > 0, _mix(h + nth * _P), h)
    return h


def sketches(labelled: np.ndarray) -> np.ndarray:
    """One 64-bit key for each sketch: its minima in text order."""
    n = min(MINIMA, len(labelled))
    if not n:
        return np.empty(0, dtype=np.int64)
    out = np.empty(SKETCHES, dtype=np.uint64)
    top = np.uint64(np.iinfo(np.uint64).max)
    for i, (a, b) in enumerate(_SEEDS):
        x = labelled * a + b
        x ^= x >> np.uint64(32)
        at = []
        for _ in range(n):
            j = int(x.argmin())
            at.append(j)
            x[j] = top
        key = np.array([i + 1], dtype=np.uint64)
        for j in sorted(at):
            key = _mix((key + labelled[j]) * _P)
        out[i] = key[0]
    return out.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> int:
    """The most k-mers of ``a`` and ``b`` that align in order, off the diagonal no further than
    ``similar`` allows: a pair as similar as that leaves no more k-mers unaligned on either side."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = len(a) + len(b) - 2 * int(np.ceil(similar / (1 + similar) * (len(a) + len(b))))
    near = np.abs(i - j) <= band
    order = np.argsort(i[near], kind="stable")
    seq = j[near][order]
    if len(seq) < 2 or (np.diff(seq) > 0).all():
        return len(seq)
    tails: list[int] = []
    for x in seq.tolist():
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x)
        else:
            tails[at] = x
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> float:
    if not len(a) or not len(b):
        return 0.0
    if min(len(a), len(b)) < similar * max(len(a), len(b)):
        return 0.0
    s = aligned(a, b, similar)
    return s / (len(a) + len(b) - s)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, keys = [], []
        for text in b.column(1):
            labelled = kmers(word_hashes(text.as_py()))
            sizes.append(len(labelled))
            keys.append(sketches(labelled))
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)]), pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), lists], names=["node", "n", "ks"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_hashes(t.as_py()).astype("<u4").tobytes() for t in b.column(1)], pa.binary())], names=["node", "words"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = (kmers(np.frombuffer(z.as_buffer(), dtype="<u4")) for z in (x, y))
            scores.append(similarity(x, y))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], names=["a", "b", "score"])


def _fits(n: Column | str, m: Column | str) -> Column:
    """Whether two sizes allow a link."""
    return F.least(n, m) >= SIMILAR * F.greatest(n, m)


def candidates(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, votes``: node pairs of the buckets ``k, node, n`` whose sizes allow a link, three of a
    node at most; and the buckets of two nodes or more, with their sizes ``c``."""
    most = bands.count()
    many = cut(bands.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets", most // 2)
    shared = cut(bands.join(many, "k"), "shared", most)
    most = shared.count()
    known = cut(shared.groupBy("node").agg(F.sum("c").alias("known")), "known", most)
    ranked = cut(shared.join(known, "node"), "ranked", most)
    hub = cut(ranked.groupBy("k").agg(F.max(F.struct("known", "node", "n")).alias("h")).select("k", F.struct("h.node", "h.n").alias("hub")), "hubs", most // 2)
    members = ranked.join(hub, "k").withColumn("part", F.pmod(F.xxhash64("node", "k", F.lit(1)), F.ceil(F.col("c") / PART)))
    members = members.repartition("k", "part")
    w = Window.partitionBy("k", "part").orderBy(F.desc("known"), F.xxhash64("node", "k"), "node")
    me = F.struct("node", "n")
    met = members.select("hub", me.alias("me"), F.first(me).over(w).alias("first"), F.lag(me).over(w).alias("before"))
    other = F.array_distinct(F.array(F.col("hub"), F.col("first"), F.coalesce("before", "hub")))
    each = met.select("me", F.explode(other).alias("to")).where("me.node != to.node").where(_fits("me.n", "to.n"))
    return each.groupBy(F.least("me.node", "to.node").alias("a"), F.greatest("me.node", "to.node").alias("b")).agg(F.count(F.lit(1)).alias("votes")), shared


def _links(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    left = seqs.select(F.col("node").alias("a"), F.col("words").alias("x"))
    right = seqs.select(F.col("node").alias("b"), F.col("words").alias("y"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(_verify, "a binary, b binary, score double").where(F.col("score") >= SIMILAR).select("a", "b")


def _best(pairs: DataFrame) -> DataFrame:
    """Each node's most frequent partner, as distinct pairs."""
    ends = pairs.select(F.col("a").alias("me"), "a", "b", "votes").unionByName(pairs.select(F.col("b").alias("me"), "a", "b", "votes"))
    top = ends.groupBy("me").agg(F.max(F.struct("votes", "a", "b")).alias("t"))
    return top.select("t.a", "t.b").distinct()


def _apart(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components, with these as ``ca, cb``."""
    a, b = (group.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
    return both.where("ca != cb")


def _slots(labelled: np.ndarray) -> np.ndarray:
    return (labelled >> np.uint64(48)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, dtype=np.int64)
    for b in batches:
        for w in b.column(0):
            np.add.at(counts, _slots(kmers(np.frombuffer(w.as_buffer(), dtype="<u4"))), 1)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(counts[slots], pa.int64())], names=["slot", "n"])


def prefix(labelled: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The k-mers that meet those of smaller texts, in the order of ``rank``; how many of these meet larger ones."""
    n = len(labelled)
    first = labelled[np.lexsort((labelled, rank[_slots(labelled)]))[: n - _least(SIMILAR * n) + 1]]
    return first, n - _least(2 * SIMILAR / (1 + SIMILAR) * n) + 1


def _least(x: float) -> int:
    """``x`` rounded up, but for what the product of doubles adds."""
    return int(np.ceil(x - 1e-9))


def _unmet(nodes: DataFrame, rank: np.ndarray) -> DataFrame:
    """``a, b, ca, cb``: the pairs of ``nodes`` (node, component, words) that lie in different components (``ca, cb``) and share
    a k-mer of their prefixes where enough of both is left for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                labelled = [kmers(np.frombuffer(w.as_buffer(), dtype="<u4")) for w in part.column(2)]
                firsts = [prefix(x, rank) for x in labelled]
                sizes = np.array([len(f) for f, _ in firsts])
                of = np.repeat(np.arange(part.num_rows), sizes)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = [
                    pa.array(np.concatenate([f for f, _ in firsts]).view(np.int64)), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(np.array([len(x) for x in labelled], np.int32)[of]),
                    pa.array(nth.astype(np.int32)), pa.array(nth < np.array([short for _, short in firsts])[of]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["kmer", "node", "component", "n", "nth", "short"])

    rows = cut(nodes.select("node", "component", "words").mapInArrow(run, "kmer long, node binary, component binary, n int, nth int, short boolean"), "prefixes")
    large, small = (rows.select("kmer", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "component", "n", "nth", "short")]) for x in "ab")
    smaller = (F.col("b_n") < F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.col("b_node") < F.col("a_node")))
    enough = F.least(F.col("a_n") - F.col("a_nth"), F.col("b_n") - F.col("b_nth")) >= SIMILAR / (1 + SIMILAR) * (F.col("a_n") + F.col("b_n")) - 1e-9
    met = large.join(small.where("b_short").drop("b_short"), "kmer").where(smaller & (F.col("a_component") != F.col("b_component")) & _fits("a_n", "b_n") & enough)
    ends = [F.struct(F.col(f"{x}_node").alias("node"), F.col(f"{x}_component").alias("component")) for x in "ab"]
    met = met.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb")).distinct()


def _mixed(shared: DataFrame, group: DataFrame) -> DataFrame:
    """``node, component``: the nodes of buckets that hold several components; of three nodes or fewer all pairs are candidates."""
    of = shared.where("c > 3").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = of.groupBy("k").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("k")
    return of.join(several, "k", "left_semi").select("node", "component").distinct()


def _settle(shared: DataFrame, tried: DataFrame, links: DataFrame, n_links: int, group: DataFrame, seqs: DataFrame, n_nodes: int) -> DataFrame:
    """``group``, once no pair of a bucket that may be a link is unverified between two components.

    Up to ``FEW`` pairs, or one for every four nodes, are verified at once. Of more, first one for each
    two components is, then 16 times as many in each round: what these link, the other pairs need not. Pairs carry their ends'
    components and meet ``group`` again only where a round has changed it.
    """
    nodes = cut(seqs.join(_mixed(shared, group), "node"), "mixed")
    few = max(FEW, n_nodes // 4)
    counts = nodes.select("words").mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most SLOTS rows
    if not counts:
        return group
    rank = np.zeros(SLOTS, dtype=np.int64)
    rank[[r["slot"] for r in counts]] = [r["n"] for r in counts]
    rest = cut(_unmet(nodes, np.unique(rank, return_inverse=True)[1].astype(np.uint16)).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "unmet")
    n, share = rest.count(), 1
    while n:
        some = rest.select("a", "b")
        if n > few:
            two = (F.least("ca", "cb"), F.greatest("ca", "cb"), F.pmod(F.xxhash64("a", "b"), F.lit(share)))
            some = cut(rest.groupBy(*two).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"), "some", n)
        found = cut(_links(some, seqs), "links")
        n_found = found.count()
        if n_found:
            links, n_links = links.unionByName(found), n_links + n_found
            group = cut(components(links, most=n_links), "components", 2 * n_links)
        if n <= few:
            break
        rest = rest.join(some, ["a", "b"], "left_anti")
        rest = cut(_apart(rest.select("a", "b"), group).select("a", "b", "ca", "cb") if n_found else rest, "unmet", n)
        n, share = rest.count(), 16 * share
    return group


def node_of(text: Column) -> Column:
    """128 bits of a whole text."""
    return F.unhex(F.md5(text))


def classes(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, class_id, class_size, is_first`` for every row; ``class_id`` is the least key of its class.

    ``is_first`` is true for one row of each class, the one to keep (all rows with the least
    key and the same text, if such rows repeat)."""
    ship(docs.sparkSession)
    with batches_of(docs.sparkSession, 500):
        return _classes(docs, key, text_col)


def _classes(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """All that needs Python workers runs in here, into tables of the shared folder; what is returned joins them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), node_of(text).alias("node"), text.alias("text"))
    sketched = rows.select("node", "text").mapInArrow(_sketch, "node binary, n int, ks array<long>")
    once = sketched.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("ks").alias("ks"))
    bands = cut(once.select(F.explode("ks").alias("k"), "node", "n"), "bands")
    pairs, shared = candidates(bands)
    pairs = cut(pairs, "pairs")
    # the texts of nodes that share a bucket, one row for each: of a node's rows the one with the least key
    named = cut(rows.groupBy("node").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("copies")), "nodes")
    n_nodes = named.count()
    wanted = cut(named.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.col("low").alias("key")), "wanted", n_nodes)
    # always a merge join: the plan, and what it moves, is the same at every size
    chosen = rows.alias("r").join(wanted.alias("w").hint("merge"), (F.col("r.node") == F.col("w.node")) & F.col("r.key").eqNullSafe(F.col("w.key")), "left_semi").select("node", "text")
    seqs = cut(chosen.mapInArrow(_words, "node binary, words binary").dropDuplicates(["node"]), "words")
    first = cut(_links(_best(pairs), seqs), "links")
    n_first = first.count()
    group = cut(components(first, most=n_first), "components", 2 * n_first)
    second = cut(_links(_apart(pairs, group), seqs), "links")
    n_second = second.count()
    links, n_links = first.unionByName(second), n_first + n_second
    if n_second:
        group = cut(components(links, most=n_links), "components", 2 * n_links)
    group = _settle(shared, pairs, links, n_links, group, seqs, n_nodes)
    of = cut(named.join(group, "node", "left").select("node", "low", "copies", F.coalesce("component", "node").alias("component")), "classes", n_nodes)
    named_class = cut(of.groupBy("component").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("low").isNull(), "low", "node")).alias("keep")), "class-names", n_nodes)
    per_node = cut(of.join(named_class, "component").select("node", "class_id", "class_size", F.col("keep.node").alias("keep"), "low"), "per-node", n_nodes)
    out = rows.select("key", "node").join(per_node, "node")
    return out.select(F.col("key").alias(key), "class_id", "class_size", ((F.col("node") == F.col("keep")) & F.col("key").eqNullSafe(F.col("low"))).alias("is_first"), "node")


def keep_one(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class (see :func:`classes`); rows that repeat key and text are one.

    What to keep is a small table of nodes and keys; the texts meet it in one join.
    """
    kept = cut(classes(docs, key, text_col).where("is_first").select("node", F.col(key).alias("k")).distinct(), "kept")
    node = node_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    n, k = fresh(docs, "__node", "__key")
    kept = kept.select(F.col("node").alias(n), F.col("k").alias(k)).hint("merge")
    joined = docs.join(kept, (node == F.col(n)) & F.col(f"`{key}`").cast("long").eqNullSafe(F.col(k)))
    return joined.dropDuplicates([n, k]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3(docs: DataFrame) -> DataFrame:
    """One row for each document with its class."""
    return classes(docs).select("doc_id", "class_id", "class_size", "is_first")
