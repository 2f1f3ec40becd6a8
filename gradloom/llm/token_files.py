"""Token-id files in patched frame-of-reference blocks.

Ids are cut into blocks of 128. A block subtracts its minimum, packs the differences at the
width that a percentile of them fits, and stores the others as exceptions (position and
whole difference). A file holds one segment of a sorted corpus:

    "PFR1" | u32 block size | u64 documents | u64 ids | u64 blocks
    | i64 document ids | u8 whether a document id is null | u64 ids of each document
    | u64 start of each block (from the first block's start; one more for the end) | blocks

    block: u32 minimum | u8 width | u8 0 | u16 exceptions | 16 * width bytes | u8 positions | u32 differences

The index of block starts gives access to any range of ids without decoding the rest
(:func:`read_range`). All numbers are little-endian.

A writing task names its files for its attempt and lists them in the manifest, which Spark
commits; files of attempts that were lost stand in no manifest and are never read.

Defined results: a null or empty text is its end id alone; null document ids come first;
rows that repeat a document id stand in an order that depends on their texts alone; an empty table gives no
files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradloom.llm.common import cut, new_path
from gradloom.llm.tokens import encoder
from gradloom.workers import batches_of, ship

BLOCK = 128
PERCENTILE = 0.9
_HEAD = struct.Struct("<4sIQQQ")
_AT_A_TIME = 1024  # blocks packed at once


def _widths(delta: np.ndarray, percentile: float) -> np.ndarray:
    at = int(np.ceil(percentile * BLOCK)) - 1
    return np.frexp(np.partition(delta, at, axis=1)[:, at].astype(np.float64))[1].astype(np.int64)  # bits


def _pack(delta: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 numbers as rows of 16 * width bytes."""
    if width in (8, 16, 32):  # the same bytes, without shifting
        return np.ascontiguousarray(delta).astype(f"<u{width // 8}").view(np.uint8).reshape(delta.shape[0], -1)
    lanes = np.ascontiguousarray(delta.T, dtype=np.uint64) & np.uint64((1 << width) - 1)
    words = np.zeros((2 * width, delta.shape[0]), dtype=np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(delta.shape[0], -1)


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.ascontiguousarray(rows).view(f"<u{width // 8}").astype(np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(rows).view("<u8").reshape(rows.shape[0], -1).T)
    out = np.empty((BLOCK, rows.shape[0]), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[word + 1] << np.uint64(64 - shift)
        out[i] = x & mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(start of each block and of the end, the blocks' bytes)."""
    starts, parts, at = [np.zeros(1, dtype=np.int64)], [], 0
    for first in range(0, len(ids), BLOCK * _AT_A_TIME):
        part = ids[first : first + BLOCK * _AT_A_TIME].astype(np.uint32)
        rows = np.resize(part, (-(-len(part) // BLOCK), BLOCK)) if len(part) % BLOCK == 0 else None
        if rows is None:  # the last block is filled up with its own last id
            rows = np.concatenate([part, np.full(-len(part) % BLOCK, part[-1], np.uint32)]).reshape(-1, BLOCK)
        low = rows.min(axis=1)
        delta = rows - low[:, None]
        width = _widths(delta, percentile)
        out_of = delta >> width[:, None].astype(np.uint32) > 0
        n_out = out_of.sum(axis=1)
        sizes = 8 + 16 * width + 5 * n_out
        ends = np.cumsum(sizes)
        begin = ends - sizes
        buf = np.zeros(int(ends[-1]), dtype=np.uint8)
        head = np.zeros(len(rows), dtype=[("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("out", "<u2")])
        head["low"], head["width"], head["out"] = low, width, n_out
        buf[begin[:, None] + np.arange(8)] = head.view(np.uint8).reshape(-1, 8)
        for w in np.unique(width):
            if w:
                which = np.flatnonzero(width == w)
                buf[(begin[which] + 8)[:, None] + np.arange(16 * w)] = _pack(delta[which], int(w))
        r, pos = np.nonzero(out_of)
        if len(r):
            nth = np.arange(len(r)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
            tail = begin[r] + 8 + 16 * width[r]
            buf[tail + nth] = pos
            buf[(tail + n_out[r] + 4 * nth)[:, None] + np.arange(4)] = delta[r, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
        parts.append(buf.tobytes())
        starts.append(at + ends)
        at += int(ends[-1])
    return np.concatenate(starts), b"".join(parts)


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts[:-1]`` in ``data`` (whole blocks)."""
    buf, begin = np.frombuffer(data, dtype=np.uint8), np.asarray(starts[:-1], dtype=np.int64)
    out = np.empty((len(begin), BLOCK), dtype=np.uint32)
    for first in range(0, len(begin), _AT_A_TIME):
        b = begin[first : first + _AT_A_TIME]
        head = buf[b[:, None] + np.arange(8)].reshape(-1).view([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("out", "<u2")])
        width, n_out = head["width"].astype(np.int64), head["out"].astype(np.int64)
        rows = np.zeros((len(b), BLOCK), dtype=np.uint32)
        for w in np.unique(width):
            if w:
                which = np.flatnonzero(width == w)
                rows[which] = _unpack(buf[(b[which] + 8)[:, None] + np.arange(16 * w)], int(w))
        if n_out.sum():
            r = np.repeat(np.arange(len(b)), n_out)
            nth = np.arange(len(r)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
            tail = b[r] + 8 + 16 * width[r]
            values = buf[(tail + n_out[r] + 4 * nth)[:, None] + np.arange(4)].reshape(-1).view("<u4")
            rows[r, buf[tail + nth]] = values
        out[first : first + len(b)] = rows + head["low"][:, None]
    return out.reshape(-1)


def to_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    starts, blocks = encode_blocks(ids, percentile)
    return b"".join([
        _HEAD.pack(b"PFR1", BLOCK, len(doc_ids), len(ids), len(starts) - 1),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array(counts, dtype="<u8").tobytes(), starts.astype("<u8").tobytes(), blocks,
    ])


def _layout(data: bytes):
    magic, block, n_docs, n_ids, n_blocks = _HEAD.unpack_from(data)
    if magic != b"PFR1" or block != BLOCK:
        raise ValueError("not a token file of this version")
    at = _HEAD.size
    docs, at = np.frombuffer(data, "<i8", n_docs, at), at + 8 * n_docs
    null, at = np.frombuffer(data, np.uint8, n_docs, at), at + n_docs
    counts, at = np.frombuffer(data, "<u8", n_docs, at), at + 8 * n_docs
    starts, at = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64), at + 8 * (n_blocks + 1)
    return [None if z else int(d) for d, z in zip(docs, null, strict=True)], counts.astype(np.int64), n_ids, starts, memoryview(data)[at:]


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, their numbers of ids, all ids)."""
    docs, counts, n_ids, starts, blocks = _layout(data)
    return docs, counts, decode_blocks(blocks, starts)[:n_ids]


def read_range(data: bytes, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop``, decoding only the blocks that hold them."""
    _, _, n_ids, starts, blocks = _layout(data)
    start, stop = max(0, start), min(stop, n_ids)
    if start >= stop:
        return np.empty(0, dtype=np.uint32)
    first, last = start // BLOCK, (stop - 1) // BLOCK
    own = starts[first : last + 2]
    return decode_blocks(blocks[own[0] : own[-1]], own - own[0])[start - first * BLOCK : stop - first * BLOCK]


MANIFEST = "range long, nth long, file string, n_docs long, n_ids long, n_bytes long"
ENCODED = "place long, range int, k long, tie long, width int, ids binary"
SAMPLE = 100  # rows for each range, as Spark's own range partitioning takes
Place = tuple[bool, int, int]


def _bounds(rows: DataFrame, ranges: int) -> list[Place]:
    """The least (whether there is a key, key, tie) of each range but the first, from a sample of the rows."""
    n = rows.count()
    ranges = max(1, min(ranges, n // 100))
    if ranges == 1:
        return []
    some = rows.sample(min(1.0, SAMPLE * ranges / n), seed=1).select("k", F.xxhash64("t").alias("tie")).collect()
    places = sorted((r["k"] is not None, r["k"] or 0, r["tie"]) for r in some)
    return sorted({places[i * len(places) // ranges] for i in range(1, ranges)}) if places else []


def _places(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that hash partitioning deals to it."""
    found: dict[int, int] = {}
    begin = 0
    while len(found) < n:
        rows = spark.range(begin, begin + 20 * n, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
        for r in rows:
            found.setdefault(r["p"], r["id"])
        begin += 20 * n
    return [found[i] for i in range(n)]


def _encoded(rows: DataFrame, tokenizer: str, mode: str, end_id: int, bounds: list[Place], places: list[int]) -> DataFrame:
    """``ENCODED`` for every row (k, t): the range it falls in and its ids, little-endian, ``width`` bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, mode)
        waiting: deque[tuple[int | None, int]] = deque()

        def texts() -> Iterator[str | None]:
            for b in batches:
                for k, tie, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1), strict=True):
                    waiting.append((k, tie))
                    yield text.as_py()

        end = np.array([end_id], coder.dtype).tobytes()
        out: list[bytes] = []

        def batch() -> pa.RecordBatch:
            keys = [waiting.popleft() for _ in out]
            of = [bisect_right(bounds, (k is not None, k or 0, tie)) for k, tie in keys]
            columns = [[places[i] for i in of], of, [k for k, _ in keys], [tie for _, tie in keys], [coder.dtype.itemsize] * len(out), out]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ENCODED.split(", ")])
            out.clear()
            return made

        for ids in coder.encode(texts()):
            out.append(ids.tobytes() + end)
            if len(out) >= 1000:
                yield batch()
        if out:
            yield batch()

    return rows.select("k", "t", F.xxhash64("t").alias("tie")).mapInArrow(run, ENCODED)


def write_files(docs: DataFrame, folder: str, tokenizer: str, mode: str = "drop", end_id: int = 1, key: str = "doc_id", text_col: str = "text", segment_ids: int = 4 << 20) -> DataFrame:
    """Writes the corpus to ``folder`` in ascending order of ``key``; returns the manifest.

    Texts are encoded where they are read, and only ids are shuffled, once. The ranges are over the
    key and a hash of the text, so that a key that many rows share, null for one, is dealt over several
    tasks; each range is a partition of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        of, nth = -1, 0
        store, root = fs.FileSystem.from_uri(folder)
        names: list[int | None] = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, counts, parts, held, nth
            data = to_bytes(names, counts, np.concatenate(parts))
            file = f"{of:06d}-{nth:05d}-{uuid.uuid4().hex[:12]}.pfr"
            with store.open_output_stream(f"{root}/{file}") as f:
                f.write(data)
            row = [[of], [nth], [file], [len(names)], [held], [len(data)]]
            names, counts, parts, held, nth = [], [], [], 0, nth + 1
            return pa.RecordBatch.from_arrays([pa.array(v) for v in row], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for b in batches:
            for mine, k, width, raw in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if mine != of:
                    if names:
                        yield flush()
                    of, nth = mine, 0
                own = np.frombuffer(raw.as_py(), dtype=f"<u{width}")
                names.append(k)
                counts.append(len(own))
                parts.append(own)
                held += len(own)
                if held >= segment_ids:
                    yield flush()
        if names:
            yield flush()

    spark = docs.sparkSession
    ship(spark)
    make_folder(spark, folder)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    bounds = _bounds(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = _places(spark, len(bounds) + 1)
    with batches_of(spark, 1000):
        ids = _encoded(rows, tokenizer, mode, end_id, bounds, places)
        ordered = ids.repartition(len(places), "place").sortWithinPartitions("range", "k", "tie", "ids")
        return cut(ordered.select("range", "k", "width", "ids").mapInArrow(run, MANIFEST), "manifest")


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def segment_starts(manifest: DataFrame) -> DataFrame:
    """``file, base``: the ids before each file. The totals of the ranges (a row for each) are
    summed in one place, the files of a range beside each other."""
    ranges = manifest.groupBy("range").agg(F.sum("n_ids").alias("total"))
    before = ranges.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("range").orderBy("nth")) - F.col("n_ids")
    return manifest.withColumn("own", own).join(before, "range").select("file", (F.col("before") + F.col("own")).alias("base"))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                names, counts, ids = from_bytes(data.as_buffer())
                ends = np.cumsum(counts)
                begin = ends - counts
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([path.as_py()] * len(names), pa.string()), pa.array(begin, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "file", "own_start", "n_tokens", "ids_crc32"],
                )

    spark = manifest.sparkSession
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "content")
    with batches_of(spark, 2):  # whole files are the rows
        rows = cut(files.mapInArrow(run, "doc_id long, file string, own_start long, n_tokens long, ids_crc32 long"), "read-back")
    return rows.join(cut(segment_starts(manifest), "starts"), "file").select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def op1(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract of ``op1_pfor_files``. Its jobs run when it is called, up to the last join."""
    folder = new_path(docs.sparkSession, "token-files")
    return read_documents(write_files(docs, folder, tokenizer), folder)
