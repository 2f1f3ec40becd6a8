"""Sum-of-squares online packing of documents into fixed windows.

A document's ids are cut into full windows and a rest. The rest goes online into the fill
level that minimises the sum over levels of the squared number of partially filled windows
at that level (Csirik et al.'s Sum-of-Squares rule); the counts stand in one level array.
Each partition packs its own documents as they come, so nothing is shuffled and a task
holds no more than its open windows, at most ``MAX_OPEN``, and of each document the ids not yet
placed for good. At that number and at a partition's end the windows still open are
closed: pieces of the emptiest fill up the others (a document may be cut anywhere), and
what then remains is cut at powers of two, which need no padding.

Defined results: a null or empty text is its end id alone; rows that repeat a ``doc_id``
are packed as separate documents; an empty table gives no pieces; columns other than the
key and the text are ignored. A lost executor costs only its partitions again.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.llm.tokens import encoder
from gradloom.workers import ship

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: sequence_id = partition * STRIDE + number in the partition
STRIDE = 1 << 40
#: Nothing is shuffled or sorted here, so the workers can keep more pieces than elsewhere.
CACHE, SLICE = 800_000, 8_000_000
MAX_OPEN = 8192
#: A block of pieces: document, start, length, sequence, offset.
Piece = tuple[int, int, int, int, int]


class SumOfSquares:
    """Places rests into windows of ``size`` by the sum-of-squares rule.

    ``counts[h]`` is the number of open windows filled to ``h``; ``open[h]`` their numbers.
    """

    def __init__(self, size: int) -> None:
        self.size, self.n = size, 0
        self.clear()

    def clear(self) -> None:
        self.counts, self.n_open = np.zeros(self.size + 1, dtype=np.int64), 0
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def new(self) -> int:
        self.n += 1
        return self.n - 1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) for a rest of 1 to size - 1 ids."""
        size, c = self.size, self.counts
        # moving a window from h to h + length changes the sum by 2 * (N(h + length) - N(h)) + 2
        gain = 2 * (c[length : size + 1] - c[: size + 1 - length]) + 2
        gain[0] = 2 * c[length] + 1  # a new window
        gain[size - length] = 1 - 2 * c[size - length]  # a full one leaves the sum
        gain[1:][c[1 : size + 1 - length] == 0] = np.iinfo(np.int64).max
        h = int(gain.argmin())
        window = self.open[h].pop() if h else self.new()
        if h:
            c[h] -= 1
            self.n_open -= 1
        if h + length < size:
            c[h + length] += 1
            self.n_open += 1
            self.open[h + length].append(window)
        return window, h

    def rests(self) -> list[tuple[int, int]]:
        """(fill, window) of the open windows, fullest first."""
        return [(h, w) for h in range(self.size - 1, 0, -1) for w in self.open[h]]


def _close(packer: SumOfSquares, held: dict[int, list[Piece]]) -> Iterator[Piece]:
    """Closes the open windows: the emptiest are cut up to fill the fullest."""
    rows = packer.rests()
    pool: list[list[int]] = []  # pieces to deal out: [document, start, length]
    low, high = len(rows) - 1, 0
    size = packer.size
    left = sum(h for h, _ in rows) % size
    while high <= low:
        fill, window = rows[high]
        if fill & (fill - 1) == 0 and high < low:  # a power of two needs no padding
            yield from held[window]
            high += 1
            continue
        need = size - fill
        while need and (pool or low > high):
            if not pool:
                pool = [[d, s, n] for d, s, n, *_ in held[rows[low][1]]]
                low -= 1
            piece = pool[-1]
            take = min(need, piece[2])
            held[window].append((piece[0], piece[1], take, window, size - need))
            piece[1], piece[2], need = piece[1] + take, piece[2] - take, need - take
            if not piece[2]:
                pool.pop()
        if need:
            pool = [[d, s, n] for d, s, n, *_ in reversed(held[window])]
        else:
            yield from held[window]
        high += 1
    # what is left is less than a window: cut at powers of two
    left = sum(n for *_, n in pool)
    while left:
        room, at, window = 1 << (left.bit_length() - 1), 0, packer.new()
        left -= room
        while room:
            piece = pool[-1]
            take = min(room, piece[2])
            yield piece[0], piece[1], take, window, at
            piece[1], piece[2], room, at = piece[1] + take, piece[2] - take, room - take, at + take
            if not piece[2]:
                pool.pop()


def pack_stream(lengths: Iterator[int], size: int) -> Iterator[Piece]:
    """Pieces (document number, start, length, window, offset) for documents of the given lengths."""
    packer, held = SumOfSquares(size), {}
    for doc, n in enumerate(lengths):
        full, rest = divmod(n, size)
        for i in range(full):
            yield doc, i * size, size, packer.new(), 0
        if rest:
            window, offset = packer.place(rest)
            own = held.setdefault(window, [])
            own.append((doc, full * size, rest, window, offset))
            if offset + rest == size:
                yield from held.pop(window)
            if packer.n_open >= MAX_OPEN:
                yield from _close(packer, held)
                packer.clear()
                held.clear()
    yield from _close(packer, held)


def pack(docs: DataFrame, tokenizer: str, mode: str = "lead", end_id: int = 0, size: int = 1024, key: str = "doc_id", text_col: str = "text", cache: int = CACHE, at_a_time: int = SLICE) -> DataFrame:
    """Pieces of all documents (see ``SCHEMA``). ``cache`` and ``at_a_time`` bound what the encoder
    of a worker keeps and cuts up at once; they change no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, mode, cache, at_a_time).encode
        ids: dict[int, tuple[int, np.ndarray]] = {}  # (start, ids from there) of documents that have a piece in an open window
        pending: dict[int, int] = {}
        keys: dict[int, tuple[int | None, int]] = {}
        partition = None
        out: list[tuple] = []

        waiting: deque[int | None] = deque()

        def texts() -> Iterator[str | None]:
            nonlocal partition
            for b in batches:
                partition = b.column(2)[0].as_py() if partition is None and b.num_rows else partition
                for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    waiting.append(k)
                    yield text.as_py()

        def lengths() -> Iterator[int]:
            for doc, own in enumerate(encode(texts())):
                ids[doc], keys[doc], pending[doc] = (0, np.append(own, np.array([end_id], own.dtype))), (waiting.popleft(), len(own) + 1), len(own) + 1
                yield len(own) + 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for doc, start, n, window, offset in pack_stream(lengths(), size):
            first, own = ids[doc]
            crc = zlib.crc32(own[start - first : start - first + n].astype("<u4").tobytes())
            out.append((keys[doc][0], start, n, crc, keys[doc][1], partition * STRIDE + window, offset))
            pending[doc] -= n
            if not pending[doc]:
                del ids[doc], keys[doc], pending[doc]
            elif n == size and pending[doc] < size:  # the full windows are out
                ids[doc] = start + n, own[start - first + n :].copy()
            if len(out) >= 10_000:
                yield batch()
        if out:
            yield batch()

    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long"), F.col(text_col), F.spark_partition_id().cast("long").alias("__partition"))
    return rows.mapInArrow(run, SCHEMA)


def op9(docs: DataFrame, tokenizer: str, **bounds: int) -> DataFrame:
    """The contract of ``op9_sum_of_squares``."""
    return pack(docs, tokenizer, **bounds)
