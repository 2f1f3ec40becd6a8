"""Encoding whole texts with a public tokenizer, fast and exactly.

The library encodes; this module only keeps it from encoding the same piece of text over
and over. Texts are cut where the tokenizer's own pre-tokenizer always cuts, a batch's
pieces are made distinct, and each distinct piece is encoded by the library once and kept
in a bounded cache; a piece that the pre-tokenizer leaves whole goes to the library's model
alone. Texts for which the cutting rule isn't proven (other scripts, control
characters, runs of blanks) are encoded whole by the library.
"""

from __future__ import annotations

import functools
import os
import re
import string
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of printable ASCII, usual blanks and Latin letters up to U+024F: NFC leaves these
#: characters alone and a cut at a blank is exact.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[*range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xCA), 9, 10, 11, 12, 13]] = True
#: Among these bytes, still not plain: U+0080 to U+00A0, the dotted capital I, the start of a special token.
_PAIRS = re.compile(rb"\xc2[\x80-\xa0]|\xc4\xb0|\xc9[\x90-\xbf]|<\|")
#: Characters that are neither letters nor numbers nor blanks to any of the tokenizers.
_MARKS = string.punctuation + "¡¢£¤¥¦§©«¬®°±¶·»¿×÷"
CACHE = 350_000  # pieces in each of a worker's two generations, about 70 MB each
SLICE = 3_000_000  # characters cut up at a time


class Encoder:
    """``encode(texts)`` gives an array of ids for each text; null is the empty text.

    ``mode`` says how the tokenizer treats blanks: ``"drop"`` (it removes them, so that a
    text is the concatenation of its blank-separated pieces) or ``"lead"`` (GPT-2's
    pattern: a piece takes the one space before it). Any other mode encodes texts whole.
    """

    def __init__(self, path: str, mode: str, cache: int = CACHE, at_a_time: int = SLICE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: how the model writes a blank and each letter of a plain text
        letters = {x for i in range(0xA1, 0x250) for x in (chr(i), *chr(i).lower()) if x.isalpha()}
        self.written = {ord(x): to_bytes(x)[0][0] for x in (" ", *letters)}
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.mode, self.limit, self.at_a_time = mode, cache, at_a_time
        self.plain = _PLAIN.copy()
        if mode == "lead":
            self.plain[[9, 11, 12, 13]] = False  # blanks that join with a space beside them
        self.kept: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of plain letters, one blank before them at most: single pre-tokens."""
        tokenize, written = self.model.tokenize, self.written
        return [self._bytes([t.id for t in tokenize(w if w.isascii() and w[0] != " " else w.translate(written))]) for w in words]

    def _simple(self, column: pa.LargeStringArray, texts: list[str]) -> np.ndarray:
        """For each text whether cutting at blanks gives the pieces that the tokenizer makes."""
        if self.mode not in ("drop", "lead"):
            return np.zeros(len(texts), dtype=bool)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset :][: len(texts) + 1]
        data = column.buffers()[2] or pa.py_buffer(b"")
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
        at = np.concatenate([np.flatnonzero(~self.plain[raw]), np.fromiter((m.start() for m in _PAIRS.finditer(raw.data)), dtype=np.int64)])
        simple = np.ones(len(texts), dtype=bool)
        simple[np.searchsorted(offsets - offsets[0], at, "right") - 1] = False
        if self.mode == "lead":
            for i, t in enumerate(texts):
                if "   " in t or "\n\n\n" in t or " \n" in t or "\n " in t or t.endswith(("  ", "\n\n")):
                    simple[i] = False
        return simple

    def _of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, from the cache or the library."""
        if len(self.kept) > self.limit:  # what is still in use moves back from the older generation
            self.kept, self.older = {"": b""}, self.kept
        kept, older = self.kept, self.older
        out = list(map(kept.get, pieces))
        new = [i for i, ids in enumerate(out) if ids is None]
        missing, tails = [], []
        for i in new:
            x = pieces[i]
            if x in older:
                kept[x] = older[x]
                continue
            head = x.rstrip(_MARKS)
            if head != x and head[-1:].isalnum():  # a word and the marks after it are two pieces
                tails.append((x, head, x[len(head) :]))
            else:
                missing.append(x)
        missing += [x for x in {y for _, *two in tails for y in two} if x not in kept]
        words = [x for x in missing if (x[1:] if x[0] == " " else x).isalpha()]
        kept.update(zip(words, self._words(words), strict=True))
        missing = [x for x in missing if x not in kept]
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            kept.update(zip(part, self._library(part), strict=True))
        for x, head, marks in tails:
            kept[x] = kept[head] + kept[marks]
        for i in new:
            out[i] = kept[pieces[i]]
        return out

    def _cut(self, column: pa.LargeStringArray) -> pa.ListArray:
        if self.mode == "drop":
            return pc.ascii_split_whitespace(pc.utf8_lower(column))
        column = pc.replace_substring(pc.replace_substring(column, " ", "\0 "), "\n", "\0\n\0")
        return pc.split_pattern(column, "\0")

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        simple = self._simple(column, texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        which = np.flatnonzero(simple).tolist()
        if which:
            pieces = self._cut(column if len(which) == len(texts) else column.filter(pa.array(simple)))
            coded = pieces.flatten().dictionary_encode()
            own = self._of(coded.dictionary.to_pylist())
            flat = np.frombuffer(b"".join(own), dtype=self.dtype)
            sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // self.dtype.itemsize
            codes = coded.indices.to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            lengths = sizes.astype(np.int32)[codes]
            ends = np.cumsum(lengths, dtype=np.int64)
            shift = (starts[codes] - (ends - lengths)).astype(np.int32)
            ids = flat[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
            at = np.concatenate([[0], ends])[np.asarray(pieces.offsets) - pieces.offsets[0].as_py()]
            for k, i in enumerate(which):
                out[i] = ids[at[k] : at[k + 1]]
        rest = np.flatnonzero(~simple).tolist()
        for i, ids in zip(rest, self._library([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = np.frombuffer(ids, dtype=self.dtype)
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Yields the ids of each text, in order."""
        part: list[str] = []
        length = 0
        for text in texts:
            part.append(text or "")
            length += len(part[-1])
            if length > self.at_a_time:
                yield from self._some(part)
                part, length = [], 0
        if part:
            yield from self._some(part)


@functools.lru_cache(maxsize=2)
def encoder(path: str, mode: str, cache: int = CACHE, at_a_time: int = SLICE) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, mode, cache, at_a_time)
