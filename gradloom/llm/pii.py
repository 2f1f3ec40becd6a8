"""Personal data with offset-preserving deobfuscation.

Base detectors run on the text as it is. Then transducers rewrite disguises - homoglyphs
and full-width or zero-width characters, "at"/"dot" in words or brackets, spelled-out
digits - while keeping for every output character the source characters it came from.
The same detectors run on the rewritten text, and what they find is mapped back to source
offsets. Such a span is added when a disguise took part in it and it isn't equal to or inside
a base span of its kind; base spans always stay, also beside an added span that covers them.

Defined results: a null or empty text has no spans; offsets are code points, end
exclusive; repeated rows are scanned row by row; whole texts are scanned at any length;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.workers import ship

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive, and only from the start of a digit run: the same matches without rescanning long runs
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from its ``@``."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


DETECTORS = (emails, ips, cards, phones)

#: Look-alikes of ASCII characters, by the character they look like. Full-width forms follow by rule.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еє", "h": "һ", "i": "іɩι", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν",
    "w": "ԝ", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ",
    "X": "ХΧ", "Y": "УΥ", "Z": "Ζ", ".": "。․﹒·", "@": "﹫", "-": "‐‑‒–−", "+": "﹢",
}
_INVISIBLE = "​‌‍⁠﻿­"
_CHARS = {c: to for to, many in LOOKALIKES.items() for c in many} | {chr(0xFF00 + i - 0x20): chr(i) for i in range(0x21, 0x7F)} | {c: "" for c in _INVISIBLE}
_HOMOGLYPH = re.compile("[" + "".join(map(re.escape, _CHARS)) + "]")

#: Names of the digits in the corpus's languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]+)?(?:{_WORD}(?:[ ]?-[ ]?|,?[ ]|[ ]dot[ ]|[ ]point[ ]|\.)){{3,}}{_WORD}(?!\w)", re.I)
_PART = re.compile(rf"{_WORD}|plus|dot|point|\.|[ ,-]+", re.I)
_OPEN, _SHUT = r"[ ]?[\[({<][ ]?", r"[ ]?[\])}>][ ]?"
_AT = rf"(?:{_OPEN}(?:at|@|arroba|arobase){_SHUT}|&#64;|&commat;)"
_DOT = rf"(?:{_OPEN}(?:dot|\.|punkt|punto|point){_SHUT}|&#46;|&period;)"
_BRACKET = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_NAME, _HOST = r"[A-Za-z0-9._%+-]+", r"[A-Za-z0-9-]+"
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}(?P<at>[ ]+at[ ]+|@)(?!(?:the|a|an|this|that)[ ]){_HOST}(?P<tail>(?:[ ]+dot[ ]+{_HOST}|\.{_HOST})*[ ]+dot[ ]+[A-Za-z]{{2,}}|(?:\.{_HOST})*\.[A-Za-z]{{2,}})(?![A-Za-z0-9-])", re.I)
_BARE_DOT = re.compile(r"[ ]+dot[ ]+", re.I)
#: Every bare disguise passes: it says "dot", or "at" before a host with a plain dot.
_BARE_HINT = re.compile(r" dot |[ ]at[ ]+[A-Za-z0-9-]+\.", re.I)

Edit = tuple[int, int, str]  # source start, source end, replacement


def _homoglyphs(text: str) -> Iterator[Edit]:
    if not text.isascii():
        for m in _HOMOGLYPH.finditer(text):
            yield m.start(), m.end(), _CHARS[m[0]]


def _disguises(text: str) -> Iterator[Edit]:
    edits: list[Edit] = []
    if "[" in text or "(" in text or "{" in text or "<" in text or "&" in text:
        edits += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKET.finditer(text)]
    if _BARE_HINT.search(text):
        for m in _BARE.finditer(text):
            if m["at"] != "@" or _BARE_DOT.search(m["tail"]):
                edits.append((m.start("at"), m.end("at"), "@"))
                edits += [(m.start("tail") + d.start(), m.start("tail") + d.end(), ".") for d in _BARE_DOT.finditer(m["tail"])]
    for m in _SPELLED.finditer(text):
        edits += [(m.start() + p.start(), m.start() + p.end(), _spoken(p[0].lower())) for p in _PART.finditer(m[0])]
    done = 0
    for e in sorted(edits):
        if e[0] >= done:
            yield e
            done = e[1]


def _spoken(part: str) -> str:
    return DIGIT_WORDS.get(part) or {"plus": "+", "dot": ".", "point": ".", ".": "."}.get(part, "")


class Transduced:
    """A rewritten text and, for any span of it, the source span it came from."""

    def __init__(self, source: str, edits: list[Edit]) -> None:
        self.to, self.of, out, at, length = [], [], [], 0, 0  # runs: output start; (source start, source end, whether rewritten)
        for start, end, new in edits:
            if start > at:
                self.to.append(length)
                self.of.append((at, start, False))
                out.append(source[at:start])
                length += start - at
            self.to.append(length)
            self.of.append((start, end, True))
            out.append(new)
            length += len(new)
            at = end
        self.to.append(length)
        self.of.append((at, len(source), False))
        out.append(source[at:])
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """(source start, source end, whether the span holds something rewritten)."""
        i, j = bisect_right(self.to, start) - 1, bisect_right(self.to, end - 1) - 1
        first, last = self.of[i], self.of[j]
        begin = first[0] if first[2] else first[0] + start - self.to[i]
        stop = last[1] if last[2] else last[0] + end - self.to[j]
        return begin, stop, any(x[2] for x in self.of[i : j + 1])


def find(text: str | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, added spans), each a list for every kind."""
    text = text or ""
    base = [f(text) for f in DETECTORS]
    added: list[list[Span]] = [[] for _ in KINDS]
    first = list(_homoglyphs(text))
    one = Transduced(text, first) if first else None
    second = list(_disguises(one.text if one else text))
    if not first and not second:
        return base, added
    two = Transduced(one.text if one else text, second)
    for spans, own, f in zip(added, base, DETECTORS, strict=True):
        for s, e in f(two.text):
            s, e, changed = two.back(s, e)
            if one:
                s, e, also = one.back(s, e)
                changed |= also
            if changed and not any(a <= s and e <= b for a, b in own):
                spans.append((s, e))
    return base, added


def written(spans: list[list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, of in zip(KINDS, spans, strict=True) for s, e in sorted(of))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of ``SCHEMA`` for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in b.column(1):
                base, added = find(text.as_py())
                every = [x + y for x, y in zip(base, added, strict=True)]
                row = [*map(len, base), hashlib.sha256(written(base).encode()).hexdigest(), written(every), sum(map(len, added))]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def redact(text: str | None, masks: dict[str, str] | None = None) -> str | None:
    """The text with every span, base or added, replaced by its kind's mask."""
    if text is None:
        return None
    base, added = find(text)
    spans = sorted((s, e, k) for k, x, y in zip(KINDS, base, added, strict=True) for s, e in x + y)
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], (masks or {}).get(k, f"[{k.upper()}]")]
        at = max(at, e)
    return "".join(out) + text[at:]


def op4(docs: DataFrame) -> DataFrame:
    """The contract of ``op4_deobfuscated_pii``: counts and digest of the base spans, all spans."""
    return scan(docs)
