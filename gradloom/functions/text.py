"""Scalar text functions: cleaning, normalising and formatting exam text.

All are expressions of built-in functions, so they stay in the JVM and fuse with the scan.
``\\s``, ``\\w`` and ``\\b`` have their ASCII meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradloom.functions.rewrite import BLANK_LINES, STRIP, Sub, first_group, map_lines, rewrite, strip

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?:" + "|".join(MONTHS) + ")"

# What marks a line as structure, as a header of the institution, as a page artefact.
STRUCTURAL = rf"(?i)^(?:Part\s*[AB]|Module\s+\d|Unit\s+[IVX\d]+|Qn\.?\s*\d|Q\.?\s*\d|{_MONTH}\s+20\d{{2}})"
HEADER_PHRASES = (
    r"APJ\s*abdul\s*kalam", r"technological\s+university", r"b\.?tech\.?\s+degree\s+examination", r"b\.?e\.?\s+degree\s+examination", r"m\.?tech\.?\s+degree",
    r"reg(?:istration)?\s*no\.?:?", r"roll\s*no\.?:?", r"max(?:imum)?\s*(?:time|marks)\s*:?", r"time\s*:\s*\d", r"duration\s*:\s*\d",
    r"instructions?\s+to\s+(?:candidates?|students?)", r"answer\s+all\s+questions", r"answer\s+any\s+(?:\w+)\s+questions", r"course\s+code\s*:?", r"course\s+name\s*:?",
    r"semester\s*:?\s*\d", r"branch\s*:?", r"use\s+of.*?permitted", r"assume\s+suitable\s+data",
)
HEADER = "(?i)(?:" + "|".join(HEADER_PHRASES) + ")"
DASHES = "—–\\-"
PAGE_ARTIFACTS = (
    Sub(r"(?i)^[-–—]*\s*\d{1,3}\s*[-–—]*$", "", True),
    Sub(r"(?i)^(page|pg\.?)\s+\d+(\s+of\s+\d+)?$", "", True),
    Sub(r"(?i)^(turn\s+over|contd\.?|p\.t\.o\.?)$", "", True),
    Sub(r"^\s*[|_]{2,}\s*$", "", True),
    Sub(r"^[^\w\s]$", "", True),
    BLANK_LINES,
    STRIP,
)
MARKS = (
    Sub(rf"(?i)\s*[{DASHES}]\s*\(\s*[A-Za-z]{{3,9}}\.?\s+20\d{{2}}\s*,\s*\d+\s*marks?\s*\)\s*$", "", True),
    Sub(r"(?i)\(\s*\d+\s*(?:[×xX*]\s*\d+\s*=\s*\d+\s*)?marks?\s*\)"),
    Sub(r"(?i)\[\s*\d+\s*(?:marks?)?\s*\]"),
    Sub(r"(?i)\bmarks?\s*[:=]\s*\d+\b"),
    Sub(r"\(\s*\d{1,2}\s*\)\s*$", "", True),
)
#: Typographic characters and what they are written as.
TYPOGRAPHY = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "°": " degrees "}
CORRECTIONS = (
    *(Sub(a, b) for a, b in TYPOGRAPHY.items()),
    Sub(r"(\b\d{1,2})\s+\.", "$1."),
    Sub(r"(\w)-\n(\w)", "$1$2"),
    Sub(r"(?i)\(\s+([ivxlcdm]+)\s+\)", "($1)"),
    Sub(r"\b1et\b", "let"),
    Sub(r"\b1ist\b", "list"),
)
#: What ``CORRECTIONS`` says with patterns, in fewer and cheaper walks of a text: a digit is looked for before the edge in front of it.
_CORRECTIONS = (
    Sub(r"(\d(?<=\b\d)\d?)\s+\.", "$1."),
    Sub(r"(\w)-\n(\w)", "$1$2"),
    Sub(r"(?i)\(\s+([ivxlcdm]+)\s+\)", "($1)"),
    Sub(r"1(?<=\b1)(?=(?:et|ist)\b)", "l"),
)
#: A lone I before a lower-case word is a misread 1 (look-ahead: Java only).
LONE_I = Sub(r"\bI\b(?=\s+[a-z])", "1")
#: Words that recognition splits, as their two halves.
SPLIT_WORDS = (
    "confi guration", "algo rithm", "imple mentation", "defi ne", "ana lysis", "architec ture", "specifi cation", "verifi cation", "certifi cate", "manage ment", "develop ment",
    "require ment", "diagram matic", "informa tion", "communi cation", "integra tion", "compati bility", "dis aster", "evalu ation", "plan ning", "test ing", "function al",
    "qualit y", "process ing", "resource s", "project s",
)
MERGES = (
    Sub(r"(?i)\bde\s+fi\s*ne\b", "define"),
    *(Sub(rf"(?i)\b{a}\s+{b}\b", a + b) for a, b in (w.split() for w in SPLIT_WORDS)),
    Sub(r"(?i)\bnon\s*-\s*function", "non-function"),
)
EXAM_LINE = (
    STRIP,
    Sub(r"(?i)\bpart\s*[:\-—]?\s*a\b", "Part A"),
    Sub(r"(?i)\bpart\s*[:\-—]?\s*b\b", "Part B"),
    Sub(r"^(\d{1,2})\s+\.\s+", "$1. "),
    Sub(r"^[*+=|\\#@~`]+\s*"),
    Sub(r"\s*[*+=|\\#@~`]+\z"),
    STRIP,
)
# ``EXAM_LINE`` for all lines of a text at once; blanks are those inside of a line. First go the lines of which it leaves nothing.
_BLANK, _STRAY = r"[ \t\x0B\f\r]", r"[*+=|\\#@~`]"
_EDGE = _BLANK[:-1] + _STRAY[1:]
_EXAM_TEXT = (
    Sub(rf"(?md)^{_BLANK}*+{_STRAY}++(?:{_BLANK}++{_STRAY}++)?{_BLANK}*+(?:\n|\z)"),
    Sub(rf"(?i)part(?<=\bpart){_BLANK}*[:\-—]?{_BLANK}*a\b", "Part A"),
    Sub(rf"(?i)part(?<=\bpart){_BLANK}*[:\-—]?{_BLANK}*b\b", "Part B"),
    Sub(rf"(?md)^{_BLANK}*+(\d{{1,2}}){_BLANK}++\.{_BLANK}++(?=\S)", "$1. "),
    Sub(rf"(?md)(?={_EDGE})(?:^(?:{_BLANK}++(?:{_STRAY}++{_BLANK}*+)?|{_STRAY}++{_BLANK}*+)|{_BLANK}*+{_STRAY}++{_BLANK}*+$|{_BLANK}++$)"),
)
# Instruction words at the start of a question, words dropped at a phrase's edge.
VERBS = (
    "explain", "describe", "discuss", "define", "write", "list", "state", "derive", "compare", "differentiate", "draw", "illustrate", "outline", "elaborate", "mention", "calculate",
    "solve", "analyze", "analyse", "evaluate", "design", "implement", "show", "prove", "demonstrate", "identify", "what is", "what are", "give", "brief",
)
EDGE_WORDS = ("and", "or", "of", "to", "in", "on", "for", "with", "from", "by", "the", "a", "an")
TRIVIAL = ("the", "a", "an", "and", "or", "but", "with", "for", "to", "of", "in", "on", "at")
FILLERS = (
    "explain", "define", "discuss", "describe", "state", "list", "enumerate", "briefly", "in detail", "with diagram", "with neat diagram", "with example", "what is", "what are",
    "write short note on", "write a note on",
)
NOT_KEYWORDS = ("explain", "describe", "define", "discuss", "what", "how", "why", "list", "state", "mention", "briefly", "detail", "with", "the", "and", "or", "for", "to", "of", "in", "on", "at", "from")
_VERB = Sub("(?i)^(?:" + "|".join(VERBS) + r")\s+")
EMBEDDING = (
    Sub(r"(?i)^(?:q\.?\s*)?\d{1,2}\s*[.)]\s*"), STRIP,
    Sub(r"(?i)^\(?(?:[a-z]|i{1,3}v?|vi{0,3}|ix|x)\)\.?\s+"), STRIP,
)
COMPARE = (
    Sub(r"(?i)^(?:Q\.?\s*)?(\d+)[.)]\s*"),
    Sub(r"(?i)\([a-z0-9]+\)\s*", " "),
    Sub(r"(?i)[(\[]\s*\d+\s*marks?\s*[)\]]"),
    Sub(r"(?i)\bOR\b"),
    Sub(r"\s+", " "),
)
LEGACY = (
    Sub(r"\(\s*\d+\s*marks?\s*\)"),
    Sub(r"\d{4}"),
    Sub(r"^q\d+[a-z]?\s*[:.)]*\s*"),
    Sub(r"^question\s*\d+\s*[:.)]*\s*"),
    Sub(r"^part\s*[ab]\s*[:.)]*\s*"),
)
MARKS_AT_END = rf"(?i)[{DASHES}]?\s*\((?:[A-Za-z]{{3,9}}\.?\s+\d{{4}},\s*)?(\d+)\s*(?:[×x*]\s*\d+\s*=\s*\d+\s*)?marks?\)\s*\z"
MARKS_ANYWHERE = r"(?i)(?:\((\d+)\s*[×x*]?\s*\d*\s*=?\s*\d*\s*marks?\)|\[(\d+)\]|marks\s*:\s*(\d+))"


def normalize_whitespace(text: Column) -> Column:
    """Blanks collapsed and lines stripped; runs of empty lines capped at one."""
    return rewrite(map_lines(text, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), (BLANK_LINES,))


def remove_university_headers(text: Column) -> Column:
    return rewrite(map_lines(text, lambda x: x, lambda x: strip(x).rlike(STRUCTURAL) | ~strip(x).rlike(HEADER)), (BLANK_LINES, STRIP))


def remove_marks_annotations(text: Column) -> Column:
    return rewrite(text, MARKS)


def remove_common_artifacts(text: Column) -> Column:
    return rewrite(text, PAGE_ARTIFACTS)


def rule_based_corrections(text: Column, lone_i: bool = True) -> Column:
    for a, b in TYPOGRAPHY.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return rewrite(text, (*_CORRECTIONS, LONE_I) if lone_i else _CORRECTIONS)


def merge_broken_words(text: Column) -> Column:
    return rewrite(text, MERGES)


def remove_isolated_ocr_noise(text: Column) -> Column:
    noise = lambda s: s.rlike(r"^[A-Z]\z") | s.rlike(r"^\d{1,3}\z") | s.rlike(r"^[\W\d]{1,4}\z")
    keep = lambda x: (F.length(x) == 0) | strip(x).rlike(STRUCTURAL) | ~noise(strip(x))
    emptied = lambda x: F.when(F.length(strip(x)) == 0, "").otherwise(x)
    return rewrite(map_lines(text, emptied, keep), (BLANK_LINES, STRIP))


def clean_exam_artifacts(text: Column) -> Column:
    """Part headers in one form, stray symbols gone; lines emptied by that go, blank lines stay."""
    out = F.replace(rewrite(text, _EXAM_TEXT), F.lit("\x01"), F.lit(""))
    return strip(rewrite(out, (BLANK_LINES,)))


def clean(text: Column, hook=None) -> Column:
    """The page cleaner: whitespace, exam artefacts, then an optional hook (text column to text
    column) whose null or blank results leave the text as it is."""
    out = clean_exam_artifacts(normalize_whitespace(text))
    if hook is None:
        return out
    new = hook(out)
    return F.when(F.length(strip(F.coalesce(new, F.lit("")))) > 0, new).otherwise(out)


def keep_chars(text: Column) -> Column:
    """Whitespace collapsed; only word characters, blanks and ``.,;:?!()-`` stay."""
    return rewrite(text, (Sub(r"\s+", " "), Sub(r"[^\w\s.,;:?!()\-]"), STRIP))


def truncate(text: Column, most: int = 100, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix)))


NUMBER_PATTERNS = (r"^[Qq]\.?\s*(\d+[a-zA-Z]?)", r"^(\d+)\s*[.)]\s*", r"^(\d+[a-zA-Z]?)\s*[.)]\s*")


def question_number(text: Column) -> Column:
    return first_group(strip(text), *((p, 1) for p in NUMBER_PATTERNS))


def safe_filename(name: Column) -> Column:
    return F.substring(rewrite(name, (Sub(r"[^\w\s.\-]"), Sub(r"\s+", "_"))), 1, 255)


def for_embedding(text: Column) -> Column:
    out = F.lower(rewrite(text, EMBEDDING))
    for _ in range(3):  # "explain and describe": the loop stops by itself when nothing is left to drop
        out = rewrite(out, (_VERB, STRIP))
    return rewrite(out, (Sub(r"\s+", " "), STRIP, Sub(r"[?.,;:]+\z")))


def for_comparison(text: Column) -> Column:
    return rewrite(F.lower(rewrite(text, COMPARE)), (STRIP, Sub(r"[.,;:?!]+\z"), STRIP))


def legacy_normal(text: Column) -> Column:
    kept = F.filter(F.split(rewrite(F.lower(text), LEGACY), r"\s+"), lambda w: (F.length(w) > 3) | ((F.length(w) > 0) & ~w.isin(*TRIVIAL)))
    return F.array_join(kept, " ")


def topic_key(text: Column, join_splits: bool = True) -> Column:
    """The legacy topic key. ``join_splits`` glues a word and a following fragment of up to three
    letters unless that is a preposition or article; a pair that stays apart is consumed as a pair,
    which the first of the two rewrites marks so that the second one skips it."""
    out = rewrite(F.lower(F.coalesce(text, F.lit(""))), (Sub(r"\(\s*\d+\s*marks?\s*\)", " "), Sub(r"\b20\d{2}\b", " "), Sub(r"^[q]\s*\d+[a-z]?\s*[:.)\-]?\s*", " "), Sub(r"[^a-z0-9\s]", " ")))
    if join_splits:
        glued = Sub(r"\b([a-z]{3,})\s+((?:of|to|in|on|at|by|an|as|or|and|the|for)\b)|\b([a-z]{3,})\s+([a-z]{1,3})\b", "$1\x01$2$3\x02$4")
        out = rewrite(out, (glued, Sub("\x01\x02"), Sub("([a-z])\x01([a-z]+)\x02", "$1 $2"), Sub("\x01|\x02")))
    for phrase in FILLERS:
        out = F.replace(out, F.lit(phrase), F.lit(" "))
    return F.array_join(F.filter(F.split(out, r"\s+"), lambda w: F.length(w) > 1), " ")


def strip_edges(phrase: Column) -> Column:
    words = "(?:" + "|".join(EDGE_WORDS) + ")"
    return rewrite(phrase, (Sub(rf"^(?:{words}(?:\s+|\z))+"), Sub(rf"(?:(?:^|\s+){words})+\z"), STRIP))


def capitalize_words(phrase: Column, least: int = 4) -> Column:
    up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    return F.array_join(F.transform(F.filter(F.split(phrase, r"\s+"), lambda w: F.length(w) > 0), lambda w: F.when(F.length(w) >= least, up(w)).otherwise(F.lower(w))), " ")


def first_words(text: Column, n: int = 10) -> Column:
    words = F.filter(F.split(F.translate(text, "?.", ""), r"\s+"), lambda w: F.length(w) > 0)
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, "...").otherwise(""))


def embed_preprocess(text: Column) -> Column:
    return rewrite(text, (Sub(r"\s+", " "), Sub(r"\?"), STRIP))


def report_clean(text: Column) -> Column:
    """Drops leading characters of ``[Il1O0-9.)]`` and blanks, real letters included."""
    return rewrite(text, (Sub(r"^[Il1O0-9.)\s]+"), STRIP))


#: What page headers and misread lines look like.
JUNK = (r"(?i)^\s*[A-Z]\s+subcontinent", r"(?i)PART\s*[B8]\s*[\{\[]", r"(?i)ea€\*\s*module", r"^[\W\s]{0,3}\z", r"(?i)ltaz[-\s]*afi", r"(?i)!a\}[€\}]r")


def is_junk(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    out = F.length(strip(text)) < 8
    for p in JUNK:
        out = out | text.rlike(p)
    return out


def short_year(label: Column) -> Column:
    """The first full month name, in calendar order, as three letters."""
    out = F.when(label.contains(MONTHS[0]), F.replace(label, F.lit(MONTHS[0]), F.lit(MONTHS[0][:3])))
    for m in MONTHS[1:]:
        out = out.when(label.contains(m), F.replace(label, F.lit(m), F.lit(m[:3])))
    return out.otherwise(label)


def or_unknown(label: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("Unknown"))


def marks(line: Column) -> Column:
    """Marks at the line's end, else the first given anywhere, else null."""
    group = lambda g: F.nullif(F.regexp_extract(line, MARKS_ANYWHERE, g), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(line, MARKS_AT_END, 1), F.lit("")), group(1), group(2), group(3)).try_cast("int")


def strip_marks(line: Column) -> Column:
    return rewrite(line, (Sub(MARKS_AT_END), STRIP, Sub(MARKS_ANYWHERE), STRIP, Sub(rf"[{DASHES},]\s*\z"), STRIP))


def strip_number(text: Column) -> Column:
    return rewrite(text, (Sub(r"(?i)^(?:Q\.?\s*)?\d{1,2}\s*[.)]\s*"), Sub(r"(?i)^\(?([a-z]|i{1,3}v?|vi{0,3}|ix|x)\)\.?\s+"), STRIP))


def roman_to_int(text: Column) -> Column:
    t = strip(F.lower(text))
    out = F.when(t.rlike(r"^\d+\z"), t.try_cast("int"))
    for i, r in enumerate(("i", "ii", "iii", "iv", "v", "vi", "vii", "viii"), 1):
        out = out.when(t == r, F.lit(i))
    return out


def session_in(line: Column) -> Column:
    """``(Dec 2022,`` gives ``December 2022``; an unknown month stays as written."""
    rx = r"\(([A-Za-z]{3,9})\.?\s+(20\d{2}),"
    month, year = F.regexp_extract(line, rx, 1), F.regexp_extract(line, rx, 2)
    full = F.when(F.lower(F.substring(month, 1, 3)) == "jan", MONTHS[0])
    for m in MONTHS[1:]:
        full = full.when(F.lower(F.substring(month, 1, 3)) == m[:3].lower(), m)
    return F.when(line.rlike(rx), F.concat(full.otherwise(month), F.lit(" "), year))


def percentage(value: Column, total: Column) -> Column:
    """Share in percent to one decimal, 0 where the total is 0."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(value * 100.0 / total, 1))


def split_list(text: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, separator, -1), strip), lambda x: F.length(x) > 0)


def chart_label(text: Column, most: int = 30) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def truncate_words(text: Column, n: int) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, " …").otherwise(""))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0))


def keywords(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(topic_key(text), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*NOT_KEYWORDS)))


#: What text extraction leaves behind.
EXTRACTION = (Sub(r" +", " "), Sub(r"(\w+)-\n(\w)", "$1$2"), Sub(r"\b[J|j]\s+[J|j]\b"), Sub(r"\s+[|]\s+", " "), Sub(r"([a-z,])\n([a-z])", "$1 $2"), Sub(r"\n\s*\n\s*\n", "\n\n"), STRIP)


def clean_extracted(text: Column) -> Column:
    return rewrite(text, EXTRACTION)


EXAM_MONTH = "(?i)(" + "|".join((*(m.upper() for m in MONTHS), *(m[:3].upper() for m in MONTHS if m != "May"))) + ")"
EXAM_YEAR = r"(20[12]\d)"


def exam_info(title: Column, text: Column) -> tuple[Column, Column]:
    """(month, year) from a title and the first 500 characters."""
    where = F.concat(title, F.lit(" "), F.substring(text, 1, 500))
    month = F.nullif(F.regexp_extract(where, EXAM_MONTH, 1), F.lit(""))
    return F.initcap(month), F.nullif(F.regexp_extract(where, EXAM_YEAR, 1), F.lit(""))
