"""Queries for the scalar text functions and the per-question decisions, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradloom.functions import classify as C
from gradloom.functions import text as T
from gradloom.functions.rewrite import BLANK_LINES, STRIP, Sub
from gradloom.plans import duck as D
from gradloom.plans.exam import Tables

Query = tuple[Callable[[Tables], "object"], str]


def _scalar(view: str, key: tuple[str, ...], column: Callable[[], Column], sql: str, name: str = "out") -> Query:
    """One expression over every row of a view."""
    return (lambda t: getattr(t, view).select(*key, column().alias(name))), f"SELECT {', '.join(key)}, {sql} AS {name} FROM {view}"


def _scan(column: Callable[[Column], Column], sql: str) -> Query:
    return _scalar("scans", ("paper_id",), lambda: column(F.col("text")), sql)


def _line(column: Callable[[Column], Column], sql: str) -> Query:
    return _scalar("qlines", ("topic_id", "form"), lambda: column(F.col("line")), sql)


def _docs(column: Callable[[Column], Column], sql: str) -> Query:
    return _scalar("documents", ("doc_id",), lambda: column(F.col("text")), sql)


def _question(column: Callable[[], Column], sql: str) -> Query:
    return _scalar("questions", ("paper_id", "question_no", "topic_id", "supplier_id"), column, sql)


S = D.strip("l")
_STRUCT, _HEAD = D.has(S, T.STRUCTURAL), D.has(S, T.HEADER)
_NOISE = " OR ".join(D.has(S, p) for p in (r"^[A-Z]\z", r"^\d{1,3}\z", r"^[\W\d]{1,4}\z"))
_EXAM = f"CASE WHEN length({S}) = 0 THEN chr(1) ELSE {D.rewrite('l', T.EXAM_LINE)} END"


def _exam(x: str) -> str:
    return D.rewrite(f"replace({D.lines(x, _EXAM, 'length(l) > 0')}, chr(1), '')", (BLANK_LINES, STRIP))


def _whitespace(x: str) -> str:
    return D.rewrite(D.lines(x, D.strip(D.rewrite("l", (Sub("[ \\t]+", " "),)))), (BLANK_LINES,))


def _embedding(x: str) -> str:
    x = f"lower({D.rewrite(x, T.EMBEDDING)})"
    for _ in range(3):
        x = D.rewrite(x, (T._VERB, STRIP))
    return D.rewrite(x, (Sub(r"\s+", " "), STRIP, Sub(r"[?.,;:]+\z")))


def _compare(x: str) -> str:
    return D.rewrite(f"lower({D.rewrite(x, T.COMPARE)})", (STRIP, Sub(r"[.,;:?!]+\z"), STRIP))


_TRIVIAL = "(" + ", ".join(map(D.q, T.TRIVIAL)) + ")"


def _legacy(x: str) -> str:
    words = D.words(D.rewrite(f"lower({x})", T.LEGACY))
    return f"coalesce(array_to_string(list_filter({words}, lambda w: length(w) > 3 OR w NOT IN {_TRIVIAL}), ' '), '')"


def _topic_key(x: str) -> str:
    x = D.rewrite(f"lower({x})", (Sub(r"\(\s*\d+\s*marks?\s*\)", " "), Sub(r"\b20\d{2}\b", " "), Sub(r"^[q]\s*\d+[a-z]?\s*[:.)\-]?\s*", " "), Sub(r"[^a-z0-9\s]", " ")))
    glued = Sub(r"\b([a-z]{3,})\s+((?:of|to|in|on|at|by|an|as|or|and|the|for)\b)|\b([a-z]{3,})\s+([a-z]{1,3})\b", "$1\x01$2$3\x02$4")
    x = D.rewrite(x, (glued, Sub("\x01\x02"), Sub("([a-z])\x01([a-z]+)\x02", "$1 $2"), Sub("\x01|\x02")))
    for phrase in T.FILLERS:
        x = f"replace({x}, {D.q(phrase)}, ' ')"
    return f"coalesce(array_to_string(list_filter(string_split_regex({x}, '\\s+'), lambda w: length(w) > 1), ' '), '')"


def _edges(x: str) -> str:
    words = "(?:" + "|".join(T.EDGE_WORDS) + ")"
    return D.rewrite(x, (Sub(rf"^(?:{words}(?:\s+|\z))+"), Sub(rf"(?:(?:^|\s+){words})+\z"), STRIP))


def _capital(x: str) -> str:
    return f"coalesce(array_to_string(list_transform({D.words(x)}, lambda w: CASE WHEN length(w) >= 4 THEN upper(substr(w, 1, 1)) || lower(substr(w, 2)) ELSE lower(w) END), ' '), '')"


def _months(x: str, pick: Callable[[str], str], default: str, test: Callable[[str], str]) -> str:
    return D.case([(test(m), pick(m)) for m in T.MONTHS], default)


_LABEL = "CASE WHEN topic_id % 5 = 0 THEN '' ELSE 'December 2022 and May ' || CAST(topic_id AS VARCHAR) END"
_G = lambda i: f"nullif(regexp_extract(line, {D.q(T.MARKS_ANYWHERE)}, {i}), '')"
_MARKS = f"TRY_CAST(coalesce(nullif(regexp_extract(line, {D.q(T.MARKS_AT_END)}, 1), ''), {_G(1)}, {_G(2)}, {_G(3)}) AS INT)"
_SESSION = r"\(([A-Za-z]{3,9})\.?\s+(20\d{2}),"
_MON = f"regexp_extract(line, {D.q(_SESSION)}, 1)"
_ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii")


def _contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {D.q(w)})" for w in words) + ")"


def _first(x: str, choices, default: str) -> str:
    return D.case([(_contains(f"lower({x})", w), D.q(k)) for k, w in choices.items()], D.q(default))


def _count(x: str, word: str) -> str:
    return f"len(regexp_extract_all({x}, {D.q(chr(92) + 'b' + word + chr(92) + 'b')}))"


def _best(scores: dict[str, str]) -> str:
    top = f"greatest({', '.join(scores.values())})"
    return D.case([(f"{s} = {top}", D.q(k)) for k, s in list(scores.items())[:-1]], D.q(list(scores)[-1]))


def _bloom(x: str) -> str:
    scores = {k: "(" + " + ".join(_count(f"lower({x})", w) for w in ws) + f") * {len(C.BLOOM) - i}" for i, (k, ws) in enumerate(C.BLOOM.items())}
    return f"CASE WHEN greatest({', '.join(scores.values())}) = 0 THEN 'understand' ELSE {_best(scores)} END"


def _difficulty(x: str, m: str) -> str:
    s = {k: " + ".join(f"CAST(contains(lower({x}), {D.q(w)}) AS INT)" for w in ws) for k, ws in C.DIFFICULTY.items()}
    n = f"len({D.words(x)})"
    s["easy"] += f" + CASE WHEN {m} <> 0 AND {m} <= 2 THEN 2 ELSE 0 END + CASE WHEN {n} < 20 THEN 1 ELSE 0 END"
    sub = D.has(x, r"\([a-z]\)") + " OR " + D.has(x, r"[ivx]+\)")
    s["medium"] += f" + CASE WHEN {m} > 2 AND {m} <= 5 THEN 2 ELSE 0 END + CASE WHEN {sub} THEN 1 ELSE 0 END"
    s["hard"] += f" + CASE WHEN {m} > 5 THEN 2 ELSE 0 END + CASE WHEN {n} > 50 THEN 1 ELSE 0 END"
    return _best({k: f"({v})" for k, v in s.items()})


_TIER = "CASE WHEN {0} >= 4 THEN 1 WHEN {0} >= 3 THEN 2 WHEN {0} >= 2 THEN 3 ELSE 4 END"
_N = "CAST((paper_id % 25) AS INT)"


def _label() -> Column:
    return F.expr(_LABEL.replace("VARCHAR", "STRING"))


def _n() -> Column:
    return (F.col("paper_id") % 25).cast("int")


QUERIES: dict[str, Query] = {
    "t01_normalize_whitespace": _scan(T.normalize_whitespace, _whitespace("text")),
    "t01_normalize_documents": _docs(T.normalize_whitespace, _whitespace("text")),
    "t02_remove_university_headers": _scan(T.remove_university_headers, D.rewrite(D.lines("text", "l", f"({_STRUCT}) OR NOT ({_HEAD})"), (BLANK_LINES, STRIP))),
    "t03_remove_marks_annotations": _scan(T.remove_marks_annotations, D.rewrite("text", T.MARKS)),
    "t04_remove_common_artifacts": _scan(T.remove_common_artifacts, D.rewrite("text", T.PAGE_ARTIFACTS)),
    "t05_rule_based_corrections": _scan(lambda c: T.rule_based_corrections(c, lone_i=False), D.rewrite("text", T.CORRECTIONS)),
    "t06_merge_broken_words": _scan(T.merge_broken_words, D.rewrite("text", T.MERGES)),
    "t07_remove_isolated_noise": _scan(T.remove_isolated_ocr_noise, D.rewrite(D.lines("text", f"CASE WHEN length({S}) = 0 THEN '' ELSE l END", f"length(l) = 0 OR ({_STRUCT}) OR NOT ({_NOISE})"), (BLANK_LINES, STRIP))),
    "t08_clean_exam_artifacts": _scan(T.clean_exam_artifacts, _exam("text")),
    "t09_clean_page": _scan(T.clean, _exam(_whitespace("text"))),
    "t13_keep_chars": _scan(T.keep_chars, D.rewrite("text", (Sub(r"\s+", " "), Sub(r"[^\w\s.,;:?!()\-]"), STRIP))),
    "t14_truncate": _line(lambda c: T.truncate(c, 30), "CASE WHEN length(line) <= 30 THEN line ELSE substr(line, 1, 27) || '...' END"),
    "t15_question_number": _line(
        T.question_number,
        D.case([(D.has(D.strip("line"), p), f"regexp_extract({D.strip('line')}, {D.q(p)}, 1)") for p in T.NUMBER_PATTERNS], "NULL"),
    ),
    "t16_safe_filename": _line(T.safe_filename, f"substr({D.rewrite('line', (Sub(r'[^\w\s.\-]'), Sub(r'\s+', '_')))}, 1, 255)"),
    "t17_for_embedding": _line(T.for_embedding, _embedding("line")),
    "t18_for_comparison": _line(T.for_comparison, _compare("line")),
    "t19_topic_key": _line(T.topic_key, _topic_key("line")),
    "t20_legacy_normal": _line(T.legacy_normal, _legacy("line")),
    "t21_strip_edges": _line(lambda c: T.strip_edges(F.concat(F.lit("of the "), T.topic_key(c), F.lit(" and"))), _edges(f"'of the ' || {_topic_key('line')} || ' and'")),
    "t23_first_words": _line(lambda c: T.first_words(c, 5), f"(SELECT array_to_string(x[1:5], ' ') || CASE WHEN len(x) > 5 THEN '...' ELSE '' END FROM (SELECT {D.words(chr(114) + 'egexp_replace(line, ' + D.q('[?.]') + ', ' + D.q('') + ', ' + D.q('g') + ')')} AS x))"),
    "t24_capitalize": _line(lambda c: T.capitalize_words(T.topic_key(c)), _capital(_topic_key("line"))),
    "t25_embed_preprocess": _line(T.embed_preprocess, D.rewrite("line", (Sub(r"\s+", " "), Sub(r"\?"), STRIP))),
    "t26_report_clean": _line(T.report_clean, D.rewrite("line", (Sub(r"^[Il1O0-9.)\s]+"), STRIP))),
    "t27_is_junk": _line(T.is_junk, f"(length({D.strip('line')}) < 8 OR " + " OR ".join(D.has("line", p) for p in T.JUNK) + ")"),
    "t28_short_year": _scalar("qlines", ("topic_id", "form"), lambda: T.short_year(_label()), _months(_LABEL, lambda m: f"replace({_LABEL}, '{m}', '{m[:3]}')", _LABEL, lambda m: f"contains({_LABEL}, '{m}')")),
    "t29_or_unknown": _scalar("qlines", ("topic_id", "form"), lambda: T.or_unknown(_label()), f"coalesce(nullif({_LABEL}, ''), 'Unknown')"),
    "t32_marks": _line(T.marks, _MARKS),
    "t33_strip_marks": _line(T.strip_marks, D.rewrite("line", (Sub(T.MARKS_AT_END), STRIP, Sub(T.MARKS_ANYWHERE), STRIP, Sub(rf"[{T.DASHES},]\s*\z"), STRIP))),
    "t34_strip_number": _line(T.strip_number, D.rewrite("line", (Sub(r"(?i)^(?:Q\.?\s*)?\d{1,2}\s*[.)]\s*"), Sub(r"(?i)^\(?([a-z]|i{1,3}v?|vi{0,3}|ix|x)\)\.?\s+"), STRIP))),
    "t35_roman_to_int": _scalar(
        "qlines", ("topic_id", "form"), lambda: T.roman_to_int(F.element_at(F.array(*map(F.lit, (*_ROMANS, "12", "mm"))), (F.col("topic_id") % 10 + 1).cast("int"))),
        D.case([(f"topic_id % 10 = {i}", str(i + 1)) for i in range(8)] + [("topic_id % 10 = 8", "12")], "NULL"),
    ),
    "t36_session_in": _line(T.session_in, f"CASE WHEN {D.has('line', _SESSION)} THEN " + D.case([(f"lower(substr({_MON}, 1, 3)) = '{m[:3].lower()}'", f"'{m}'") for m in T.MONTHS], _MON) + f" || ' ' || regexp_extract(line, {D.q(_SESSION)}, 2) END"),
    "t38_percentage": _scalar("qlines", ("topic_id", "form"), lambda: T.percentage(F.col("topic_id") % 7, F.col("topic_id") % 4 * 8), "CASE WHEN topic_id % 4 * 8 = 0 THEN 0.0 ELSE round((topic_id % 7) * 100.0::DOUBLE / (topic_id % 4 * 8), 1) END"),
    "t39_split_list": _line(lambda c: F.array_join(T.split_list(F.replace(c, F.lit(" "), F.lit(" , "))), "|"), f"coalesce(array_to_string(list_filter(list_transform(string_split(replace(line, ' ', ' , '), ','), lambda l: {S}), lambda x: length(x) > 0), '|'), '')"),
    "t40_chart_label": _line(T.chart_label, "CASE WHEN length(line) > 30 THEN substr(line, 1, 30) || '...' ELSE line END"),
    "t42_truncate_words": _line(lambda c: T.truncate_words(c, 6), f"(SELECT array_to_string(x[1:6], ' ') || CASE WHEN len(x) > 6 THEN ' …' ELSE '' END FROM (SELECT {D.words('line')} AS x))"),
    "p05_full_text": _line(
        lambda c: F.array_join(F.filter(F.array(c, F.lit("Define hazard."), F.lit("")), lambda x: F.length(x) > 0), " "),
        "array_to_string(list_filter([line, 'Define hazard.', ''], lambda x: length(x) > 0), ' ')",
    ),
    "p21_or_split": (
        lambda t: t.qlines.select("topic_id", "form", F.posexplode(F.split("line", r"(?i)\s+OR\s+")).alias("pos", "bullet")),
        "SELECT topic_id, form, CAST(u.i - 1 AS INT) AS pos, x[u.i] AS bullet FROM (SELECT topic_id, form, string_split_regex(line, '(?i)\\s+OR\\s+') AS x FROM qlines), UNNEST(range(1, len(x) + 1)) AS u(i)",
    ),
    "c07_fixed_module": (
        lambda t: t.questions.select("paper_id", "question_no", "topic_id", "supplier_id", *[c.alias(n) for n, c in zip(("fixed_part", "fixed_module"), C.fixed_module(_n(), F.col("part"), F.col("module_number")), strict=True)]),
        f"""SELECT paper_id, question_no, topic_id, supplier_id, CASE WHEN {_N} <= 10 THEN 'A' WHEN {_N} <= 20 THEN 'B' ELSE part END AS fixed_part,
        CAST(CASE WHEN {_N} = 0 THEN 5 WHEN {_N} <= 10 THEN floor(({_N} - 1) / 2.0) + 1 WHEN {_N} <= 20 THEN floor(({_N} - 11) / 2.0) + 1 ELSE module_number END AS INT) AS fixed_module FROM questions""",
    ),
    "c09_clamped_module": _question(lambda: C.clamped_module(_n()), f"CAST(greatest(1, least(5, CASE WHEN {_N} <= 10 THEN floor(({_N} - 1) / 2.0) + 1 ELSE floor(({_N} - 11) / 2.0) + 1 END)) AS INT)"),
    "c10_pattern_module": _question(
        lambda: C.pattern_module(
            F.create_map(*[x for p, first in (("part_a", 1), ("part_b", 11)) for x in (F.lit(p), F.create_map(*[y for i in range(10) for y in (F.lit(str(first + i)), F.lit(i // 2 + 1))]))]),
            F.concat(_n().cast("string"), F.lit("a")), F.col("part"),
        ),
        f"CAST(CASE WHEN part = 'A' AND {_N} BETWEEN 1 AND 10 THEN ({_N} - 1) // 2 + 1 WHEN part = 'B' AND {_N} BETWEEN 11 AND 20 THEN ({_N} - 11) // 2 + 1 END AS INT)",
    ),
    "c11_bloom": _question(lambda: C.bloom_level(F.col("qtext")), _bloom("qtext")),
    "c12_difficulty": _question(lambda: C.difficulty(F.col("qtext"), F.col("marks") % 8), _difficulty("qtext", "(marks % 8)")),
    "c13_question_type": _question(lambda: C.question_type(F.col("qtext")), _first("qtext", C.TYPES, "theory")),
    "c14_question_type_rich": _line(lambda c: C.question_type(c, rich=True), _first("line", C.TYPES_RICH, "theory")),
    "c15_difficulty_by_length": _line(C.difficulty_by_length, f"CASE WHEN len({D.words('line')}) < 10 THEN 'easy' WHEN len({D.words('line')}) < 30 THEN 'medium' ELSE 'hard' END"),
    "c16_bloom_first": _question(lambda: C.bloom_first(F.col("qtext")), _first("qtext", C.BLOOM_FIRST, "understand")),
    "c18_part_by_marks": _question(lambda: F.when(F.col("marks") > 2, "B").otherwise("A"), "CASE WHEN marks > 2 THEN 'B' ELSE 'A' END"),
    "c19_zone": _question(lambda: C.zone(F.col("marks") / 50.0), "CASE WHEN marks / 50.0::DOUBLE >= 0.9 THEN 'high' WHEN marks / 50.0::DOUBLE >= 0.82 THEN 'llm' WHEN marks / 50.0::DOUBLE >= 0.8 THEN 'dead' ELSE 'reject' END"),
    "c20_tier": _question(lambda: C.tier_label(C.tier(F.col("question_no"))), D.case([(f"{_TIER.format('question_no')} = {k}", D.q(v)) for k, v in C.TIER_LABELS.items()], "NULL")),
    "c21_likelihood": _question(
        lambda: C.likelihood(F.col("question_no"), F.col("marks") % 11),
        D.case([("marks % 11 = 0", "'Insufficient data'"), *[(f"question_no * 100.0::DOUBLE / (marks % 11) >= {a}", D.q(b)) for a, b in C.LIKELIHOOD]], "'Very Low (appears once)'"),
    ),
    "c23_number_range": _question(lambda: C.number_range(F.col("part"), F.col("module_number")), "'Qn ' || CAST(module_number * 2 + CASE WHEN part = 'A' THEN -1 ELSE 9 END AS VARCHAR) || '-' || CAST(module_number * 2 + CASE WHEN part = 'A' THEN 0 ELSE 10 END AS VARCHAR)"),
    "v09_hybrid_same": _question(lambda: C.hybrid_same(F.col("marks") / 50.0), "CASE WHEN marks / 50.0::DOUBLE >= 0.85 THEN true WHEN marks / 50.0::DOUBLE < 0.65 THEN false ELSE marks / 50.0::DOUBLE >= 0.75 END"),
}
