"""Question extraction by format: papers that print Part A without numbers and Part B in one of two layouts.

A paper is one row and stays one: each step is an expression that turns its text into an array of questions
(number, text, marks), so nothing is shuffled. Part A is the first ten long lines. Part B is decided by a vote of the paper itself: with
seven hits of numbers like ``11 a)`` each hit begins a question, else the parts ``a)`` and ``b)`` below each module heading are paired and numbered
in order. Papers in which that finds less than eight questions are searched for numbers anywhere; those with less than
fifteen in all get what numbered lines say about the numbers that are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.functions.rewrite import Sub, rewrite, strip

# Headings, misread numbers, lines that are no questions, and how much each format takes.
PART_A = r"(?is)PART\s*A\s*\n(.(?:[^P]++|P(?!ART\s*[B8]))*+)"
PART_B = r"(?is)PART\s*[B8]\s*\n(.+)\z"
INSTRUCTION = r"(?is)\(Answer.*?\)"
MARKS_END = r"(?md)Marks?[\s&&[^\n]]*$"
FURNITURE = r"(?i)^(?:\d+\s*\z|Page|Marks|Duration|Course)"
HIT = r"(?m)^\s*+([Il1]\s*[Il1]|[Il1]?[12][0-9])\s*a\)"
A_TEXT, B_TEXT = r"(?is)a\)\s*(.+?)(?=\s*b\)|\z)", r"(?is)b\)\s*(.+)\z"
MODULE_HEAD = r"(?i)Module\s*-\s*[1-5]"
PARTS = r"(?m)(a\)|b\))\s*([^\n]+(?:\n(?!\s*(?:a\)|b\)|Module|Page|Marks|\d{4}|OR\s+a\)|OR\s+b\)))[^\n]+)*)"
LOOSE = r"[Il1]?[12][0-9]\s*a\)|a\)\s*[Il1]?[12][0-9]"
AROUND, LOOK_B, LOOK_NEXT, REST = 1300, 800, 500, 400
LOOSE_WINDOW = rf"(?is)(?={LOOSE})(?=(.{{0,{AROUND}}}))(?:{LOOSE})"
LOOSE_NUMBER = r"(?i)\A(?:(?=[Il1]?[12][0-9]\s*a\))|a\)\s*)([Il1]?[12][0-9])"
NUMBERED_LINES = (r"(?m)^\s*(\d{1,2})\s*[.)\]]\s*([^\n]{15,})", r"(?m)^\s*[Qq]\.?\s*(\d{1,2})\s*[.)\]]?\s*([^\n]{15,})", r"(?m)(\d{1,2})\s*[.)\]]\s*([a-z]\)[^\n]*?)(?=\d{1,2}\s*[.)\]]|\z)")
ENOUGH_HITS, ENOUGH_B, ENOUGH, LONGEST, FIRST_B = 7, 8, 15, 2000, 11

QUESTION = "struct<question_number: string, text: string, marks: int>"


def _none() -> Column:
    return F.array().cast(f"array<{QUESTION}>")


def _question(number: Column, text: Column, marks: Column) -> Column:
    return F.struct(number.cast("string").alias("question_number"), F.substring(text, 1, LONGEST).alias("text"), marks.cast("int").alias("marks"))


def _tidy(text: Column) -> Column:
    """Without the marks at the end, in single blanks."""
    return rewrite(strip(text), (Sub(r"\s+\d+\s*\z"), Sub(r"\s+", " ")))


def _either(a: Column, b: Column, least: int) -> Column:
    return F.array_join(F.filter(F.array(a, b), lambda x: F.length(x) > least), " OR ")


def _as_number(raw: Column) -> Column:
    """A number whose ones may have been read as letters; null if it is none of 11 to 20."""
    n = F.translate(raw, "lI ", "11").try_cast("int")
    return F.when(F.translate(raw, "lI ", "11").rlike(r"\A[0-9]+\z") & n.between(FIRST_B, 20), n)


def part_a(text: Column) -> Column:
    """The first ten long lines of Part A, numbered, 3 marks each."""
    block = rewrite(F.regexp_extract(text, PART_A, 1), (Sub(INSTRUCTION), Sub(MARKS_END)))
    kept = F.filter(F.transform(F.split(block, "\n"), strip), lambda x: (F.length(x) >= 15) & ~x.rlike(FURNITURE))
    return F.transform(F.slice(kept, 1, 10), lambda x, i: _question(i + 1, F.regexp_replace(x, r"\s+\d\s*\z", ""), F.lit(3)))


def numbered_parts(block: Column, hits: Column) -> Column:
    """Layout one: each number with an a) begins a question, its a) and b) are joined. ``hits`` are the numbers, the block is cut at them."""
    bodies = F.filter(F.split(block, HIT), lambda _, i: i > 0)
    each = F.filter(F.zip_with(hits, bodies, lambda n, x: F.struct(_as_number(n).alias("n"), F.concat(F.lit("a)"), x).alias("x"))), lambda q: q["n"].isNotNull())
    told = F.transform(each, lambda q: F.struct(q["n"].alias("n"), _either(_tidy(F.regexp_extract(q["x"], A_TEXT, 1)), _tidy(F.regexp_extract(q["x"], B_TEXT, 1)), 10).alias("t")))
    return F.transform(F.filter(told, lambda q: q["t"] != ""), lambda q: _question(q["n"], q["t"], F.lit(14)))


def module_bodies(block: Column) -> Column:
    """The parts below each module heading, an array for each heading; a part begins with its a) or b)."""
    return F.transform(F.filter(F.split(F.concat(F.lit("\n"), block), MODULE_HEAD), lambda _, i: i > 0), lambda body: F.regexp_extract_all(body, F.lit(PARTS), F.lit(0)))


def module_parts(bodies: Column) -> Column:
    """Layout two: below each module heading an a) and the b) that follows it are a question, numbered from 11 to 20."""

    def pairs(parts: Column) -> Column:
        rest = lambda p: F.substring(p, 3, 1 << 30)
        both = F.transform(parts, lambda p, i: F.struct(p.alias("a"), F.get(parts, i + 1).alias("after")))
        told = F.transform(F.filter(both, lambda x: x["a"].startswith("a)")), lambda x: F.struct(_tidy(rest(x["a"])).alias("a"), F.when(x["after"].startswith("b)"), _tidy(rest(x["after"]))).otherwise("").alias("b")))
        return F.transform(F.filter(told, lambda x: F.length(x["a"]) > 10), lambda x: F.when(F.length(x["b"]) > 10, F.concat(x["a"], F.lit(" OR "), x["b"])).otherwise(x["a"]))

    found = F.slice(F.flatten(F.transform(bodies, pairs)), 1, 20 - FIRST_B + 1)
    return F.transform(found, lambda x, i: _question(i + FIRST_B, x, F.lit(14)))


def loose_parts(block: Column) -> Column:
    """What stands around numbers with an a) anywhere: number and text.

    Each step is an array of its own, as an expression is computed wherever a lambda names it.
    """
    windows = F.regexp_extract_all(block, F.lit(LOOSE_WINDOW), F.lit(1))
    numbers = F.transform(windows, lambda w: F.struct(w.alias("w"), F.translate(F.regexp_extract(w, LOOSE_NUMBER, 1), "lI", "11").try_cast("int").alias("n")))
    b_ends = F.transform(F.filter(numbers, lambda q: q["n"].between(FIRST_B, 20)), lambda q: F.struct(q["w"].alias("w"), q["n"].alias("n"), F.instr(F.substring(q["w"], 1, LOOK_B), "b)").alias("b")))

    def following(q: Column) -> Column:
        after = F.when(q["b"] > 0, q["b"] + 1).otherwise(0)  # characters up to the end of b)
        return F.struct(q["w"].alias("w"), q["n"].alias("n"), after.alias("after"), F.when(q["b"] > 0, F.regexp_instr(q["w"].substr(after + 1, F.lit(LOOK_NEXT)), F.lit(LOOSE))).alias("next"))

    def cut(q: Column) -> Column:
        end = F.when(q["after"] == 0, REST).when(q["next"] > 0, q["after"] + q["next"] - 1).otherwise(q["after"] + REST)
        return F.struct(q["n"].alias("n"), q["w"].substr(F.lit(1), end).alias("t"))

    def said(q: Column) -> Column:
        a = _tidy(F.regexp_replace(F.regexp_extract(q["t"], A_TEXT, 1), r"\A\s*[Il1]?[12][0-9]\s*", ""))
        return _question(q["n"], _either(a, _tidy(F.regexp_extract(q["t"], B_TEXT, 1)), 15), F.lit(14))

    return F.filter(F.transform(F.transform(F.transform(b_ends, following), cut), said), lambda q: q["text"] != "")


def _firsts(items: str) -> Column:
    """The first question of each number, in order. ``items`` names a column: what stands inside of a lambda is computed for each element."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, lambda q: q["question_number"]), x["question_number"]) == i + 1)


def _others(items: str, known: str) -> Column:
    """The questions of ``items`` whose numbers ``known`` hasn't; both name columns."""
    return F.filter(items, lambda q: ~F.array_contains(F.transform(known, lambda x: x["question_number"]), q["question_number"]))


def numbered_lines(text: Column) -> Column:
    """Numbered lines 1 to 20 of three kinds, kind after kind. The text is walked once for a kind, and then each match for its groups."""

    def found(pattern: str) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(whole, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("n"), strip(F.regexp_extract(m, pattern, 2)).alias("t")))

    ok = F.filter(F.concat(*map(found, NUMBERED_LINES)), lambda m: m["n"].try_cast("int").between(1, 20) & (F.length(m["t"]) >= 15))
    return F.transform(ok, lambda m: _question(m["n"], m["t"], F.when(m["n"].cast("int") <= 10, 3).otherwise(14)))


def _by_number(items: Column) -> Column:
    keyed = F.transform(items, lambda q, i: F.struct(q["question_number"].cast("int").alias("n"), i.alias("i"), q.alias("q")))
    return F.transform(F.array_sort(keyed), lambda k: k["q"])


def questions_by_format(papers: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """``key, pos, question_number, text, marks, layout`` (numbered or modules; with ``+loose`` and ``+lines`` where a rescue ran).

    A null text gives no rows. Each step is a column of its own, so that no expression stands in another's lambda.
    """
    numbered, few, short = F.size("hits") >= ENOUGH_HITS, F.size("qb") < ENOUGH_B, F.size("qs") < ENOUGH
    rows = papers.select(key, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r", "").alias("t"))
    rows = rows.select(key, "t", F.regexp_extract("t", PART_B, 1).alias("b"), part_a(F.col("t")).alias("qa"))
    rows = rows.withColumn("hits", F.regexp_extract_all("b", F.lit(HIT), F.lit(1)))
    rows = rows.withColumn("bodies", F.when(~numbered, module_bodies(F.col("b"))))
    rows = rows.withColumn("qb", F.when(numbered, numbered_parts(F.col("b"), F.col("hits"))).otherwise(module_parts(F.col("bodies"))))
    rows = rows.withColumn("around", F.when(few, loose_parts(F.col("b"))).otherwise(_none()))
    rows = rows.withColumn("others", _others("around", "qb"))
    rows = rows.withColumn("loose", _firsts("others")).withColumn("qs", F.concat("qa", "qb", "loose"))
    # of questions of one number the last stays, where the first stood
    numbers = F.transform("qs", lambda q: q["question_number"])
    rows = rows.withColumn("last", F.when(short, F.filter("qs", lambda q, i: ~F.array_contains(F.slice(numbers, i + 2, F.size("qs")), q["question_number"]))))
    rows = rows.withColumn("lined", F.when(short, numbered_lines(F.col("t"))).otherwise(_none()))
    rows = rows.withColumn("new", _others("lined", "last")).withColumn("more", _firsts("new"))
    layout = F.concat(F.when(numbered, "numbered").otherwise("modules"), F.when(few, "+loose").otherwise(""), F.when(short, "+lines").otherwise(""))
    rows = rows.select(key, layout.alias("layout"), F.when(short, _by_number(F.concat("last", "more"))).otherwise(F.col("qs")).alias("all"))
    return rows.select(key, "layout", F.posexplode_outer("all").alias("pos", "q")).where("pos IS NOT NULL").select(key, "pos", "q.question_number", "q.text", "q.marks", "layout")


# What begins a question, and lines that don't go on with one.
STARTS = r"^(\d{1,2})\s*[.)\]:\s]+(.*)$"
NOT_MORE = (r"(?i)^(PART|MODULE|SECTION|REG|TIME|MAX|COURSE|CODE|SCHEME|SEMESTER|BRANCH)", r"(?i)^Page\s+\d+", r"^\d+\s*$", r"(?i)^[A-Z]{2,3}\d{3}")


def questions_by_line(papers: DataFrame, key: str = "paper_id", text: str = "text", existing: str | None = None) -> DataFrame:
    """``key, pos, question_number, text``: a line that begins with a number from 1 to 20 starts a question, lines after it go on with it.

    Lines of headings, page numbers and course codes, and those of up to three characters, are left out. A question needs ten
    characters; of one number the first stays, and numbers in ``existing`` (an array column) are taken.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), strip), lambda x: F.length(x) > 0)
    taken = F.col(existing).cast("array<string>") if existing else F.array().cast("array<string>")
    rows = papers.select(key, lines.alias("lines"), F.coalesce(taken, F.array().cast("array<string>")).alias("taken"))
    number = lambda x: F.regexp_extract(x, STARTS, 1)
    rows = rows.withColumn("at", F.filter(F.transform("lines", lambda x, i: F.when(number(x).try_cast("int").between(1, 20), i)), lambda i: i.isNotNull()))

    def goes_on(x: Column) -> Column:
        out = F.length(x) > 3
        for p in NOT_MORE:
            out = out & ~x.rlike(p)
        return out

    spans = F.transform("at", lambda a, i: F.struct(F.get("lines", a).alias("first"), F.slice("lines", a + 2, F.coalesce(F.get("at", i + 1), F.size("lines")) - a - 1).alias("more")))
    rows = rows.withColumn("spans", spans)
    found = F.transform("spans", lambda s: F.struct(number(s["first"]).alias("question_number"), F.array_join(F.concat(F.array(strip(F.regexp_extract(s["first"], STARTS, 2))), F.filter(s["more"], goes_on)), " ").alias("text")))
    rows = rows.withColumn("found", F.filter(found, lambda q: (F.length(q["text"]) >= 10) & ~F.array_contains("taken", q["question_number"])))
    rows = rows.withColumn("firsts", _firsts("found")).select(key, F.posexplode_outer("firsts").alias("pos", "q")).where("pos IS NOT NULL")
    return rows.select(key, "pos", "q.question_number", "q.text")
