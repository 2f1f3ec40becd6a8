"""Question extractors for papers whose layout the line parser does not fit.

Each is an expression over the paper's text that yields an array of structs, exploded into
rows: the look-ahead patterns run in the JVM, papers stay one row until the last step, and
nothing is shuffled except where a rule compares questions of one paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.functions.rewrite import STRIP, Sub, rewrite, strip

# Headings, misread digits, words that end a page's line.
_PART = r"P\s*A\s*R\s*T\s*[-–:—]?\s*"
_MODULE = r"Module\s*[-–:]?\s*"
PART_A_BLOCK = rf"(?is){_PART}A(.*?)(?:{_PART}B|{_MODULE}[1IVX])"
PART_A_FIXES = (
    Sub(r"(?i)\(Answer.*?\)"), Sub(r"(?i)each\s+question\s+carries.*"), Sub(r"\bI\s+(What|How|Explain|Define|List)", "1 $1"), Sub(r"\bl0\b", "10"), Sub(r"\bl(\d)", "1$1"), Sub(r"\bO(\d)", "0$1"), Sub(r"\s+", " "), STRIP,
)
PART_A_STARTS = (r"""(\d{1,2})\s+[A-Z"'(\[`]""", r"(\d{1,2})\s{1,3}\S")
TRAILING = (Sub(r"^\d{1,2}\s+"), Sub(r"\s+3\s*\z"), Sub(r"\s+\d\s*\z"), Sub(r"(?i)\s+(causes|depletion|hazards|assessments|disasters|management|reduction|examples|country)\s*\.?\s*\z"), STRIP)
MODULE_BLOCK = rf"(?is){_MODULE}(\d+|[IVX]+)(.*?)(?={_MODULE}(?:\d+|[IVX]+)|\z)"
SUB_QUESTION = r"(?i)(\d{1,2})\s*([a-z])\s*\)?[)\s]+([A-Z][^0-9\n]*?)(?=\s+\d{1,2}\s*[a-z]?\s*\)?|\z)"
NUMBERED = r"(?m)^\s*(\d+)\s*[.)]\s*([^\n]+?)(?:\s*\((\d+)\s*marks?\))?\s*$"
LETTERED = r"(?im)^\s*(\d+)\s*([a-z])\s*[.)]\s*([^\n]+?)(?:\s*\((\d+)\s*marks?\))?\s*$"
MARKED = r"(?i)(?:Qn|Q|Question)?\s*(\d+)[.)]\s*(.+?)\((\d+)\s*marks?\)"
MARKED_SUB = r"(?i)(?:Qn|Q|Question)?\s*(\d+)[(\[](a|b)[)\]]\s*(.+?)\((\d+)\s*marks?\)"
ANY_NUMBERED = r"(?m)^\s*[Qq]?\.?\s*(\d{1,2})\s*[.)\]]\s*([^\n]{15,})"
HEADERS = (r"^\d{10,}$", r"(?i)^Page\s*\d+", r"(?i)^Name:", r"^\$#\d+", r"(?i)^APJ ABDUL KALAM", r"(?i)^B\.?Tech\s+Degree", r"(?i)^Course\s*(Code|Name):", r"(?i)^Max\.?\s*Marks", r"(?i)^Duration:", r"(?i)^\d+\s+of\s+\d+", r"^[.,;:\-\s]+$")
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6}
LEAST = 15


def matches(text: Column, pattern: str, *groups: int) -> Column:
    """All matches as structs g1, g2, ... of the given groups, in order."""
    lists = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups, 1)]
    return F.arrays_zip(*lists)


def rows(papers: DataFrame, key: str, found: Column) -> DataFrame:
    return papers.select(key, F.posexplode(found).alias("pos", "m"))


def _asked(found: DataFrame, keep: list[str], ok: Column, **columns: Column) -> DataFrame:
    """``keep`` and ``columns`` of the rows for which ``ok`` holds and whose ``text`` is long enough. They are made once and then looked at:
    a filter after a projection is pushed below it, and makes costly columns a second time."""
    made = F.array(F.struct(ok.alias("ok"), *[c.alias(n) for n, c in columns.items()]))
    rows = found.select(*keep, F.explode(F.filter(made, lambda q: q["ok"] & (F.length(q["text"]) >= LEAST))).alias("q"))
    return rows.select(*keep, *[f"q.{n}" for n in columns])


def drop_headers(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), strip), _not_header), "\n")


def _not_header(line: Column) -> Column:
    out = F.length(line) > 0
    for h in HEADERS:
        out = out & ~line.rlike(h)
    return out


def _number(text: Column) -> Column:
    out = F.when(text.rlike(r"^\d+\z"), text.try_cast("int"))
    for r, n in ROMAN.items():
        out = out.when(F.upper(text) == r, n)
    return out


def part_a(papers: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """Short questions 1 to 10 of the Part A block; each runs to the next number, 3 marks."""
    block = rewrite(F.regexp_extract(text, PART_A_BLOCK, 1), PART_A_FIXES)
    pieces = [F.regexp_extract_all("block", F.lit(rf"{s}.*?(?={s}|\z)"), F.lit(0)) for s in PART_A_STARTS]
    found = papers.select(key, block.alias("block"))
    q = found.select(key, F.posexplode(F.when(F.size(pieces[0]) >= 5, pieces[0]).otherwise(pieces[1])).alias("pos", "piece"))
    q = q.select(key, "pos", "piece", F.regexp_extract("piece", r"^(\d{1,2})", 1).alias("number"))
    return _asked(
        q, [key, "pos"], F.col("number").try_cast("int") <= 10, question_number=F.col("number"), text=rewrite(F.col("piece"), TRAILING), marks=F.lit(3), part=F.lit("A"), module_hint=F.lit(None).cast("int")
    )


def part_b(papers: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """Sub-questions (11a) of each module's section; a trailing number up to 14 is the marks, else 7."""
    sections = rows(papers, key, matches(F.col(text), MODULE_BLOCK, 1, 2)).select(key, (F.col("pos") * 1000).alias("base"), _number(F.col("m.g1")).alias("module_hint"), F.col("m.g2").alias("body")).where("module_hint IS NOT NULL")
    body = rewrite(F.regexp_replace("body", r"(?is)PART\s*[A-Z].*", ""), (Sub(r"\bl(\d)", "1$1"), Sub(r"\bI\s*E\b", "18"), Sub(r"\s+", " "), STRIP))
    q = sections.select(key, "base", "module_hint", F.posexplode(matches(body, SUB_QUESTION, 1, 2, 3)).alias("at", "m"))
    tail = F.regexp_extract("m.g3", r"\s(\d{1,2})\s*\z", 1).try_cast("int")
    cleaned = rewrite(F.when(tail <= 14, F.regexp_replace("m.g3", r"\s+\d{1,2}\s*\z", "")).otherwise(F.col("m.g3")), (Sub(r"\s*[E]\s*\z"), Sub(r"\s+\d\s*\z"), STRIP))
    q = q.select(key, (F.col("base") + F.col("at") + 100).alias("pos"), F.concat("m.g1", F.lower("m.g2")).alias("question_number"), cleaned.alias("text"), F.when(tail <= 14, F.nullif(tail, F.lit(0))).alias("m2"), "module_hint")
    return _asked(q, [key, "pos"], F.lit(True), question_number=F.col("question_number"), text=F.col("text"), marks=F.coalesce("m2", F.lit(7)), part=F.lit("B"), module_hint=F.col("module_hint"))


def by_lines(papers: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """The fallback: a line that begins with a number and a capital starts a question, which runs to the next such line or heading."""
    start = r"(?m)^(\d{1,2})[ \t]*([a-zA-Z])?[ \t]*\)?[ \t.]*([A-Z][^\n]*(?:\n(?!\d{1,2}[ \t]*[a-z]?[ \t]*\)?[^\n]*[A-Z]|(?i:module|part)\s)[^\n]*)*)"
    q = rows(papers, key, matches(F.col(text), start, 1, 2, 3)).select(key, "pos", "m", rewrite(F.col("m.g3"), (Sub(r"\s+", " "), STRIP)).alias("body"))
    q = q.withColumn("tail", F.regexp_extract("body", r"\s(\d{1,2})\s*\z", 1).try_cast("int"))
    body, tail, first = F.col("body"), F.col("tail"), F.col("m.g1").try_cast("int") <= 10
    return _asked(
        q, [key, "pos"], F.lit(True), question_number=F.concat("m.g1", F.lower("m.g2")), text=F.when(tail <= 14, F.regexp_replace(body, r"\s+\d{1,2}\s*\z", "")).otherwise(body),
        marks=F.coalesce(F.when(tail <= 14, tail), F.when(first, 3).otherwise(7)), part=F.when(first, "A").otherwise("B"), module_hint=F.lit(None).cast("int"),
    )


def deduplicated(questions: DataFrame, key: str = "paper_id") -> DataFrame:
    """The first of questions of a paper with the same number and the same first 30 characters."""
    w = Window.partitionBy(key, "question_number", strip(F.lower(F.substring("text", 1, 30)))).orderBy("pos")
    return questions.where(F.length("text") >= 10).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def extract_questions(papers: DataFrame, key: str = "paper_id", text: str = "text", fewest: int = 5) -> DataFrame:
    """Part A and Part B together; papers with fewer than five questions are read by lines instead."""
    clean = papers.select(key, drop_headers(F.col(text)).alias(text))
    both = part_a(clean, key, text).unionByName(part_b(clean, key, text))
    enough = both.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest).select(key)
    rest = clean.join(enough, key, "left_anti")
    return deduplicated(both.join(enough, key, "left_semi").unionByName(by_lines(rest, key, text)), key)


def numbered(papers: DataFrame, low: int, high: int, default: int, part: str, key: str = "paper_id", text: str = "text") -> DataFrame:
    """Numbered lines of a range of numbers, with the marks in brackets or a default."""
    q = rows(papers, key, matches(F.col(text), NUMBERED, 1, 2, 3))
    return q.where(F.col("m.g1").try_cast("int").between(low, high)).select(key, "pos", F.col("m.g1").alias("question_number"), strip(F.col("m.g2")).alias("text"), F.coalesce(F.col("m.g3").try_cast("int"), F.lit(default)).alias("marks"), F.lit(part).alias("part"))


def with_subs(papers: DataFrame, questions: DataFrame, default: int = 7, key: str = "paper_id", text: str = "text") -> DataFrame:
    """Numbered questions with their lettered sub-questions, joined on the number; the first question of a number takes them."""
    subs = rows(papers, key, matches(F.col(text), LETTERED, 1, 2, 3, 4)).select(key, F.col("m.g1").alias("question_number"), F.struct("pos", F.col("m.g2").alias("letter"), strip(F.col("m.g3")).alias("text"), F.coalesce(F.col("m.g4").try_cast("int"), F.lit(default)).alias("marks")).alias("s"))
    own = subs.groupBy(key, "question_number").agg(F.array_sort(F.collect_list("s")).alias("sub_questions"))
    first = F.row_number().over(Window.partitionBy(key, "question_number").orderBy("pos")) == 1
    joined = questions.withColumn("first", first).join(own, [key, "question_number"], "left")
    return joined.withColumn("sub_questions", F.when(F.col("first"), F.col("sub_questions"))).drop("first")


def marked_lines(lines: DataFrame, line: str, *keep: str) -> DataFrame:
    """Lines with a number and marks: up to 3 marks is part A; an (a) or (b) after the number is a sub-part of part B."""
    one, two = F.col(line).rlike(MARKED), F.col(line).rlike(MARKED_SUB)
    pick = lambda a, b: F.when(one, F.regexp_extract(line, MARKED, a)).otherwise(F.regexp_extract(line, MARKED_SUB, b))
    marks = pick(3, 4).try_cast("int")
    return lines.where(one | two).select(*keep, pick(1, 1).try_cast("int").alias("question_number"), F.when(~one, F.lower(F.regexp_extract(line, MARKED_SUB, 2))).alias("sub_part"), strip(pick(2, 3)).alias("text"), marks.alias("marks"), F.when(one & (marks <= 3), "A").otherwise("B").alias("part"))


def first_numbered(papers: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """Long numbered lines 1 to 20, the first of each number, 3 or 14 marks."""
    q = rows(papers, key, matches(F.col(text), ANY_NUMBERED, 1, 2)).select(key, "pos", F.col("m.g1").try_cast("int").alias("n"), strip(F.col("m.g2")).alias("text"))
    q = q.where(F.col("n").between(1, 20) & (F.length("text") >= LEAST)).withColumn("r", F.row_number().over(Window.partitionBy(key, "n").orderBy("pos"))).where("r = 1")
    return q.select(key, F.col("n").alias("question_number"), F.substring("text", 1, 2000).alias("text"), F.when(F.col("n") <= 10, 3).otherwise(14).alias("marks"))


def word_chunks(text: Column, n: int) -> Column:
    """The words of a text in n equal chunks, the last one taking the rest."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)
    size = F.floor(F.size(words) / n).cast("int")
    last = F.size(words) - size * (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_join(F.slice(words, i * size + 1, F.when(i < n - 1, size).otherwise(last)), " "))


# Fixed value: what separates the parts of a paper.
PART_HEADER = r"(?i)PART\s*[AB]"


def part_sections(papers: DataFrame, key: str, text: str) -> DataFrame:
    """``key, part, n, section``: what follows each header of a part, up to the next one; headers that
    aren't written with one blank begin a section that belongs to no part."""
    headers = F.regexp_extract_all(text, F.lit(PART_HEADER), F.lit(0))
    sections = F.split(text, PART_HEADER, -1)
    each = F.zip_with(headers, F.slice(sections, F.lit(2), F.size(headers)), lambda h, s: F.struct(F.upper(h).alias("header"), s.alias("section")))
    rows = papers.select(key, F.posexplode(each).alias("i", "s"))
    return rows.where(F.col("s.header").isin("PART A", "PART B")).select(key, F.substring("s.header", 6, 1).alias("part"), (F.col("i") + 1).alias("n"), "s.section")
