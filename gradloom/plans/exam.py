"""The exam model over the driver's tables, as views that Spark and the oracle read alike.

Each view is one SQL text in the dialect that both engines share. ``Tables`` gives a view
or a table as a DataFrame; :func:`with_views` puts the views a query names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_VERB = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(("Explain", "Define", "Analyze", "Design", "Compare", "Evaluate", "Calculate"), 1)) + " ELSE 'Discuss' END"

ASKED = ("Explain", "Define", "Describe", "Discuss", "Outline", "Compare", "State", "Derive", "Illustrate", "Summarise", "Evaluate")


def _printed() -> str:
    nl = " || chr(10) || "
    part_a = nl.join(["'UNIVERSITY'", "'PART A'", "'(Answer all questions, each carries 3 marks)'", "'Marks'", *[f"'{w} the role of ' || p_name || ' in detail 3'" for w in ASKED], "'12'", "'Page 1 of 2'"])
    numbered = nl.join(["'PART B'", *[x for n in range(11, 21) for x in (f"'{'I I' if n == 11 else n} a) Discuss ' || p_name || ' case {n} of ' || p_type || ' 7'", "'   b)  Compare ' || p_brand || ' with  ' || p_name || ' 7'")]])
    modules = [nl.join(f"'{x}" for x in (f"Module - {m}'", f"a) Discuss ' || p_name || ' topic {m} at length 7'", f"b) Compare ' || p_brand || ' for {m} or more 7'", f"a) Derive ' || p_type || ' rule {m} in ' || p_name", "OR'")) for m in range(1, 6)]
    some, rest = f"'PART B'{nl}" + nl.join(modules[:3]), nl.join(modules[3:])
    loose = "'PART B' || chr(10) || " + " || ' ' || ".join(f"'a){n} Explain ' || p_name || ' usage in ' || p_brand || ' plants b) Compare ' || p_type || ' models of ' || p_name" for n in (11, 12, 13)) + f"{nl}repeat('=', 500){nl}'17. Discuss the ' || p_name || ' economy of ' || p_brand{nl}'Q18 Outline the whole ' || p_type || ' plan'"
    lines = nl.join(f"'{n}. Explain the ' || p_name || ' rule {n} of ' || p_type" for n in (1, 2, 3, 3, 4, 5, 6))
    return f"""
SELECT p_partkey AS paper_id, CASE p_partkey % 4 WHEN 0 THEN {part_a}{nl}{numbered} WHEN 1 THEN {part_a}{nl}{some} || CASE WHEN p_partkey % 8 = 1 THEN chr(10) || {rest} ELSE '' END
    WHEN 2 THEN {part_a}{nl}{loose} ELSE {lines} END AS text
FROM part"""


VIEWS = {
    # question occurrences: one row for each line item; a subject's topics appear in one to seven years, so all tiers occur
    "questions": f"""
SELECT l_orderkey AS paper_id, l_linenumber AS question_no, l_partkey AS topic_id, l_suppkey AS supplier_id, l_suppkey % 10 AS subject_id,
    CAST(p_size % 5 + 1 AS INT) AS module_number, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS part, CAST(l_quantity AS INT) AS marks,
    CAST(year(o_orderdate) AS STRING) AS exam_year, o_orderpriority AS exam_type, o_orderstatus AS paper_status, p_name || ' ' || CAST(l_partkey AS STRING) AS topic_name,
    {_VERB} || ' the ' || p_name || ' (' || CAST(CAST(l_quantity AS INT) AS STRING) || ' marks)' AS qtext
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "papers": """
SELECT o_orderkey AS paper_id, o_custkey AS owner_id, o_custkey % 10 AS subject_id, CAST(year(o_orderdate) AS STRING) AS exam_year, o_orderpriority AS exam_type,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status, o_orderkey % 7 = 0 AS is_deleted
FROM orders""",
    "modules": """
SELECT CAST(s.id AS BIGINT) AS subject_id, CAST(m.id AS INT) AS module_number, 'Module ' || CAST(m.id AS STRING) AS module_name, 20.0 AS weightage
FROM (SELECT DISTINCT o_custkey % 10 AS id FROM orders) s CROSS JOIN (SELECT DISTINCT p_size % 6 + 1 AS id FROM part) m""",
    # single lines as they stand in papers, in eight forms
    "qlines": """
SELECT p_partkey AS topic_id, n.n AS form, CASE n.n
    WHEN 0 THEN 'Q' || CAST(p_size AS STRING) || '. Explain the ' || p_name || ' (' || CAST(p_size AS STRING) || ' marks)'
    WHEN 1 THEN '(a) Define ' || p_name || ' - (Dec 2022, ' || CAST(p_size AS STRING) || ' marks)'
    WHEN 2 THEN CAST(p_size AS STRING) || ') What is ' || p_name || '? [' || CAST(p_size AS STRING) || ']'
    WHEN 3 THEN 'Marks: ' || CAST(p_size AS STRING) || ' Discuss and explain the ' || p_name || ' with neat diagram.'
    WHEN 4 THEN 'Describe the planning of ' || p_name || ' in detail OR compare ' || p_type || ' (' || CAST(p_size AS STRING) || ')'
    WHEN 5 THEN 'Question ' || CAST(p_size AS STRING) || ': 0 Identify ' || p_name || ' at ' || p_brand || ' (June 2023, 3 marks)'
    WHEN 6 THEN 'PART B [Answer' ELSE p_name END AS line
FROM part CROSS JOIN (SELECT l_linenumber - 1 AS n FROM lineitem GROUP BY l_linenumber) n""",
    # papers in the layouts that print Part A without numbers: numbered parts, module parts (every other with few), parts anywhere, numbered lines alone
    "printed": _printed(),
    # papers whose questions are lines that begin with a number
    "lined": """
SELECT p_partkey AS paper_id, 'COURSE CODE: MCN301' || chr(10) || '1. Define ' || p_name || chr(10) || '   in terms of ' || p_type || chr(10) || 'Page 2' || chr(10) || '99' || chr(10) || 'ab' || chr(10) || '2) What is ' || p_brand || '?'
    || chr(10) || 'MODULE 1' || chr(10) || chr(10) || 'more on ' || p_name || chr(10) || '1: again ' || p_name || ' and more' || chr(10) || '21. no start ' || p_type || chr(10) || '3] x' || chr(10) || '4 : Discuss ' || p_brand || ' at length' AS text
FROM part""",
    # page text with what recognition leaves in it
    "scans": """
SELECT p_partkey AS paper_id, 'APJ Abdul Kalam Technological University' || chr(10) || '  Reg No:   ' || CAST(p_partkey AS STRING) || chr(10) || chr(10) || chr(10) || 'PARTA' || chr(10)
    || '1 .  Deﬁne   ' || p_name || ' (3 marks)' || chr(10) || '- ' || CAST(p_size AS STRING) || ' -' || chr(10) || '2. 1et the algo rithm ' || p_brand || ' compu-' || chr(10) || 'ter, ( ii ) “' || p_type || '”'
    || chr(10) || 'J' || chr(10) || '|__|' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'Part — B' WHEN 1 THEN '## PART B ==' ELSE 'part:b' END || chr(10) || 'Page 2 of 10' || chr(10) || '?!' || chr(10)
    || 'Module ' || CAST(p_size % 5 + 1 AS STRING) || chr(10) || '11. Discuss requ manage ment of ' || p_name || chr(10) || '    (a) de fi ne hazard [' || CAST(p_size AS STRING) || ' marks]' || chr(10) || 'turn over' || chr(10)
    || CASE WHEN p_partkey % 2 = 0 THEN 'December 2022' ELSE 'Max marks: 100' END || chr(10) || '12. Plan ning – (Dec 2022, 7 marks)' || chr(10) || '13 b) Explain the hazards of ' || p_type || ' in coastal regions 8' AS text
FROM part""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views it names, and those they name, as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                add(VIEWS[v])
                need.append(v)

    add(sql)
    if not need:
        return sql
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    body = sql.strip()
    return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE'):]}" if body.startswith("WITH RECURSIVE") else f"WITH {views}, {body[4:]}" if body.startswith("WITH ") else f"WITH {views} {body}"


#: Views whose rows are made, and then read, at some cost each out of the few narrow rows of ``part``: a file of a size for one task.
COSTLY = frozenset(("qlines", "printed", "lined", "scans"))

#: Rows of ``lineitem`` for each task of the joins that make questions: some 100 MB to sort. By itself Spark gives a task what is 64 MB compressed, or
#: a share of all rows where there are few shuffle partitions.
ROWS_A_TASK = 1_000_000
_LINES = "lineitem JOIN part ON l_partkey = p_partkey"


class Tables:
    """The tables of a folder, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "questions":
            return self._questions()
        if name in VIEWS:
            return self.sql(VIEWS[name], name in COSTLY)
        raise AttributeError(name)

    def _questions(self) -> DataFrame:
        """The view; from large tables by joins whose tasks grow in number and not in size."""
        tasks = -(-self.lineitem.count() // ROWS_A_TASK)
        if tasks <= self.spark.sparkContext.defaultParallelism:
            return self.sql(VIEWS["questions"])
        tasks = max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        lines = self.lineitem.repartition(tasks, "l_partkey").join(self.part, F.col("l_partkey") == F.col("p_partkey")).repartition(tasks, "l_orderkey")
        return self.spark.sql(VIEWS["questions"].replace(_LINES, "{lines}").replace("JOIN orders", "JOIN {orders}"), lines=lines, orders=self.orders)

    def dealt(self, name: str, key: str) -> DataFrame:
        """A table's rows dealt by their key: what is made of them runs in as many tasks as there are cores or partitions, however few files hold them."""
        tasks = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return getattr(self, name).repartition(tasks, key)

    def sql(self, text: str, costly: bool = False) -> DataFrame:
        """``text`` over tables and views; with ``costly`` the rows of ``part`` are dealt first."""
        used = [t for t in (*TABLES, *VIEWS) if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **{t: self.dealt(t, "p_partkey") if costly and t == "part" else getattr(self, t) for t in used})
