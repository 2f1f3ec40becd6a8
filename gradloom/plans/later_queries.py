"""Queries for jobs, recognition, keyword clustering and whole-subject reports, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradloom.functions import classify as C
from gradloom.operators import clusters as K
from gradloom.operators import extract as X
from gradloom.operators import jobs as J
from gradloom.operators import stats as A
from gradloom.plans import duck as D
from gradloom.plans import relational_queries as Q
from gradloom.plans.exam import Tables

_STATES = list(J.PROGRESS)
_STATE = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES)) + " END"
_SHARE = "CASE status " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in J.PROGRESS.items()) + " END"
_JOBS = f"jobs AS (SELECT job, arg_max(status, (event_id, share)) AS status, CAST(max(share) AS INT) AS progress FROM (SELECT *, {_SHARE} AS share FROM (SELECT user_id AS job, event_id, {_STATE} AS status FROM events)) GROUP BY job)"


def _progress(t: Tables):
    return J.job_progress(t.events.select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), F.expr(_STATE).alias("status")))


def _lines(t: Tables, confidence: str):
    return t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("text"), F.expr(confidence).alias("confidence"))


_FIRST, _SECOND = "CAST(l_tax * 10 AS DOUBLE)", "CAST(l_discount * 10 AS DOUBLE)"


def _read(name: str, confidence: str) -> str:
    return f"{name} AS (SELECT l_orderkey AS page, string_agg(l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS text, round(avg({confidence}), 6) AS confidence FROM lineitem GROUP BY 1)"


_BOTH, _EITHER = "len(list_intersect(l.v, s.v))", "len(list_distinct(list_concat(l.v, s.v)))"
_ALIKE = f"CASE WHEN len(l.v) = 0 OR len(s.v) = 0 THEN 0.0 WHEN {_BOTH} / least(len(l.v), len(s.v)) > 0.6 THEN least(1.0, {_BOTH} / {_EITHER} * 1.3) ELSE {_BOTH} / {_EITHER} END >= 0.55"
_COUNTS = ("part_a", "part_b", "tier_1", "tier_2", "tier_3", "tier_4")
#: metric, the query that computes it, its key and value
_BUNDLE = (
    ("total_questions", "a01_overview", "''", "total_questions"), ("unique_questions", "a01_overview", "''", "unique_questions"), ("duplicate_percentage", "a01_overview", "''", "duplicate_percentage"),
    ("module", "a02_module_distribution", "CAST(module_number AS STRING)", "count"), ("difficulty", "a03_difficulty_distribution", "difficulty", "count"), ("bloom", "a04_bloom_distribution", "bloom", "count"),
)


def _bundle(t: Tables):
    # as in the single queries; there only the modules are without every seventh topic
    q = t.questions.select("subject_id", F.when(F.col("topic_id") % 7 > 0, F.col("module_number")).alias("module_number"), (F.col("question_no") > 3).alias("duplicate"), C.difficulty(F.col("qtext"), F.col("marks")).alias("difficulty"), C.bloom_level(F.col("qtext")).alias("bloom"))
    return A.complete_stats(q, t.modules, Q.LEVELS)


QUERIES = {
    "st02_job_progress": (lambda t: _progress(t).select("job", "status", "progress"), f"WITH {_JOBS} SELECT job, status, progress FROM jobs"),
    "st03_status_poll": (
        lambda t: J.poll(_progress(t), t.customer.select(F.col("c_custkey").alias("job"))),
        f"WITH {_JOBS} SELECT c_custkey AS job, coalesce(status, 'not found') AS status, coalesce(progress, 0) AS progress FROM customer LEFT JOIN jobs ON c_custkey = job",
    ),
    "a37_call_statistics": (
        lambda t: J.call_statistics(t.events.select(F.expr("CASE WHEN event_id % 3 = 0 THEN 'local' ELSE 'hosted' END").alias("provider"), (F.col("event_id") % 5 != 0).alias("ok"))),
        "SELECT provider, calls, failures, calls::DOUBLE / (calls + failures) AS success_rate, greatest(0, 1500 - calls) AS free_remaining, calls <= 1500 AS within_free FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'local' ELSE 'hosted' END AS provider, count(CASE WHEN event_id % 5 <> 0 THEN 1 END) AS calls, count(CASE WHEN event_id % 5 = 0 THEN 1 END) AS failures FROM events GROUP BY 1)",
    ),
    "s12_page_confidence": (lambda t: J.page_confidence(_lines(t, _FIRST)), f"WITH {_read('one', _FIRST)} SELECT page, text, confidence FROM one"),
    "s13_low_confidence_retry": (
        lambda t: J.retried(J.page_confidence(_lines(t, _FIRST)), J.page_confidence(_lines(t, _SECOND))),
        f"WITH {_read('one', _FIRST)}, {_read('two', _SECOND)} SELECT page, one.text, CASE WHEN one.confidence < 0.6 THEN two.confidence ELSE one.confidence END AS confidence, one.confidence < 0.6 AS retried FROM one JOIN two USING (page)",
    ),
    "p13_images_near": (
        lambda t: J.images_near(t.part.select(F.col("p_partkey").alias("paper_id"), F.lit("1").alias("number"), F.expr("CASE WHEN p_size % 3 = 0 THEN p_size % 4 + 1 END").alias("page")), t.lineitem.select(F.col("l_partkey").alias("paper_id"), F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("int").alias("page"))).select("paper_id", "number", "page", F.array_join(F.col("images").cast("array<string>"), ",").alias("images")),
        "SELECT paper_id, '1' AS number, page, coalesce(string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey), '') AS images FROM (SELECT p_partkey AS paper_id, CAST(coalesce(CASE WHEN p_size % 3 = 0 THEN p_size % 4 + 1 END, 1) AS INT) AS page FROM part) LEFT JOIN (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem) ON l_partkey = paper_id AND l_linenumber = page GROUP BY 1, 2, 3".replace("string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey)", "array_to_string(list_sort(list(DISTINCT l_orderkey) FILTER (l_orderkey IS NOT NULL)), ',')"),
    ),
    "p15_part_sections": (
        lambda t: X.part_sections(t.scans, "paper_id", "text"),
        f"SELECT paper_id, part, n, section FROM (SELECT paper_id, upper(hs[i]) AS header, right(upper(hs[i]), 1) AS part, CAST(i AS INT) AS n, ss[i + 1] AS section FROM (SELECT paper_id, regexp_extract_all(text, {D.q(X.PART_HEADER)}) AS hs, string_split_regex(text, {D.q(X.PART_HEADER)}) AS ss FROM scans), UNNEST(range(1, len(hs) + 1)) AS u(i)) WHERE header IN ('PART A', 'PART B')",
    ),
    "k07_keyword_leaders": (
        lambda t: K.keyword_leaders(Q._self_sets(t), 0.55, "form", "ks", ("topic_id",)),
        Q.leaders_sql(f"{Q._NORM}, {Q._SETS}, s AS (SELECT topic_id AS bucket, form AS id, ks AS v, row_number() OVER (PARTITION BY topic_id ORDER BY form) AS k FROM sets)", _ALIKE, "topic_id", "form"),
    ),
    "a09_complete_stats": (
        _bundle,
        " UNION ALL ".join(f"SELECT subject_id, '{m}' AS metric, {key.replace('STRING', 'VARCHAR')} AS key, CAST({value} AS DOUBLE) AS value FROM ({Q.QUERIES[query][1]})" for m, query, key, value in _BUNDLE),
    ),
    "a33_subject_context": (
        lambda t: A.subject_context(t.questions, t.modules),
        "WITH q AS (SELECT subject_id, module_number, count(CASE WHEN part = 'A' THEN 1 END) AS part_a, count(CASE WHEN part = 'B' THEN 1 END) AS part_b FROM questions GROUP BY ALL), "
        f"x AS (SELECT subject_id, module_number, topic_id, {Q.TIER.format('count(DISTINCT exam_year)')} AS tier FROM questions GROUP BY ALL), "
        "y AS (SELECT subject_id, module_number, " + ", ".join(f"count(CASE WHEN tier = {i} THEN 1 END) AS tier_{i}" for i in (1, 2, 3, 4)) + " FROM x GROUP BY ALL) "
        "SELECT m.subject_id, m.module_number, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNTS) + " FROM modules m LEFT JOIN q ON m.subject_id = q.subject_id AND m.module_number = q.module_number LEFT JOIN y ON m.subject_id = y.subject_id AND m.module_number = y.module_number",
    ),
}
