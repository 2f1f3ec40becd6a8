"""Queries for reports, repairs and what builds on clusters, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradloom.functions import repairs as R
from gradloom.functions.rewrite import STRIP, Sub
from gradloom.operators import clusters as K
from gradloom.operators import similarity as V
from gradloom.operators import stats as A
from gradloom.plans import duck as D
from gradloom.plans import relational_queries as Q
from gradloom.plans.exam import Tables

_LINE = "replace(replace(line, ' the ', ' 3 '), 'Identify', 'Identiff')"
_COMPLETE = D.case([(f"starts_with({D.strip(_LINE)}, {D.q(k)}) AND length({D.strip(_LINE)}) <= {len(k) + 15}", D.q(v)) for k, v in R.COMPLETIONS.items()], D.rewrite(D.strip(_LINE), (*R.QUESTION_WORDS, STRIP)))
_PAGE = D.rewrite("text", (*R.PAGE_WORDS, Sub(r"[ \t]{2,}", " ")))
_TOPIC = D.rewrite("line", R.TOPIC)
_MODULE_VECTORS = 8


def _line():
    return F.expr(_LINE)


def _priority(t: Tables):
    """Topic groups of questions over exam years, ranked, 25 at most."""
    g = t.questions.groupBy("topic_id").agg(F.countDistinct("exam_year").alias("year_count"), F.array_join(F.array_sort(F.collect_set("exam_year")), ", ").alias("years"), F.min("exam_year").alias("first_year"), F.max(F.struct(F.length("qtext"), "qtext")).alias("longest"))
    w = Window.orderBy(F.desc("year_count"), "first_year", "topic_id")
    top = g.orderBy(F.desc("year_count"), "first_year", "topic_id").limit(25)  # the ranking sees 25 rows
    text = F.col("longest.qtext")
    return top.select("topic_id", F.row_number().over(w).alias("rank"), F.concat(F.substring(text, 1, 20), F.when(F.length(text) > 20, "…").otherwise("")).alias("topic"), "year_count", "years", Q.C.tier(F.col("year_count")).alias("tier"))


def _refined(t: Tables):
    """Members that are not like their cluster's representative become clusters of their own."""
    c = t.embeddings.select("vec_id", "label", "embedding")
    rep = V.centroid_representatives(t.embeddings, "label", "vec_id", "embedding")
    heads = rep.join(c.select(F.col("vec_id").alias("representative"), F.col("embedding").alias("head")), "representative")
    near = V.cosine(F.col("embedding"), F.col("head")) >= 0.2
    return c.join(heads, "label").select("vec_id", F.when(near | (F.col("vec_id") == F.col("representative")), F.col("label").cast("long")).otherwise(-F.col("vec_id") - 1).alias("cluster"))


def _units(t: Tables):
    return t.embeddings.where(f"vec_id < {_MODULE_VECTORS}").select(F.col("vec_id").alias("unit"), F.col("embedding").alias("unit_vector"))


_REP = "c AS (SELECT label, i, avg(e::DOUBLE) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS e FROM embeddings) GROUP BY ALL), d AS (SELECT e.label, e.vec_id, round(sqrt(sum((e.x::DOUBLE - c.m) * (e.x::DOUBLE - c.m))), 9) AS dist FROM (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY 1, 2), rep AS (SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS r FROM d) WHERE r = 1)"
_SESSION_ORDER = ("1-URGENT", "4-NOT SPECIFIED", "2-HIGH")

QUERIES = {
    "t10_clean_page_words": (
        lambda t: t.scans.select("paper_id", R.clean_page(F.col("text"), lone_label=False).alias("out")),
        f"SELECT paper_id, array_to_string(list_filter(string_split({_PAGE}, chr(10)), lambda l: regexp_matches(l, '[A-Za-z0-9]')), chr(10)) AS out FROM scans",
    ),
    "t22_topic_name": (
        lambda t: t.qlines.select("topic_id", "form", R.topic_name(F.col("line")).alias("out")),
        f"SELECT topic_id, form, CASE WHEN length(n) > 0 THEN n ELSE substr(line, 1, 50) END AS out FROM (SELECT topic_id, form, line, coalesce(array_to_string(list_transform({D.words('substr(' + D.rewrite('h', (Sub('(?i)^(the|a|an)' + chr(92) + 's+'),)) + ', 1, 60)')}, lambda w: CASE WHEN length(w) > 3 OR lower(w) IN ('ktu', 'co2', 'ph', 'gis') THEN upper(substr(w, 1, 1)) || lower(substr(w, 2)) ELSE lower(w) END), ' '), '') AS n FROM (SELECT topic_id, form, line, CASE WHEN contains(substr(x, 1, 100), '.') THEN split_part(x, '.', 1) WHEN contains(substr(x, 1, 100), '?') THEN split_part(x, '?', 1) ELSE x END AS h FROM (SELECT topic_id, form, line, {_TOPIC} AS x FROM qlines)))",
    ),
    "t30_repair_question": (lambda t: t.qlines.select("topic_id", "form", R.repair_question(_line()).alias("out")), f"SELECT topic_id, form, {_COMPLETE} AS out FROM qlines"),
    "t31_needs_cleaning": (
        lambda t: t.qlines.select("topic_id", "form", R.needs_cleaning(_line()).alias("out")),
        f"SELECT topic_id, form, NOT (length({D.strip(_LINE)}) < 8 OR " + " OR ".join(D.has(_LINE, p) for p in Q.T.JUNK) + ") AND (" + " OR ".join(D.has(_LINE, p) for p in R.SIGNALS) + f" OR (length({D.strip(_LINE)}) < 20 AND NOT ends_with({D.strip(_LINE)}, '?'))) AS out FROM qlines",
    ),
    "a16_dashboard": (
        lambda t: A.tier_counts(Q._topics(t), ("subject_id", "part")).join(t.questions.groupBy("subject_id", "part").agg(F.count(F.lit(1)).alias("questions")), ["subject_id", "part"], "left").select("subject_id", "part", "topics", F.col("tier_1").alias("critical"), "questions"),
        f"WITH {Q.TOPICS} SELECT t.subject_id, t.part, t.topics, t.critical, q.questions FROM (SELECT subject_id, part, count(*) AS topics, count(CASE WHEN priority_tier = 1 THEN 1 END) AS critical FROM topics GROUP BY 1, 2) t LEFT JOIN (SELECT subject_id, part, count(*) AS questions FROM questions GROUP BY 1, 2) q ON t.subject_id = q.subject_id AND t.part = q.part",
    ),
    "a19_chart_rows": (
        lambda t: A.module_distribution(t.questions, t.modules).select("subject_id", F.when(F.col("module_number") == 0, "Unclassified").otherwise(F.concat(F.lit("Module "), F.col("module_number").cast("string"), F.lit(": "), F.col("module_name"))).alias("label"), "count"),
        "SELECT m.subject_id, 'Module ' || CAST(m.module_number AS VARCHAR) || ': ' || module_name AS label, count(q.paper_id) AS count FROM modules m LEFT JOIN questions q ON m.subject_id = q.subject_id AND m.module_number = q.module_number GROUP BY 1, 2",
    ),
    "a25_priority_list": (
        _priority,
        "SELECT topic_id, rank, substr(t, 1, 20) || CASE WHEN length(t) > 20 THEN '…' ELSE '' END AS topic, year_count, years, " + Q.TIER.format("year_count") + " AS tier FROM (SELECT topic_id, count(DISTINCT exam_year) AS year_count, string_agg(DISTINCT exam_year, ', ' ORDER BY exam_year) AS years, arg_max(qtext, (length(qtext), qtext)) AS t, row_number() OVER (ORDER BY count(DISTINCT exam_year) DESC, min(exam_year), topic_id) AS rank FROM questions GROUP BY 1) WHERE rank <= 25",
    ),
    "a28_recent_first": (
        lambda t: t.papers.groupBy(F.concat_ws(" ", "exam_type", "exam_year").alias("session")).agg(F.count(F.lit(1)).alias("papers")).withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.element_at(F.split("session", " "), -1).try_cast("int")), "session"))),
        "SELECT session, papers, row_number() OVER (ORDER BY CAST(string_split(session, ' ')[-1] AS INT) DESC, session) AS position FROM (SELECT exam_type || ' ' || exam_year AS session, count(*) AS papers FROM papers GROUP BY 1)",
    ),
    "a29_topics_by_tier": (
        lambda t: Q._topics(t).groupBy("subject_id", "priority_tier").agg(F.array_join(F.array_sort(F.collect_set("topic_name")), ",").alias("topics")),
        f"WITH {Q.TOPICS} SELECT subject_id, priority_tier, string_agg(DISTINCT topic_name, ',' ORDER BY topic_name) AS topics FROM topics GROUP BY 1, 2",
    ),
    "a35_module_percent": (
        lambda t: A.module_distribution(t.questions, t.modules).withColumn("percent", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy("subject_id")), 1)).select("subject_id", "module_number", "percent"),
        "SELECT subject_id, module_number, round(c * 100.0::DOUBLE / sum(c) OVER (PARTITION BY subject_id), 1) AS percent FROM (SELECT m.subject_id, m.module_number, count(q.paper_id) AS c FROM modules m LEFT JOIN questions q ON m.subject_id = q.subject_id AND m.module_number = q.module_number GROUP BY 1, 2)",
    ),
    "o02_session_order": (
        lambda t: t.papers.join(F.broadcast(A.literal_rows(t.spark, "exam_type", _SESSION_ORDER)), "exam_type", "left").withColumn("n", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.coalesce("position", F.lit(999)), "exam_type", "paper_id"))).select("paper_id", "n"),
        "SELECT paper_id, row_number() OVER (PARTITION BY owner_id ORDER BY CASE exam_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_SESSION_ORDER)) + " ELSE 999 END, exam_type, paper_id) AS n FROM papers",
    ),
    "c04_semantic_module": (
        lambda t: V.best_match(t.embeddings, _units(t), "vec_id", "embedding", "unit", "unit_vector", 0.1).select("vec_id", F.col("target").alias("unit"), F.round("score", 6).alias("score")),
        f"WITH s AS (SELECT x.vec_id, y.vec_id AS unit, {Q._COS} AS score FROM embeddings x CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < {_MODULE_VECTORS}) y), b AS (SELECT vec_id, unit, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, unit) AS r FROM s) SELECT vec_id, CASE WHEN score >= 0.1 THEN unit END AS unit, CASE WHEN score >= 0.1 THEN round(score, 6) END AS score FROM b WHERE r = 1",
    ),
    "k08_refined": (
        _refined,
        f"WITH {_REP} SELECT x.vec_id, CASE WHEN {Q._COS} >= 0.2 OR x.vec_id = r.vec_id THEN CAST(x.label AS BIGINT) ELSE -x.vec_id - 1 END AS cluster FROM embeddings x JOIN rep r ON x.label = r.label JOIN embeddings y ON y.vec_id = r.vec_id",
    ),
    "k09_all_clusters": (lambda t: K.linkage_clusters(t.embeddings, 0.75, "vec_id", "embedding", ("label",), least=1), None),
    "v15_pairwise_floor": (lambda t: K.pairwise_floor(K.linkage_clusters(t.embeddings, 0.75, "vec_id", "embedding", ("label",)).select("vec_id", "cluster"), t.embeddings, "vec_id", "embedding", 0.25), None),
    "v03_token_pairs": (
        lambda t: V.token_links(t.part.select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ").alias("ts")), "p_partkey", "ts", 0.8).select("a", "b", F.round("score", 6).alias("score")),
        "WITH s AS (SELECT p_partkey AS k, list_sort(list_distinct(string_split(concat_ws(' ', p_name, p_brand, p_type), ' '))) AS ts FROM part), c AS (SELECT ts, min(k) AS k FROM s GROUP BY ts) "
        "SELECT c.k AS a, s.k AS b, 1.0::DOUBLE AS score FROM s JOIN c ON s.ts = c.ts WHERE s.k <> c.k UNION ALL "
        "SELECT a, b, round(score, 6) AS score FROM (SELECT x.k AS a, y.k AS b, len(list_intersect(x.ts, y.ts))::DOUBLE / len(list_distinct(x.ts || y.ts)) AS score FROM c x JOIN c y ON x.k < y.k) WHERE score >= 0.8",
    ),
}
