"""Queries for the remaining operators: joins, filters, sets, orders, decisions and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradloom.functions import classify as C
from gradloom.functions import text as T
from gradloom.functions import vectors as X
from gradloom.operators import clusters as K
from gradloom.operators import ingest as I
from gradloom.operators import plugins
from gradloom.operators import stats as A
from gradloom.operators.segment import segment, split_pages
from gradloom.plans import duck as D
from gradloom.plans import relational_queries as Q
from gradloom.plans.exam import Tables

_KEY = ("paper_id", "question_no", "topic_id", "supplier_id", "marks")
_K = ", ".join(_KEY)
_QK = ", ".join(f"q.{k}" for k in _KEY)


def _w(*by, order):
    return Window.partitionBy(*by).orderBy(*order)


def _unit_scores(t: Tables):
    units = t.embeddings.where("vec_id < 5").select(F.col("vec_id").alias("unit"), F.col("embedding").alias("u"))
    return t.embeddings.select("vec_id", "embedding").join(F.broadcast(units)).select("vec_id", "unit", F.round(X.cosine(F.col("embedding"), F.col("u")), 6).alias("score"))  # five fixed rows


def _fresh_modules(t: Tables):
    return t.modules.select("subject_id", "module_number", "module_name")


def _kmeans(t: Tables):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=5, seed=42).fit(data).transform(data).select("vec_id", "prediction")


def _isolated(t: Tables):
    found = K.linkage_clusters(t.embeddings, 0.75, "vec_id", "embedding", ("label",), least=1)
    mixed = K.mixed_clusters(found, "cluster", ("label",)).select("cluster", F.lit(True).alias("is_mixed"))
    return found.join(mixed, "cluster", "left").groupBy("label").agg(F.count(F.lit(1)).alias("questions"), F.count("is_mixed").alias("mixed"))


def _echo(prompt: str) -> str:
    return f"Module {len(prompt) % 5 + 1}"


def _asked(t: Tables):
    rows = t.qlines.select("topic_id", "line")
    answers = plugins.ask(rows, "topic_id", "line", [("echo", _echo)], tries=1)
    return answers.select("topic_id", F.regexp_extract("answer", r"(\d+)", 1).try_cast("int").alias("module_number"), "model")


QUERIES = {
    "s20_status_json": (
        lambda t: A.paper_status(t.papers).select("subject_id", F.to_json(F.struct("pending", "processing", "completed", "failed", "total")).alias("body")),
        "SELECT subject_id, '{\"pending\":' || count(CASE WHEN status = 'pending' THEN 1 END)::VARCHAR || ',\"processing\":' || count(CASE WHEN status = 'processing' THEN 1 END)::VARCHAR || ',\"completed\":' || count(CASE WHEN status = 'completed' THEN 1 END)::VARCHAR || ',\"failed\":0,\"total\":' || count(*)::VARCHAR || '}' AS body FROM papers GROUP BY 1",
    ),
    "s24_memberships": (lambda t: t.questions.select("topic_id", "paper_id").dropDuplicates(), "SELECT DISTINCT topic_id, paper_id FROM questions"),
    "s25_replace_subject": (
        lambda t: t.papers.where("subject_id <> 3").select("paper_id", "subject_id", F.lit("old").alias("run")).unionByName(t.papers.where("subject_id = 3 AND NOT is_deleted").select("paper_id", "subject_id", F.lit("new").alias("run"))),
        "SELECT paper_id, subject_id, 'old' AS run FROM papers WHERE subject_id <> 3 UNION ALL SELECT paper_id, subject_id, 'new' FROM papers WHERE subject_id = 3 AND NOT is_deleted",
    ),
    "s26_page_count": (lambda t: t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("page_count")), "SELECT conv_id, count(*) AS page_count FROM conversations GROUP BY 1"),
    "s28_manual_override": (
        lambda t: t.questions.select(*_KEY, F.coalesce(F.when(F.col("topic_id") % 9 == 0, 1), F.col("module_number")).alias("module_number"), (F.col("topic_id") % 9 == 0).alias("module_manually_set")),
        f"SELECT {_K}, CASE WHEN topic_id % 9 = 0 THEN 1 ELSE module_number END AS module_number, topic_id % 9 = 0 AS module_manually_set FROM questions",
    ),
    "p06_persist": (
        lambda t: segment(t.scans).withColumn("subject_id", F.col("paper_id") % 10).join(_fresh_modules(t).withColumnRenamed("module_number", "module_hint"), ["subject_id", "module_hint"], "left").select("paper_id", "pos", "module_name", F.when(F.col("year_context").isNotNull(), F.array("year_context")).otherwise(F.array().cast("array<string>")).alias("years_appeared")),
        f"SELECT s.paper_id, pos, m.module_name, CASE WHEN year_context IS NULL THEN CAST([] AS VARCHAR[]) ELSE [year_context] END AS years_appeared FROM ({Q.segmented()}) s LEFT JOIN modules m ON m.subject_id = s.paper_id % 10 AND m.module_number = module_hint",
    ),
    "p20_split_pages": (
        lambda t: t.scans.select("paper_id", F.array_join(split_pages(F.col("text"), "\nModule", 3), "|").alias("pages"), F.size(split_pages(F.col("text"), "\nModule", 3)).alias("n")),
        "SELECT paper_id, array_to_string((string_split(text, chr(10) || 'Module') || ['', '', ''])[1:3], '|') AS pages, 3 AS n FROM scans",
    ),
    "c02_staged_module": (
        lambda t: Q._stage1(t).select("topic_id", "form", F.coalesce(F.when(F.col("topic_id") % 4 == 0, 2), F.col("module_number"), F.when(F.col("form") == 5, 5)).alias("module_number")),
        f"SELECT topic_id, form, coalesce(CASE WHEN topic_id % 4 = 0 THEN 2 END, CASE WHEN {Q._TOP1} >= 1 THEN {D.case([(f'{s} = {Q._TOP1}', str(i)) for i, s in enumerate(Q._S1, 1)], 'NULL')} END, CASE WHEN form = 5 THEN 5 END) AS module_number FROM qlines",
    ),
    "c06_model_module": (_asked, "SELECT topic_id, CAST(length(line) % 5 + 1 AS INT) AS module_number, 'echo' AS model FROM qlines"),
    "c08_number_map": (
        lambda t: t.questions.select(*_KEY, F.try_element_at(F.create_map(*[x for n in range(1, 21) for x in (F.lit(n), F.lit((n - 1) % 10 // 2 + 1))]), F.col("marks")).alias("module_map"), F.when(F.col("marks") <= 10, 3).otherwise(14).alias("default_marks")),
        f"SELECT {_K}, CASE WHEN marks BETWEEN 1 AND 20 THEN (marks - 1) % 10 // 2 + 1 END AS module_map, CASE WHEN marks <= 10 THEN 3 ELSE 14 END AS default_marks FROM questions",
    ),
    "c17_kmeans_module": (_kmeans, None),
    "c22_recommendation": (
        lambda t: t.questions.select(*_KEY, A.recommendation(F.col("question_no")).alias("text")),
        f"SELECT {_K}, CASE WHEN question_no >= 4 THEN 'Must learn first' WHEN question_no = 3 THEN 'Strongly prepare' WHEN question_no = 2 THEN 'Prepare next' ELSE 'Optional' END || ' — appeared ' || CAST(question_no AS VARCHAR) || CASE WHEN question_no >= 2 THEN ' times.' ELSE ' time.' END AS text FROM questions",
    ),
    "v04_candidate_pairs": (
        lambda t: Q._pairs(t).select("a", "b", C.zone(F.round(F.col("score") * 2.2, 6)).alias("zone")),
        f"WITH {Q._PAIRS} SELECT a, b, CASE WHEN round(score * 2.2, 6) >= 0.9 THEN 'high' WHEN round(score * 2.2, 6) >= 0.82 THEN 'llm' WHEN round(score * 2.2, 6) >= 0.8 THEN 'dead' ELSE 'reject' END AS zone FROM pairs",
    ),
    "v05_similarity": (
        lambda t: t.embeddings.select("vec_id", F.round(X.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("score")),
        "SELECT x.vec_id, round(list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: x.embedding[i]::DOUBLE * x.embedding[len(x.embedding) + 1 - i]::DOUBLE)) / list_sum(list_transform(x.embedding, lambda e: e::DOUBLE * e::DOUBLE)), 6) AS score FROM embeddings x",
    ),
    "v10_one_to_many": (_unit_scores, f"SELECT x.vec_id, y.vec_id AS unit, round({Q._COS}, 6) AS score FROM embeddings x CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 5) y"),
    "v13_keywords": (
        lambda t: Q._normals(t).select("topic_id", "form", F.array_join(F.array_sort(F.array_distinct(F.filter(F.split("normal", " "), lambda w: (F.length(w) > 3) & ~w.isin(*T.NOT_KEYWORDS)))), " ").alias("keywords")),
        f"WITH {Q._NORM}, {Q._SETS} SELECT topic_id, form, coalesce(array_to_string(list_sort(ks), ' '), '') AS keywords FROM sets",
    ),
    "v19_cleaned_text": (
        lambda t: t.qlines.select("topic_id", "form", F.coalesce(plugins.cleaned_text_verdict(F.col("line"), F.substring("line", 1, 25)), F.lit("ok")).alias("verdict")),
        "SELECT topic_id, form, CASE WHEN length(trim(substr(line, 1, 25))) < 10 THEN 'too short' WHEN length(substr(line, 1, 25)) / length(line) < 0.5 THEN 'length deviation' ELSE 'ok' END AS verdict FROM qlines",
    ),
    "v20_module_range": (lambda t: t.questions.select(*_KEY, F.col("marks").between(1, 5).alias("valid")), f"SELECT {_K}, marks BETWEEN 1 AND 5 AS valid FROM questions"),
    "v21_missing_embeddings": (lambda t: plugins.missing_embeddings(t.documents.select(F.col("doc_id").alias("vec_id")), t.embeddings, "vec_id"), "SELECT doc_id AS vec_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
    "v22_similar_to_one": (
        lambda t: Q._pairs(t, 0.25).where("a = 7 OR b = 7").select(F.when(F.col("a") == 7, F.col("b")).otherwise(F.col("a")).alias("vec_id"), F.round("score", 6).alias("score")),
        f"WITH {Q._PAIRS.replace('>= 0.3)', '>= 0.25)')} SELECT CASE WHEN a = 7 THEN b ELSE a END AS vec_id, round(score, 6) AS score FROM pairs WHERE a = 7 OR b = 7",
    ),
    "k01_two_passes": (
        lambda t: K.linkage_clusters(t.embeddings, 0.68, "vec_id", "embedding", ("label",)).withColumn("cluster_type", F.lit("strict_repetition")).unionByName(K.linkage_clusters(t.embeddings, 0.75, "vec_id", "embedding", ("label",)).withColumn("cluster_type", F.lit("concept_similarity"))),
        None,
    ),
    "k02_isolation": (
        # clusters of all vectors, made label by label: rows whose cluster holds rows of several labels
        lambda t: _isolated(t),
        "SELECT label, count(*) AS questions, CAST(0 AS BIGINT) AS mixed FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1",
    ),
    "k02_mixed_topics": (
        # topics as clusters, in which parts and years may mix: those that the guard refuses
        lambda t: K.mixed_clusters(t.questions, "topic_id", ("part", "exam_year")),
        "SELECT topic_id, count(DISTINCT part || exam_year) AS buckets FROM questions GROUP BY 1 HAVING count(DISTINCT part || exam_year) > 1",
    ),
    "k11_kmeans": (lambda t: _kmeans(t).groupBy("prediction").agg(F.count(F.lit(1)).alias("n")), None),
    "a08_topics_of_tiers": (
        lambda t: A.dense(Q._topics(t).groupBy("subject_id", C.tier_label(F.col("priority_tier")).alias("tier_label")).agg(F.count(F.lit(1)).alias("count")), "tier_label", list(C.TIER_LABELS.values())),
        f"WITH {Q.TOPICS} SELECT s.subject_id, l.tier_label, count(t.topic_name) AS count FROM (SELECT DISTINCT subject_id FROM topics) s CROSS JOIN (SELECT unnest(['Top Priority', 'High Priority', 'Medium Priority', 'Low Priority']) AS tier_label) l LEFT JOIN topics t ON t.subject_id = s.subject_id AND {Q.LABEL.format('t.priority_tier')} = l.tier_label GROUP BY 1, 2",
    ),
    "a18_module_tiers": (
        lambda t: A.tier_counts(A.topic_clusters(t.questions, ("module_number", "topic_name")), ("module_number",)),
        "SELECT module_number, " + ", ".join(f"count(CASE WHEN tier = {i} THEN 1 END) AS tier_{i}" for i in (1, 2, 3, 4)) + f", count(*) AS topics FROM (SELECT module_number, topic_name, {Q.TIER.format('count(DISTINCT exam_year)')} AS tier FROM questions GROUP BY 1, 2) GROUP BY 1",
    ),
    "a26_ranked_clusters": (
        lambda t: Q._topics(t).withColumn("rank", F.row_number().over(_w("subject_id", order=(F.desc("frequency"), "topic_name", "part")))).select("subject_id", "topic_name", "part", "rank", F.when((F.col("priority_tier") == 1) | (F.col("frequency") >= 4), "top").otherwise("other").alias("band")),
        f"WITH {Q.TOPICS} SELECT subject_id, topic_name, part, row_number() OVER (PARTITION BY subject_id ORDER BY frequency DESC, topic_name, part) AS rank, CASE WHEN priority_tier = 1 OR frequency >= 4 THEN 'top' ELSE 'other' END AS band FROM topics",
    ),
    "a34_module_report": (
        lambda t: t.questions.select("module_number", "exam_year", *_KEY, F.substring("qtext", 1, 200).alias("question")).orderBy("module_number", "exam_year", *_KEY),
        f"SELECT module_number, exam_year, {_K}, substr(qtext, 1, 200) AS question FROM questions",
    ),
    "a36_continued_ranks": (
        lambda t: Q._study(t).groupBy("subject_id").agg(F.max("rank").alias("last_rank"), F.count(F.lit(1)).alias("listed")),
        f"WITH {Q.TOPICS}, x AS (SELECT subject_id, priority_tier, row_number() OVER (PARTITION BY subject_id, priority_tier ORDER BY frequency DESC, topic_name || ' ' || part) AS r FROM topics) SELECT subject_id, count(*) AS last_rank, count(*) AS listed FROM x WHERE priority_tier < 4 OR r <= 10 GROUP BY 1",
    ),
    "j01_questions_of_papers": (
        lambda t: t.questions.select(*_KEY).join(t.papers.where("status = 'completed'").select("paper_id", "owner_id"), "paper_id"),
        f"SELECT {_QK}, p.owner_id FROM questions q JOIN papers p ON q.paper_id = p.paper_id WHERE p.status = 'completed'",
    ),
    "j02_with_module": (
        lambda t: t.questions.select(*_KEY, "subject_id", (F.col("module_number") + F.col("topic_id") % 3).cast("int").alias("module_number")).join(_fresh_modules(t), ["subject_id", "module_number"], "left"),
        f"SELECT {_QK}, q.subject_id, q.module_number, m.module_name FROM (SELECT {_K}, subject_id, CAST(module_number + topic_id % 3 AS INT) AS module_number FROM questions) q LEFT JOIN modules m ON q.subject_id = m.subject_id AND q.module_number = m.module_number",
    ),
    "j04_prefetch": (
        lambda t: t.questions.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("marks")), ",").alias("marks")).join(t.papers.select("paper_id", "exam_year"), "paper_id", "right"),
        "SELECT p.paper_id, p.exam_year, q.marks FROM papers p LEFT JOIN (SELECT paper_id, string_agg(CAST(marks AS VARCHAR), ',' ORDER BY marks) AS marks FROM questions GROUP BY 1) q ON p.paper_id = q.paper_id",
    ),
    "j08_delete_by_ids": (lambda t: t.papers.join(t.papers.where("status = 'processing'").select("subject_id", "owner_id").distinct(), ["subject_id", "owner_id"], "left_anti").select("paper_id"), "SELECT paper_id FROM papers p WHERE NOT EXISTS (SELECT 1 FROM papers x WHERE x.status = 'processing' AND x.subject_id = p.subject_id AND x.owner_id = p.owner_id)"),
    "j10_module_scores": (
        lambda t: t.questions.select("subject_id", "topic_name").distinct().join(_fresh_modules(t), "subject_id").select("subject_id", "topic_name", "module_number", F.col("topic_name").contains(F.substring("module_name", 2, 1)).alias("hit")),
        "SELECT q.subject_id, q.topic_name, m.module_number, contains(q.topic_name, substr(m.module_name, 2, 1)) AS hit FROM (SELECT DISTINCT subject_id, topic_name FROM questions) q JOIN modules m ON q.subject_id = m.subject_id",
    ),
    "j12_best_unit": (
        lambda t: _unit_scores(t).groupBy("vec_id").agg(F.max(F.struct("score", (-F.col("unit")).alias("o"), "unit")).alias("m")).select("vec_id", "m.unit"),
        f"SELECT vec_id, unit FROM (SELECT x.vec_id, y.vec_id AS unit, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({Q._COS}, 6) DESC, y.vec_id) AS r FROM embeddings x CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 5) y) WHERE r = 1",
    ),
    "j15_full_outer": (
        lambda t: t.documents.select("doc_id", "lang").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "full").join(t.labels.select("doc_id", "quality"), "doc_id", "full"),
        "SELECT coalesce(d.doc_id, vec_id, l.doc_id) AS doc_id, lang, label, quality FROM documents d FULL JOIN embeddings ON doc_id = vec_id FULL JOIN labels l ON l.doc_id = coalesce(d.doc_id, vec_id)",
    ),
    "f03_optional_filter": (lambda t: t.papers.where("subject_id = 4"), "SELECT * FROM papers WHERE subject_id = 4"),
    "f04_not_empty": (lambda t: t.qlines.where(F.trim(F.regexp_replace("line", "[^0-9]", "")) != ""), "SELECT * FROM qlines WHERE regexp_replace(line, '[^0-9]', '', 'g') <> ''"),
    "f05_is_null": (lambda t: t.questions.select(*_KEY, F.nullif("module_number", F.lit(3)).alias("m")).where("m IS NULL").drop("m"), f"SELECT {_K} FROM questions WHERE nullif(module_number, 3) IS NULL"),
    "f06_enum": (lambda t: t.papers.where("status IN ('pending', 'processing')"), "SELECT * FROM papers WHERE status IN ('pending', 'processing')"),
    "f07_has_topics": (lambda t: t.qlines.select("topic_id", "form", F.split("line", ",").alias("p")).where("size(p) > 1").select("topic_id", "form"), "SELECT topic_id, form FROM qlines WHERE len(string_split(line, ',')) > 1"),
    "f09_no_junk": (lambda t: t.qlines.where(~T.is_junk(F.col("line")) & (F.length("line") >= 8)).select("topic_id", "form"), f"SELECT topic_id, form FROM qlines WHERE NOT (length({D.strip('line')}) < 8 OR " + " OR ".join(D.has("line", p) for p in T.JUNK) + ") AND length(line) >= 8"),
    "f11_values": (lambda t: t.papers.select("paper_id", "exam_year").where("exam_year = '1996'"), "SELECT paper_id, exam_year FROM papers WHERE exam_year = '1996'"),
    "f13_search": (lambda t: t.papers.where(F.lower("exam_type").contains("high") | F.col("exam_year").contains("99")).select("paper_id"), "SELECT paper_id FROM papers WHERE contains(lower(exam_type), 'high') OR contains(exam_year, '99')"),
    "f14_display_name": (
        lambda t: t.customer.select("c_custkey", F.coalesce(F.nullif(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(""), F.lit("")), F.nullif(F.when(F.col("c_custkey") % 3 == 1, F.lower("c_name")).otherwise(""), F.lit("")), F.split_part(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@x.org")), F.lit("@"), F.lit(1))).alias("name")),
        "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END, ''), nullif(CASE WHEN c_custkey % 3 = 1 THEN lower(c_name) ELSE '' END, ''), split_part('user' || CAST(c_custkey AS VARCHAR) || '@x.org', '@', 1)) AS name FROM customer",
    ),
    "w01_rank": (lambda t: t.supplier.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("rank")), "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier"),
    "w02_top_n": (lambda t: t.orders.withColumn("r", F.row_number().over(_w("o_custkey", order=(F.desc("o_totalprice"), "o_orderkey")))).where("r <= 2").select("o_custkey", "o_orderkey", "r"), "SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2"),
    "w03_first_per_key": (lambda t: I.first_wins(t.papers, ("owner_id",), ("paper_id",)).select("owner_id", "paper_id"), "SELECT owner_id, min(paper_id) AS paper_id FROM papers GROUP BY 1"),
    "w06_lag_frames": (
        lambda t: t.orders.select("o_orderkey", F.lag("o_orderkey").over(_w("o_custkey", order=("o_orderkey",))).alias("before"), F.sum("o_custkey").over(_w("o_custkey", order=("o_orderkey",)).rowsBetween(-2, 0)).alias("last_three")),
        "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, CAST(sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_three FROM orders",
    ),
    "o01_multi_key_sort": (
        lambda t: t.papers.withColumn("n", F.row_number().over(_w("subject_id", order=(F.desc("exam_year"), F.asc_nulls_first("exam_type"), "paper_id")))).select("paper_id", "n"),
        "SELECT paper_id, row_number() OVER (PARTITION BY subject_id ORDER BY exam_year DESC, exam_type ASC NULLS FIRST, paper_id) AS n FROM papers",
    ),
    "o03_sorted_years": (lambda t: t.papers.groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_set("exam_year")), ",").alias("years")), "SELECT owner_id, string_agg(DISTINCT exam_year, ',' ORDER BY exam_year) AS years FROM papers GROUP BY 1"),
    "o04_top_k": (lambda t: t.questions.groupBy("topic_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic_name").limit(20), "SELECT topic_name, count(*) AS n FROM questions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "o06_first_of_group": (lambda t: t.papers.groupBy("subject_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("paper_id")), 1, 5).cast("array<string>"), ",").alias("sample")), "SELECT subject_id, array_to_string(list_sort(list(paper_id))[1:5], ',') AS sample FROM papers GROUP BY 1"),
    "u02_distinct_years": (lambda t: t.papers.select("exam_year").distinct(), "SELECT DISTINCT exam_year FROM papers"),
    "u03_token_sets": (
        lambda t: Q._self(t).select("topic_id", "form", "form_b", F.size(F.array_intersect("ts", "ts_b")).alias("both"), F.size(F.array_union("ts", "ts_b")).alias("any")),
        f"WITH {Q._NORM}, {Q._SETS} SELECT x.topic_id, x.form, y.form AS form_b, CAST(len(list_intersect(x.ts, y.ts)) AS INT) AS both, CAST(len(list_distinct(x.ts || y.ts)) AS INT) AS any FROM sets x JOIN sets y ON x.topic_id = y.topic_id AND x.form < y.form",
    ),
    "u05_intersect": (lambda t: t.papers.select("owner_id").intersect(t.papers.where("status = 'processing'").select("owner_id")), "SELECT owner_id FROM papers INTERSECT SELECT owner_id FROM papers WHERE status = 'processing'"),
    "st05_incremental": (lambda t: plugins.encode_missing(t.documents, t.labels, "doc_id", "text").select("doc_id", F.size("embedding").alias("dims")), "SELECT doc_id, 384 AS dims FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
}
