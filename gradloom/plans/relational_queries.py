"""Queries for ingest, statistics, joins, windows, similarity and clustering, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradloom.functions import classify as C
from gradloom.functions import text as T
from gradloom.functions.vectors import alike, jaccard, keyword_similarity
from gradloom.operators import clusters as K
from gradloom.operators import ingest as I
from gradloom.operators import similarity as V
from gradloom.operators import stats as A
from gradloom.operators.graph import components
from gradloom.operators import extract as X
from gradloom.operators import plugins, rules
from gradloom.operators.segment import segment
from gradloom.streaming.ingest import rate_limited_batch, session_counts
from gradloom.plans import duck as D
from gradloom.plans import text_queries as Q
from gradloom.plans.exam import Tables

TIER = "CASE WHEN {0} >= 4 THEN 1 WHEN {0} >= 3 THEN 2 WHEN {0} >= 2 THEN 3 ELSE 4 END"
LABEL = "CASE {0} WHEN 1 THEN 'Top Priority' WHEN 2 THEN 'High Priority' WHEN 3 THEN 'Medium Priority' ELSE 'Low Priority' END"
LEVELS = ("remember", "understand", "apply", "analyze", "evaluate", "create")
SESSIONS = ("1-URGENT", "2-HIGH", "3-MEDIUM")
_BY = ("subject_id", "topic_name", "part")
TOPICS = f"""topics AS (SELECT subject_id, topic_name, part, count(DISTINCT exam_year) AS frequency, sum(marks) AS total_marks, count(*) AS question_count,
    count(CASE WHEN part = 'A' THEN 1 END) AS part_a_count, count(CASE WHEN part = 'B' THEN 1 END) AS part_b_count, string_agg(DISTINCT exam_year, ',' ORDER BY exam_year) AS years,
    {TIER.format('count(DISTINCT exam_year)')} AS priority_tier FROM questions GROUP BY ALL)"""


def _topics(t: Tables):
    return A.topic_clusters(t.questions, _BY)


def _modules(t: Tables):
    return t.modules


def _pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE round({a} * 100.0::DOUBLE / {b}, 1) END"


_COS = "list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: x.embedding[i]::DOUBLE * y.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(x.embedding, lambda e: e::DOUBLE * e::DOUBLE)) * list_sum(list_transform(y.embedding, lambda e: e::DOUBLE * e::DOUBLE)))"
_PAIRS = f"pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, {_COS} AS score FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE {_COS} >= 0.3)"


def _pairs(t: Tables, at: float = 0.3):
    return V.similar_pairs(t.embeddings, at, "vec_id", "embedding", ("label",))


_FILE = "p_name || CASE p_partkey % 6 WHEN 0 THEN ' Dec 2022.pdf' WHEN 1 THEN '_june_2023.pdf' WHEN 2 THEN ' summary.PDF' WHEN 3 THEN '-2019-.pdf' WHEN 4 THEN ' May, 2024 .pdf' ELSE '.txt' END"
_SIZE = "p_partkey * 300000 % 60000000"
_MAGIC = "CASE WHEN p_partkey % 11 = 0 THEN '<html' ELSE '%PDF-' END"
_STEM = f"regexp_replace({_FILE}, '\\.[^.]*\\z', '')"
_YEAR = f"nullif(regexp_extract({_STEM}, '(20\\d{{2}})', 1), '')"


def _month_sql() -> str:
    return D.case([(f"contains(lower({_STEM}), '{k}')", f"'{T.MONTHS[i]}'") for k, i in I.MONTH_KEYS], "NULL")


def _title_sql() -> str:
    x = f"CASE WHEN {_YEAR} IS NULL THEN {_STEM} ELSE {D.strip(f'replace({_STEM}, {_YEAR}, chr(1))')} END"
    x = D.strip(f"replace({x}, chr(1), '')")
    for k, _ in I.MONTH_KEYS:
        x = f"regexp_replace({x}, '(?i)\\b{k}\\b', '', 'g')"
    x = f"regexp_replace({x}, '[,_\\-]+\\s*\\z', '', 'g')"
    return D.strip(f"regexp_replace({D.strip(x)}, '\\s+', ' ', 'g')")


def _files(t: Tables):
    title, year, kind = I.parse_filename(F.expr(_FILE))
    return t.part.select("p_partkey", title.alias("title"), year.alias("year"), kind.alias("exam_type"))


def _stage1(t: Tables):
    """Keyword score of each question line against the modules of five brands."""
    low = F.lower("line")
    scores = []
    for m in range(1, 6):
        s = F.when(low.contains(_KEYWORDS[m - 1][0]), 3).otherwise(0) + F.when(low.contains(_KEYWORDS[m - 1][1]), 2).otherwise(0)
        scores.append(F.struct(s.alias("score"), F.lit(-m).alias("order")))
    best = F.array_max(F.array(*scores))
    return t.qlines.select("topic_id", "form", F.when(best["score"] >= 1, -best["order"]).alias("module_number"), best["score"].alias("score"))


_KEYWORDS = (("steel", "brush"), ("large", "anodized"), ("economy", "copper"), ("planning", "green"), ("diagram", "identify"))
_S1 = [f"CASE WHEN contains(lower(line), '{a}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(line), '{b}') THEN 2 ELSE 0 END" for a, b in _KEYWORDS]
_TOP1 = f"greatest({', '.join(_S1)})"

_NORM = "normals AS (SELECT topic_id, form, " + Q._topic_key("line") + " AS normal FROM qlines)"


def _normals(t: Tables):
    return t.qlines.select("topic_id", "form", T.topic_key(F.col("line")).alias("normal"))


_GRAMS = """grams AS (SELECT topic_id % 3 AS g, unnest(flatten([[array_to_string(ws[i:i + n - 1], ' ') for i in range(1, len(ws) - n + 2)] for n in [2, 3, 4]])) AS term
    FROM (SELECT topic_id, list_filter(string_split(normal, ' '), lambda w: length(w) > 2) AS ws FROM normals)),
terms AS (SELECT * FROM (SELECT g, term, count(*) AS n, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, length(term) DESC, term) AS rank FROM grams GROUP BY g, term HAVING count(*) >= 2) WHERE rank <= 80)"""


def _terms(t: Tables):
    return K.key_terms(_normals(t).withColumn("g", F.col("topic_id") % 3), ("g",), "normal")


def _phrases(t: Tables):
    rows = _normals(t).withColumn("g", F.col("topic_id") % 3)
    return K.topic_phrases(rows, K.key_terms(rows, ("g",), "normal"), ("g",), ("topic_id", "form"), "normal")


_PHRASES = f"""phrases AS (SELECT topic_id, form, g, {Q._edges("coalesce(hit, first5)")} AS phrase FROM (SELECT n.topic_id, n.form, n.topic_id % 3 AS g, array_to_string(string_split(n.normal, ' ')[1:5], ' ') AS first5,
    (SELECT arg_min(t.term, t.rank) FROM terms t WHERE t.g = n.topic_id % 3 AND contains(n.normal, t.term)) AS hit FROM normals n))"""

_SETS = "sets AS (SELECT topic_id, form, list_distinct(list_filter(string_split(normal, ' '), lambda w: length(w) > 3 AND w NOT IN (" + ", ".join(map(D.q, T.NOT_KEYWORDS)) + "))) AS ks, list_distinct(string_split(normal, ' ')) AS ts, normal FROM normals)"


def _self(t: Tables):
    """Every two line forms of a topic. A topic has as many as there are forms, so they are put together in its row: what is made of a line is made once."""
    rows = _normals(t).select("topic_id", "form", "normal", F.array_distinct(F.filter(F.split("normal", " "), lambda w: (F.length(w) > 3) & ~w.isin(*T.NOT_KEYWORDS))).alias("ks"), F.array_distinct(F.split("normal", " ")).alias("ts"))
    all_ = rows.groupBy("topic_id").agg(F.collect_list(F.struct("form", "normal", "ks", "ts")).alias("all"))
    each = all_.select("topic_id", "all", F.explode("all").alias("x")).select("topic_id", "x", F.explode(F.filter("all", lambda y: F.col("x.form") < y["form"])).alias("y"))
    return each.select("topic_id", "x.*", *[F.col(f"y.{c}").alias(f"{c}_b") for c in ("form", "normal", "ks", "ts")])


def _self_sets(t: Tables):
    """The keywords of every line form of a topic."""
    return _normals(t).select("topic_id", "form", F.array_distinct(F.filter(F.split("normal", " "), lambda w: (F.length(w) > 3) & ~w.isin(*T.NOT_KEYWORDS))).alias("ks"))


def _clusters(t: Tables):
    """Cluster groups of all topics, every third a concept cluster."""
    g = A.cluster_groups(t.questions, ("subject_id", "topic_id"))
    return g.withColumn("cluster_type", F.when(F.col("topic_id") % 3 == 0, "concept_similarity").otherwise("strict_repetition")).withColumn("cluster_id", F.concat_ws("-", F.col("subject_id").cast("string"), F.col("topic_id").cast("string")))


_GROUPS = "groups AS (SELECT subject_id, topic_id, coalesce(nullif(count(DISTINCT exam_year), 0), count(*)) AS frequency, count(*) AS question_count, substr(min(qtext), 1, 500) AS representative, CASE WHEN topic_id % 3 = 0 THEN 'concept_similarity' ELSE 'strict_repetition' END AS cluster_type, concat_ws('-', CAST(subject_id AS VARCHAR), CAST(topic_id AS VARCHAR)) AS cluster_id FROM questions GROUP BY ALL)"

_RULES = (("long", "length(question_text) > 40"), ("diagram", "contains(lower(question_text), 'diagram')"), ("heavy", "marks > 40"), ("unknown", "CAST(NULL AS BOOLEAN)"))


def _ruled(t: Tables):
    live = [rules.Rule(n, e, is_validated=rules.validate(t.spark, e) is None) for n, e in _RULES]
    q = t.qlines.select("topic_id", "form", F.col("line").alias("question_text"), F.array().cast("array<string>").alias("keywords"), (F.col("topic_id") % 50).cast("int").alias("marks"))
    return rules.execute_all(q, live).select("topic_id", "form", *[F.try_element_at("results", F.lit(n)).alias(n) for n, _ in _RULES], F.size("results").alias("n_results"))


_REPLY = "CASE form WHEN 0 THEN 'Same: YES Confidence: 85 Reason: x' WHEN 1 THEN 'same : no / confidence: 0.4' WHEN 2 THEN 'nothing' WHEN 3 THEN 'Same: yes Confidence: 250' ELSE line END"


def _uploads(t: Tables):
    return t.events.select(F.col("user_id").alias("address"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))


_NUM = D.q(X.NUMBERED)
_KEPT = " AND ".join(["length(l) > 0", *(f"NOT {D.has('l', h)}" for h in X.HEADERS)])


def _listed(pattern: str, *groups: int) -> str:
    return ", ".join(f"regexp_extract_all(text, {D.q(pattern)}, {g})[i] AS g{k}" for k, g in enumerate(groups, 1))


def _each(pattern: str, *groups: int, view: str = "scans") -> str:
    """All matches of a pattern as rows paper_id, pos, g1, ..."""
    return f"SELECT paper_id, CAST(i - 1 AS INT) AS pos, {_listed(pattern, *groups)} FROM {view}, UNNEST(range(1, len(regexp_extract_all(text, {D.q(pattern)})) + 1)) AS u(i)"


def read_by_lines(else_: str) -> str:
    """The four questions that begin with a number and a capital in each paper of ``scans``, from the columns that it was made of;
    ``else_`` is what follows in papers without a date."""
    name, kind, date = "p_name", "p_type", f"CASE WHEN p_partkey % 2 = 0 THEN ' December 2022' ELSE '' {else_} END"
    found = (
        (0, "1", f"'Deﬁne ' || {name} || ' (3 marks) - ' || p_size || ' -'", 3, "A"), (1, "11", f"'Discuss requ manage ment of ' || {name} || ' (a) de fi ne hazard [' || p_size || ' marks] turn over' || {date}", 7, "B"),
        (2, "12", "'Plan ning – (Dec 2022, 7 marks)'", 7, "B"), (3, "13b", f"'Explain the hazards of ' || {kind} || ' in coastal regions'", 8, "B"),
    )
    return " UNION ALL ".join(f"SELECT p_partkey AS paper_id, {pos} AS pos, '{n}' AS question_number, {text} AS text, {marks} AS marks, '{part}' AS part, CAST(NULL AS INT) AS module_hint FROM part" for pos, n, text, marks, part in found)


def segmented() -> str:
    """The questions of each paper of ``scans`` from the columns that it was made of: only its third way to write Part B is read as one,
    and what follows a question up to the next number, heading or mark belongs to it."""
    b = "p_partkey % 3 = 2"
    heading = "CASE p_partkey % 3 WHEN 0 THEN ' Part — B Page 2 of 10' WHEN 1 THEN ' ## PART B == Page 2 of 10' ELSE '' END"
    discuss, hazard = "'Discuss requ manage ment of ' || p_name || ' turn over'", "'de fi ne hazard [' || p_size || ' marks]'"
    second = f"'1et the algo rithm ' || p_brand || ' compu ter, ( ii ) “' || p_type || '”' || {heading}"
    part, module, none = f"CASE WHEN {b} THEN 'B' ELSE 'A' END", "CAST(p_size % 5 + 1 AS INT)", "CAST(NULL AS INT)"
    found = (
        (0, "1", "'Deﬁne   ' || p_name", "'Deﬁne   ' || p_name", "'A'", "3", "CAST([] AS VARCHAR[])", none, "NULL"), (1, "2", second, second, "'A'", "3", "CAST([] AS VARCHAR[])", none, "NULL"),
        (2, "11", discuss, f"{discuss} || ' ' || {hazard}", part, f"CASE WHEN {b} THEN 14 ELSE 3 END", f"[{hazard}]", module, "NULL"), (3, "1", "'12. Plan ning'", "'12. Plan ning'", part, "7", "CAST([] AS VARCHAR[])", module, "'December 2022'"),
    )
    return " UNION ALL ".join(
        f"SELECT p_partkey AS paper_id, {pos} AS pos, '{n}' AS question_number, {text} AS text, {full} AS full_question_text, {p} AS part, {marks} AS marks, {subs} AS sub_questions, {m} AS module_hint, {str(pos > 1).lower()} AS module_hint_is_explicit, CAST({year} AS VARCHAR) AS year_context, CAST(NULL AS VARCHAR) AS qn_group FROM part"
        for pos, n, text, full, p, marks, subs, m, year in found
    )


def _with_subs(t: Tables):
    """Papers with a number that comes twice, of which the first has two sub-questions."""
    papers = t.sql("SELECT p_partkey AS paper_id, '11. Discuss ' || p_name || chr(10) || '11 a) Define ' || p_type || ' (4 marks)' || chr(10) || '11b. Compare ' || p_brand || chr(10) || '12. Derive ' || p_type || ' (10 marks)' || chr(10) || '11. Again ' || p_name AS text FROM part", costly=True)
    subs = F.array_join(F.transform("sub_questions", lambda s: F.concat(s["letter"], F.lit(": "), s["text"], F.lit(" = "), s["marks"])), "; ")
    return X.with_subs(papers, X.numbered(papers, 11, 20, 14, "B")).select("paper_id", "pos", "question_number", "text", "marks", subs.alias("subs"))


def leaders_sql(rows: str, alike: str, bucket: str, key: str) -> str:
    """Greedy leaders, row after row: a row goes to the first leader so far that it is like, else leads."""
    return f"""WITH RECURSIVE {rows}, r AS (SELECT bucket, id, k, id AS leader, [struct_pack(i := id, v := v)] AS leaders FROM s WHERE k = 1 UNION ALL
SELECT bucket, id, k, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(leaders, struct_pack(i := id, v := v)) ELSE leaders END
FROM (SELECT s.bucket, s.id, s.v, s.k, r.leaders, list_filter(r.leaders, lambda l: {alike})[1].i AS hit FROM r JOIN s ON s.bucket = r.bucket AND s.k = r.k + 1))
SELECT bucket AS {bucket}, id AS {key}, leader FROM r"""


QUERIES = {
    "t11_clean_extracted": (lambda t: t.scans.select("paper_id", T.clean_extracted(F.col("text")).alias("out")), f"SELECT paper_id, {D.rewrite('text', T.EXTRACTION)} AS out FROM scans"),
    "t12_drop_headers": (
        lambda t: t.scans.select("paper_id", X.drop_headers(F.col("text")).alias("out")),
        f"SELECT paper_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {D.strip('l')}), lambda l: {_KEPT}), chr(10)) AS out FROM scans",
    ),
    "t37_exam_info": (
        lambda t: t.scans.select("paper_id", *[c.alias(n) for n, c in zip(("month", "year"), T.exam_info(F.lit("Paper"), F.col("text")), strict=True)]),
        f"SELECT paper_id, CASE WHEN m <> '' THEN upper(substr(m, 1, 1)) || lower(substr(m, 2)) END AS month, nullif(y, '') AS year FROM (SELECT paper_id, regexp_extract('Paper ' || substr(text, 1, 500), {D.q(T.EXAM_MONTH)}, 1) AS m, regexp_extract('Paper ' || substr(text, 1, 500), {D.q(T.EXAM_YEAR)}, 1) AS y FROM scans)",
    ),
    "p07_extract_questions": (lambda t: X.extract_questions(t.scans), read_by_lines('')),
    "p08_part_a": (lambda t: X.part_a(t.scans), None),
    "p09_part_b": (lambda t: X.part_b(t.scans), "SELECT p_partkey AS paper_id, 100 AS pos, '13b' AS question_number, 'Explain the hazards of ' || p_type || ' in coastal regions' AS text, 7 AS marks, 'B' AS part, CAST(p_size % 5 + 1 AS INT) AS module_hint FROM part"),
    "p10_by_lines": (lambda t: X.by_lines(t.scans), read_by_lines(" || ' Max marks: 100'")),
    "p11_deduplicated": (
        lambda t: X.deduplicated(t.questions.select("paper_id", F.col("question_no").cast("string").alias("question_number"), F.col("qtext").alias("text"), F.struct("topic_id", "supplier_id", "marks").alias("pos"))).select("paper_id", "question_number", "text"),
        "SELECT paper_id, question_number, text FROM (SELECT paper_id, CAST(question_no AS VARCHAR) AS question_number, qtext AS text, row_number() OVER (PARTITION BY paper_id, question_no, trim(lower(substr(qtext, 1, 30))) ORDER BY topic_id, supplier_id, marks) AS r FROM questions WHERE length(qtext) >= 10) WHERE r = 1",
    ),
    "p12_numbered_lines": (
        lambda t: X.numbered(t.scans, 1, 10, 3, "A").unionByName(X.numbered(t.scans, 11, 20, 14, "B")),
        f"SELECT paper_id, pos, g1 AS question_number, {D.strip('g2')} AS text, coalesce(TRY_CAST(nullif(g3, '') AS INT), CASE WHEN CAST(g1 AS INT) <= 10 THEN 3 ELSE 14 END) AS marks, CASE WHEN CAST(g1 AS INT) <= 10 THEN 'A' ELSE 'B' END AS part FROM ({_each(X.NUMBERED, 1, 2, 3)}) WHERE TRY_CAST(g1 AS INT) BETWEEN 1 AND 20",
    ),
    "p12_with_subs": (
        lambda t: _with_subs(t),
        "SELECT p_partkey AS paper_id, 0 AS pos, '11' AS question_number, 'Discuss ' || p_name AS text, 14 AS marks, 'a: Define ' || p_type || ' = 4; b: Compare ' || p_brand || ' = 7' AS subs FROM part UNION ALL SELECT p_partkey, 1, '12', 'Derive ' || p_type, 10, NULL FROM part UNION ALL SELECT p_partkey, 2, '11', 'Again ' || p_name, 14, NULL FROM part",
    ),
    "p14_marked_lines": (
        lambda t: X.marked_lines(t.qlines, "line", "topic_id", "form"),
        f"SELECT topic_id, form, CAST(CASE WHEN a THEN regexp_extract(line, {D.q(X.MARKED)}, 1) ELSE regexp_extract(line, {D.q(X.MARKED_SUB)}, 1) END AS INT) AS question_number, CASE WHEN NOT a THEN lower(regexp_extract(line, {D.q(X.MARKED_SUB)}, 2)) END AS sub_part, {D.strip(f'CASE WHEN a THEN regexp_extract(line, {D.q(X.MARKED)}, 2) ELSE regexp_extract(line, {D.q(X.MARKED_SUB)}, 3) END')} AS text, CAST(CASE WHEN a THEN regexp_extract(line, {D.q(X.MARKED)}, 3) ELSE regexp_extract(line, {D.q(X.MARKED_SUB)}, 4) END AS INT) AS marks, CASE WHEN a AND CAST(regexp_extract(line, {D.q(X.MARKED)}, 3) AS INT) <= 3 THEN 'A' ELSE 'B' END AS part FROM (SELECT *, {D.has('line', X.MARKED)} AS a FROM qlines) WHERE a OR {D.has('line', X.MARKED_SUB)}",
    ),
    "p17_first_numbered": (
        lambda t: X.first_numbered(t.scans),
        f"SELECT paper_id, n AS question_number, substr(text, 1, 2000) AS text, CASE WHEN n <= 10 THEN 3 ELSE 14 END AS marks FROM (SELECT paper_id, n, text, row_number() OVER (PARTITION BY paper_id, n ORDER BY pos) AS r FROM (SELECT paper_id, pos, TRY_CAST(g1 AS INT) AS n, {D.strip('g2')} AS text FROM ({_each(X.ANY_NUMBERED, 1, 2)})) WHERE n BETWEEN 1 AND 20 AND length(text) >= 15) WHERE r = 1",
    ),
    "p19_word_chunks": (
        lambda t: t.scans.select("paper_id", F.posexplode(X.word_chunks(F.col("text"), 5)).alias("pos", "chunk")),
        f"SELECT paper_id, CAST(i AS INT) AS pos, array_to_string(w[i * s + 1:CASE WHEN i < 4 THEN i * s + s ELSE len(w) END], ' ') AS chunk FROM (SELECT paper_id, w, len(w) // 5 AS s FROM (SELECT paper_id, {D.words('text')} AS w FROM scans)), UNNEST(range(0, 5)) AS u(i)",
    ),
    "p01_segment": (lambda t: segment(t.scans), segmented()),
    "p01_segment_counts": (
        lambda t: segment(t.scans).groupBy("paper_id").agg(F.count(F.lit(1)).alias("questions"), F.max("module_hint").alias("module")),
        "SELECT paper_id, len(regexp_extract_all(text, '(?m)^\\s*\\d{1,2}\\s*\\.\\s+\\S')) AS questions, TRY_CAST(regexp_extract(text, '(?m)^Module (\\d)$', 1) AS INT) AS module FROM scans",
    ),
    "x04_rules": (
        _ruled,
        "SELECT topic_id, form, length(line) > 40 AS long, contains(lower(line), 'diagram') AS diagram, topic_id % 50 > 40 AS heavy, CAST(NULL AS BOOLEAN) AS unknown, 3 AS n_results FROM qlines",
    ),
    "v18_same_verdict": (
        lambda t: t.qlines.withColumn("reply", F.expr(_REPLY)).select("topic_id", "form", *[c.alias(n) for n, c in zip(("same", "confidence"), plugins.same_verdict(F.col("reply")), strict=True)]),
        f"SELECT topic_id, form, coalesce(upper(regexp_extract(r, '(?i)same\\s*:\\s*(yes|no)', 1)) = 'YES', false) AS same, CAST(coalesce(least(100.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN c <= 1 THEN c * 100 ELSE c END)), 0) AS INT) AS confidence FROM (SELECT topic_id, form, r, TRY_CAST(nullif(regexp_extract(r, '(?i)confidence\\s*:\\s*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS c FROM (SELECT topic_id, form, {_REPLY} AS r FROM qlines))",
    ),
    "v01_encode": (lambda t: plugins.encode(t.qlines.withColumn("id", F.concat_ws("-", F.col("topic_id").cast("string"), F.col("form").cast("string"))), "id", "line"), None),
    "st04_rate_limit": (
        lambda t: rate_limited_batch(_uploads(t)),
        "WITH RECURSIVE u AS (SELECT user_id AS address, event_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events), "
        "r AS (SELECT address, event_id, at_ms, k, true AS accepted, 1 AS n, at_ms + 3600000 AS expires FROM u WHERE k = 1 UNION ALL SELECT u.address, u.event_id, u.at_ms, u.k, u.at_ms >= expires OR n < 5, CASE WHEN u.at_ms >= expires THEN 1 WHEN n < 5 THEN n + 1 ELSE n END, CASE WHEN u.at_ms >= expires OR n < 5 THEN u.at_ms + 3600000 ELSE expires END FROM r JOIN u ON u.address = r.address AND u.k = r.k + 1) "
        "SELECT address, event_id, at_ms, accepted FROM r",
    ),
    "st04_sessions": (
        lambda t: session_counts(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "uploads"),
        "SELECT user_id, min(us) AS start_us, max(us) + 3600000000 AS end_us, count(*) AS uploads FROM (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS s FROM (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
    ),
    "s01_validate_pdf": (
        lambda t: t.part.select("p_partkey", I.validate_pdf(F.expr(_FILE), F.expr(_SIZE), F.expr(_MAGIC)).alias("verdict")),
        f"SELECT p_partkey, CASE WHEN lower({_FILE}) NOT LIKE '%.pdf' THEN 'File must be a .pdf' WHEN {_MAGIC} <> '%PDF-' THEN 'Not a valid PDF header' WHEN {_SIZE} < 1024 THEN 'File too small' WHEN {_SIZE} > 52428800 THEN 'File exceeds 50MB' ELSE 'Valid' END AS verdict FROM part",
    ),
    "s02_parse_filename": (_files, f"SELECT p_partkey, coalesce(nullif({_title_sql()}, ''), {_FILE}) AS title, {_YEAR} AS year, CASE WHEN {_month_sql()} IS NOT NULL AND {_YEAR} IS NOT NULL THEN {_month_sql()} || ' ' || {_YEAR} ELSE coalesce({_month_sql()}, {_YEAR}) END AS exam_type FROM part"),
    "s03_content_hash": (lambda t: t.documents.select("doc_id", F.sha2("text", 256).alias("hash")), "SELECT doc_id, sha256(text) AS hash FROM documents"),
    "s04_new_uploads": (
        lambda t: I.new_uploads(t.documents.where("doc_id % 2 = 1").select("source", F.sha2("text", 256).alias("hash")), t.documents.where("doc_id % 2 = 0").select("source", F.sha2("text", 256).alias("hash")), ("source", "hash")),
        "SELECT DISTINCT source, sha256(text) AS hash FROM documents WHERE doc_id % 2 = 1 EXCEPT SELECT source, sha256(text) FROM documents WHERE doc_id % 2 = 0",
    ),
    "s10_layer_quality": (
        lambda t: t.documents.select("doc_id", I.layer_quality(F.length("text"), F.size(F.split("text", "\n", -1)), F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).alias("quality")),
        "SELECT doc_id, CASE WHEN length(text) / len(string_split(text, chr(10))) < 50 THEN 'image' WHEN len(regexp_extract_all(text, '[#*$%&|<>]')) * 100.0 / length(text) > 0.4 THEN 'dirty' ELSE 'clean' END AS quality FROM documents",
    ),
    "s17_export": (
        lambda t: t.questions.withColumn("module_number", F.nullif("module_number", F.lit(5))).join(t.modules.select("subject_id", "module_number", "module_name"), ["subject_id", "module_number"], "left").select(F.col("question_no").cast("string").alias("question_number"), F.substring("qtext", 1, 200).alias("text"), F.coalesce("module_name", F.lit("")).alias("module"), "part", "marks", F.col("paper_id").alias("paper"), F.col("subject_id").alias("subject")),
        "SELECT CAST(question_no AS VARCHAR) AS question_number, substr(qtext, 1, 200) AS text, coalesce(module_name, '') AS module, part, marks, paper_id AS paper, q.subject_id AS subject FROM questions q LEFT JOIN modules m ON q.subject_id = m.subject_id AND nullif(q.module_number, 5) = m.module_number",
    ),
    "s21_raw_text_cut": (lambda t: t.documents.select("doc_id", F.substring("text", 1, 50000).alias("raw_text")), "SELECT doc_id, substr(text, 1, 50000) AS raw_text FROM documents"),
    "s22_first_wins": (
        lambda t: I.first_wins(t.questions, ("paper_id", "question_no"), ("topic_id", "supplier_id", "marks", "exam_type")).select("paper_id", "question_no", "topic_id", "supplier_id", "qtext"),
        "SELECT paper_id, question_no, topic_id, supplier_id, qtext FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, question_no ORDER BY topic_id, supplier_id, marks, exam_type) AS r FROM questions) WHERE r = 1",
    ),
    "s23_fill_empty": (
        lambda t: I.fill_empty(t.papers.where("paper_id % 3 < 2").select("paper_id", F.when(F.col("paper_id") % 2 == 0, F.col("exam_year")).otherwise("").alias("exam_year"), F.when(F.col("paper_id") % 5 > 0, F.col("subject_id")).alias("subject_id")), t.papers.where("paper_id % 3 > 0").select("paper_id", "exam_year", "subject_id"), ("paper_id",), ("exam_year", "subject_id")),
        "SELECT coalesce(o.paper_id, n.paper_id) AS paper_id, coalesce(nullif(o.exam_year, ''), n.exam_year) AS exam_year, coalesce(o.subject_id, n.subject_id) AS subject_id FROM (SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN exam_year ELSE '' END AS exam_year, CASE WHEN paper_id % 5 > 0 THEN subject_id END AS subject_id FROM papers WHERE paper_id % 3 < 2) o FULL JOIN (SELECT * FROM papers WHERE paper_id % 3 > 0) n ON o.paper_id = n.paper_id",
    ),
    "s29_default_modules": (
        lambda t: I.default_modules(t.nation.select(F.col("n_nationkey").cast("long").alias("subject_id")), t.modules),
        "SELECT subject_id, CAST(i AS INT) AS module_number, 'Module ' || CAST(i AS VARCHAR) AS module_name, 20.0::DOUBLE AS weightage FROM (SELECT CAST(n_nationkey AS BIGINT) AS subject_id FROM nation WHERE n_nationkey NOT IN (SELECT subject_id FROM modules)), UNNEST(range(1, 6)) AS u(i)",
    ),
    "f12_valid_rows": (
        lambda t: t.questions.where(I.valid_rows(F.substring("qtext", 1, 9), F.col("marks") - 10)).groupBy("subject_id").agg(F.count(F.lit(1)).alias("valid")),
        "SELECT subject_id, count(*) AS valid FROM questions WHERE marks - 10 > 0 AND length(trim(substr(qtext, 1, 9))) >= 5 GROUP BY 1",
    ),
    "f01_active_papers": (lambda t: t.papers.where("NOT is_deleted"), "SELECT * FROM papers WHERE NOT is_deleted"),
    "f02_owner_filter": (lambda t: t.papers.where("owner_id = 7 OR owner_id = 11"), "SELECT * FROM papers WHERE owner_id IN (7, 11)"),
    "f08_icontains": (lambda t: t.qlines.where(F.lower("line").contains("module") | F.lower("line").contains("green")), "SELECT * FROM qlines WHERE contains(lower(line), 'module') OR contains(lower(line), 'green')"),
    "f10_cleaned_or_text": (
        lambda t: t.qlines.select("topic_id", "form", F.coalesce(F.nullif(F.when(F.col("form") % 2 == 0, "").otherwise(F.upper("line")), F.lit("")), F.col("line")).alias("shown")),
        "SELECT topic_id, form, coalesce(nullif(CASE WHEN form % 2 = 0 THEN '' ELSE upper(line) END, ''), line) AS shown FROM qlines",
    ),
    "c01_final_module": (
        lambda t: t.questions.select("paper_id", "question_no", "topic_id", "supplier_id", C.final_module(F.col("topic_id") % 3 == 0, F.when(F.col("topic_id") % 4 > 0, F.col("module_number") + F.lit(1)), F.col("module_number") + 1 <= 5, F.col("module_number")).alias("module_final")),
        "SELECT paper_id, question_no, topic_id, supplier_id, CASE WHEN topic_id % 3 = 0 THEN CASE WHEN module_number + 1 <= 5 AND topic_id % 4 > 0 THEN module_number + 1 END WHEN topic_id % 4 = 0 THEN module_number WHEN module_number + 1 <= 5 THEN module_number + 1 END AS module_final FROM questions",
    ),
    "c03_keyword_module": (_stage1, f"SELECT topic_id, form, CASE WHEN {_TOP1} >= 1 THEN {D.case([(f'{s} = {_TOP1}', str(i)) for i, s in enumerate(_S1, 1)], 'NULL')} END AS module_number, {_TOP1} AS score FROM qlines"),
    "a01_overview": (
        lambda t: A.overview(t.questions, F.col("question_no") > 3, t.papers.where("NOT is_deleted"), t.modules),
        f"SELECT q.subject_id, n AS total_questions, u AS unique_questions, n - u AS duplicate_questions, {_pct('(n - u)', 'n')} AS duplicate_percentage, coalesce(p.c, 0) AS total_papers, coalesce(m.c, 0) AS total_modules FROM (SELECT subject_id, count(*) AS n, count(CASE WHEN NOT question_no > 3 THEN 1 END) AS u FROM questions GROUP BY 1) q LEFT JOIN (SELECT subject_id, count(*) AS c FROM papers WHERE NOT is_deleted GROUP BY 1) p USING (subject_id) LEFT JOIN (SELECT subject_id, count(*) AS c FROM modules GROUP BY 1) m USING (subject_id)",
    ),
    "a02_module_distribution": (
        lambda t: A.module_distribution(t.questions.withColumn("module_number", F.when(F.col("topic_id") % 7 > 0, F.col("module_number"))), t.modules),
        "WITH n AS (SELECT subject_id, CASE WHEN topic_id % 7 > 0 THEN module_number END AS module_number, count(*) AS c FROM questions GROUP BY ALL) SELECT m.subject_id, m.module_number, module_name, CAST(weightage AS DOUBLE) AS weightage, coalesce(c, 0) AS count FROM modules m LEFT JOIN n ON m.subject_id = n.subject_id AND m.module_number = n.module_number UNION ALL SELECT subject_id, 0, 'Unclassified', 0.0, c FROM n WHERE module_number IS NULL",
    ),
    "a03_difficulty_distribution": (
        lambda t: A.distribution(t.questions, C.difficulty(F.col("qtext"), F.col("marks")), "difficulty", ("qtext", "marks")),
        f"SELECT subject_id, difficulty, count(*) AS count FROM (SELECT subject_id, {Q._difficulty('qtext', 'marks')} AS difficulty FROM questions) GROUP BY 1, 2",
    ),
    "a04_bloom_distribution": (
        lambda t: A.dense(A.distribution(t.questions, C.bloom_level(F.col("qtext")), "bloom", ("qtext",)), "bloom", LEVELS),
        f"WITH n AS (SELECT subject_id, {Q._bloom('qtext')} AS bloom, count(*) AS c FROM questions GROUP BY ALL) SELECT s.subject_id, l.bloom, coalesce(c, 0) AS count FROM (SELECT DISTINCT subject_id FROM n) s CROSS JOIN (SELECT unnest([{', '.join(map(D.q, LEVELS))}]) AS bloom) l LEFT JOIN n ON n.subject_id = s.subject_id AND n.bloom = l.bloom",
    ),
    "a05_year_trend": (
        lambda t: A.year_trend(t.questions, t.papers),
        "SELECT p.paper_id, p.exam_year, count(q.paper_id) AS count FROM papers p LEFT JOIN questions q ON p.paper_id = q.paper_id WHERE p.exam_year <> '' GROUP BY 1, 2",
    ),
    "a06_topic_frequency": (
        lambda t: t.questions.select(F.explode(F.split("topic_name", " ")).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "topic").limit(10),
        "SELECT topic, count(*) AS count FROM (SELECT unnest(string_split(topic_name, ' ')) AS topic FROM questions) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "a07_top_topics": (
        lambda t: A.top_topics(_topics(t), ("subject_id", "part"), 3).select("subject_id", "part", "topic_name", "frequency", "rank"),
        f"WITH {TOPICS} SELECT * FROM (SELECT subject_id, part, topic_name, frequency, row_number() OVER (PARTITION BY subject_id, part ORDER BY frequency DESC, topic_name) AS rank FROM topics) WHERE rank <= 3",
    ),
    "a10_topic_clusters": (_topics, f"WITH {TOPICS} SELECT * FROM topics"),
    "a11_cluster_groups": (_clusters, f"WITH {_GROUPS} SELECT * FROM groups"),
    "a12_back_propagate": (
        lambda t: A.back_propagate(t.questions, _topics(t), _BY).select("paper_id", "question_no", "topic_id", "supplier_id", "repetition_count", "years_appeared"),
        f"WITH {TOPICS} SELECT paper_id, question_no, topic_id, supplier_id, frequency AS repetition_count, years AS years_appeared FROM questions q LEFT JOIN topics t ON q.subject_id = t.subject_id AND q.topic_name = t.topic_name AND q.part = t.part",
    ),
    "a13_priority_assignments": (lambda t: A.priority_assignments(_clusters(t)), f"WITH {_GROUPS} SELECT cluster_id, {TIER.format('frequency')} AS tier, {LABEL.format('(' + TIER.format('frequency') + ')')} AS tier_label, frequency FROM groups WHERE cluster_type = 'strict_repetition'"),
    "a14_tier_summary": (
        lambda t: A.tier_summary(_topics(t)),
        f"WITH {TOPICS} SELECT l.tier_label, count(t.priority_tier) AS count FROM (SELECT unnest(['Top Priority', 'High Priority', 'Medium Priority', 'Low Priority']) AS tier_label) l LEFT JOIN topics t ON {LABEL.format('t.priority_tier')} = l.tier_label AND t.priority_tier IS NOT NULL GROUP BY 1",
    ),
    "a15_tier_counts": (
        lambda t: A.tier_counts(_topics(t), ("subject_id",)),
        f"WITH {TOPICS} SELECT subject_id, " + ", ".join(f"count(CASE WHEN priority_tier = {i} THEN 1 END) AS tier_{i}" for i in (1, 2, 3, 4)) + ", count(*) AS topics FROM topics GROUP BY 1",
    ),
    "a17_classification_rate": (
        lambda t: A.classification_rate(t.questions.withColumn("module_number", F.when(F.col("topic_id") % 7 > 0, F.col("module_number")))),
        f"SELECT subject_id, {_pct('count(CASE WHEN topic_id % 7 > 0 THEN 1 END)', 'count(*)')} AS classification_rate FROM questions GROUP BY 1",
    ),
    "a20_paper_status": (lambda t: A.paper_status(t.papers), "SELECT subject_id, " + ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {s}" for s in ("pending", "processing", "completed", "failed")) + ", count(*) AS total FROM papers GROUP BY 1"),
    "a21_recent_subjects": (
        lambda t: t.papers.groupBy("subject_id").agg(F.count(F.lit(1)).alias("papers"), F.max("exam_year").alias("latest")).orderBy(F.desc("latest"), F.desc("papers"), "subject_id").limit(5),
        "SELECT subject_id, count(*) AS papers, max(exam_year) AS latest FROM papers GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 5",
    ),
    "a22_paper_counters": (
        lambda t: A.paper_counters(t.questions.withColumn("module_number", F.when(F.col("topic_id") % 7 > 0, F.col("module_number")))),
        "SELECT paper_id, count(*) AS questions_extracted, count(CASE WHEN topic_id % 7 > 0 THEN 1 END) AS questions_classified FROM questions GROUP BY 1",
    ),
    "a23_part_a_sessions": (
        lambda t: A.sessions(t.questions, SESSIONS, 3, "A"),
        "SELECT subject_id, exam_type, CASE exam_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SESSIONS)) + " ELSE 999 END AS session_order, count(*) AS questions, sum(coalesce(nullif(marks, 0), 3)) AS marks FROM questions WHERE part = 'A' GROUP BY 1, 2, 3",
    ),
    "a24_part_b_numbers": (
        lambda t: t.questions.where("part = 'B'").groupBy("exam_type", F.col("question_no").cast("string").alias("question_number")).agg(F.count(F.lit(1)).alias("questions"), F.sum(F.coalesce(F.nullif("marks", F.lit(0)), F.lit(7))).alias("marks")),
        "SELECT exam_type, CAST(question_no AS VARCHAR) AS question_number, count(*) AS questions, sum(coalesce(nullif(marks, 0), 7)) AS marks FROM questions WHERE part = 'B' GROUP BY 1, 2",
    ),
    "a27_by_year": (
        lambda t: t.questions.groupBy(T.or_unknown(F.when(F.col("paper_id") % 9 == 0, "").otherwise(F.col("exam_year"))).alias("year")).agg(F.count(F.lit(1)).alias("questions")),
        "SELECT coalesce(nullif(CASE WHEN paper_id % 9 = 0 THEN '' ELSE exam_year END, ''), 'Unknown') AS year, count(*) AS questions FROM questions GROUP BY 1",
    ),
    "a30_study_order": (
        lambda t: _study(t),
        f"WITH {TOPICS}, named AS (SELECT subject_id, topic_name || ' ' || part AS topic_name, frequency, priority_tier FROM topics), x AS (SELECT *, row_number() OVER (PARTITION BY subject_id, priority_tier ORDER BY frequency DESC, topic_name) AS in_tier FROM named) SELECT subject_id, topic_name, row_number() OVER (PARTITION BY subject_id ORDER BY priority_tier, frequency DESC, topic_name) AS rank, CASE WHEN frequency >= 4 THEN 'Must learn first' WHEN frequency = 3 THEN 'Strongly prepare' WHEN frequency = 2 THEN 'Prepare next' ELSE 'Optional' END || ' — appeared ' || CAST(frequency AS VARCHAR) || CASE WHEN frequency >= 2 THEN ' times.' ELSE ' time.' END AS recommendation FROM x WHERE priority_tier < 4 OR in_tier <= 10",
    ),
    "a31_question_numbers": (
        lambda t: t.questions.groupBy("subject_id", "part").agg(F.array_join(F.array_sort(F.collect_set(F.col("question_no").cast("string"))), ",").alias("numbers")),
        "SELECT subject_id, part, string_agg(DISTINCT CAST(question_no AS VARCHAR), ',' ORDER BY CAST(question_no AS VARCHAR)) AS numbers FROM questions GROUP BY 1, 2",
    ),
    "a32_unassigned_as_low": (
        lambda t: _clusters(t).join(A.priority_assignments(_clusters(t)).select("cluster_id", "tier"), "cluster_id", "left").groupBy(F.coalesce("tier", F.lit(4)).alias("tier")).agg(F.count(F.lit(1)).alias("clusters")),
        f"WITH {_GROUPS} SELECT CASE WHEN cluster_type = 'strict_repetition' THEN {TIER.format('frequency')} ELSE 4 END AS tier, count(*) AS clusters FROM groups GROUP BY 1",
    ),
    "a38_rollup": (
        lambda t: t.questions.rollup("subject_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("marks").alias("marks")),
        "SELECT subject_id, part, count(*) AS n, sum(marks) AS marks FROM questions GROUP BY ROLLUP (subject_id, part)",
    ),
    "a39_entity_counts": (
        lambda t: t.papers.groupBy("subject_id").agg(F.count(F.lit(1)).alias("papers")).join(t.modules.groupBy("subject_id").agg(F.count(F.lit(1)).alias("modules")), "subject_id", "left"),
        "SELECT subject_id, p.papers, m.modules FROM (SELECT subject_id, count(*) AS papers FROM papers GROUP BY 1) p LEFT JOIN (SELECT subject_id, count(*) AS modules FROM modules GROUP BY 1) m USING (subject_id)",
    ),
    "j03_duplicate_of": (
        lambda t: t.papers.alias("p").join(t.papers.select(F.col("paper_id").alias("o"), F.col("status").alias("original_status")), (F.col("paper_id") - F.col("paper_id") % 5) == F.col("o"), "left").select("paper_id", F.col("o").alias("original"), "original_status"),
        "SELECT p.paper_id, o.paper_id AS original, o.status AS original_status FROM papers p LEFT JOIN papers o ON p.paper_id - p.paper_id % 5 = o.paper_id",
    ),
    "j05_order_by_tier": (
        lambda t: _clusters(t).join(A.priority_assignments(_clusters(t)).select("cluster_id", "tier"), "cluster_id", "left").withColumn("position", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.asc_nulls_first("tier"), F.desc("frequency"), "topic_id"))).select("cluster_id", "position"),
        f"WITH {_GROUPS} SELECT cluster_id, row_number() OVER (PARTITION BY subject_id ORDER BY CASE WHEN cluster_type = 'strict_repetition' THEN {TIER.format('frequency')} END ASC NULLS FIRST, frequency DESC, topic_id) AS position FROM groups",
    ),
    "j06_subjects_with_pending": (lambda t: t.modules.select("subject_id").distinct().join(t.papers.where("status = 'pending'"), "subject_id", "left_semi"), "SELECT DISTINCT subject_id FROM modules WHERE subject_id IN (SELECT subject_id FROM papers WHERE status = 'pending')"),
    "j07_not_cached": (lambda t: t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "w04_carry_forward": (
        lambda t: t.qlines.withColumn("part_now", F.last(F.when(F.col("form") % 3 == 0, F.col("form")), True).over(Window.partitionBy("topic_id").orderBy("form").rowsBetween(Window.unboundedPreceding, 0))).select("topic_id", "form", "part_now"),
        "SELECT topic_id, form, last_value(CASE WHEN form % 3 = 0 THEN form END IGNORE NULLS) OVER (PARTITION BY topic_id ORDER BY form ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part_now FROM qlines",
    ),
    "w05_running_counter": (
        lambda t: t.qlines.withColumn("n", F.sum((F.col("form") % 2).cast("long")).over(Window.partitionBy("topic_id").orderBy("form"))).select("topic_id", "form", "n"),
        "SELECT topic_id, form, CAST(sum(form % 2) OVER (PARTITION BY topic_id ORDER BY form) AS BIGINT) AS n FROM qlines",
    ),
    "o05_page": (lambda t: t.papers.select("paper_id", "exam_year").orderBy(F.desc("exam_year"), "paper_id").offset(40).limit(20), "SELECT paper_id, exam_year FROM papers ORDER BY exam_year DESC, paper_id LIMIT 20 OFFSET 40"),
    "u01_union_parts": (
        lambda t: t.questions.where("part = 'A'").select("paper_id", "qtext").unionByName(t.questions.where("part = 'B'").select("paper_id", "qtext")),
        "SELECT paper_id, qtext FROM questions WHERE part = 'A' UNION ALL SELECT paper_id, qtext FROM questions WHERE part = 'B'",
    ),
    "u04_unmatched": (lambda t: t.qlines.select("topic_id", "form").exceptAll(_stage1(t).where("module_number IS NOT NULL").select("topic_id", "form")), f"SELECT topic_id, form FROM qlines WHERE NOT {_TOP1} >= 1"),
    "v02_cosine_pairs": (lambda t: _pairs(t).select("a", "b", F.round("score", 6).alias("score")), f"WITH {_PAIRS} SELECT a, b, round(score, 6) AS score FROM pairs"),
    "v06_best_duplicate": (lambda t: V.best_duplicates(_pairs(t)).select("id", "duplicate_of", F.round("score", 6).alias("score")), f"WITH {_PAIRS} SELECT b AS id, arg_max(a, score) AS duplicate_of, round(max(score), 6) AS score FROM pairs GROUP BY 1"),
    "v07_first_duplicate": (lambda t: V.first_duplicates(_pairs(t)).select("id", "duplicate_of", F.round("score", 6).alias("score")), f"WITH {_PAIRS} SELECT b AS id, min(a) AS duplicate_of, round(arg_min(score, a), 6) AS score FROM pairs GROUP BY 1"),
    "v08_mark_duplicates": (
        lambda t: t.embeddings.select("vec_id").join(V.first_duplicates(_pairs(t)).select(F.col("id").alias("vec_id"), "duplicate_of"), "vec_id", "left").select("vec_id", F.col("duplicate_of").isNotNull().alias("is_duplicate"), "duplicate_of"),
        f"WITH {_PAIRS} SELECT e.vec_id, d.a IS NOT NULL AS is_duplicate, d.a AS duplicate_of FROM embeddings e LEFT JOIN (SELECT b, min(a) AS a FROM pairs GROUP BY 1) d ON e.vec_id = d.b",
    ),
    "v11_jaccard": (lambda t: _self(t).select("topic_id", "form", "form_b", F.round(jaccard(F.col("ts"), F.col("ts_b")), 6).alias("score")), f"WITH {_NORM}, {_SETS} SELECT x.topic_id, x.form, y.form AS form_b, round(CASE WHEN len(x.ts) = 0 OR len(y.ts) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x.ts, y.ts))::DOUBLE / len(list_distinct(x.ts || y.ts)) END, 6) AS score FROM sets x JOIN sets y ON x.topic_id = y.topic_id AND x.form < y.form"),
    "v12_keyword_similarity": (
        lambda t: _self(t).select("topic_id", "form", "form_b", F.round(keyword_similarity(F.col("ks"), F.col("ks_b")), 6).alias("score")),
        f"WITH {_NORM}, {_SETS}, p AS (SELECT x.topic_id, x.form, y.form AS form_b, len(list_intersect(x.ks, y.ks))::DOUBLE AS i, len(list_distinct(x.ks || y.ks)) AS u, least(len(x.ks), len(y.ks)) AS m FROM sets x JOIN sets y ON x.topic_id = y.topic_id AND x.form < y.form) SELECT topic_id, form, form_b, round(CASE WHEN m = 0 THEN 0.0::DOUBLE WHEN i / m > 0.6 THEN least(1.0::DOUBLE, i / u * 1.3::DOUBLE) ELSE i / u END, 6) AS score FROM p",
    ),
    "v14_alike": (
        lambda t: _self(t).select("topic_id", "form", "form_b", alike(F.col("normal"), F.col("normal_b"), F.col("ts"), F.col("ts_b")).alias("alike")),
        f"WITH {_NORM}, {_SETS} SELECT x.topic_id, x.form, y.form AS form_b, CASE WHEN length(x.normal) < 30 OR length(y.normal) < 30 THEN contains(x.normal, y.normal) OR contains(y.normal, x.normal) ELSE len(list_intersect(x.ts, y.ts))::DOUBLE / len(list_distinct(x.ts || y.ts)) >= 0.55 END AS alike FROM sets x JOIN sets y ON x.topic_id = y.topic_id AND x.form < y.form",
    ),
    "v16_representative": (
        lambda t: V.centroid_representatives(t.embeddings, "label", "vec_id", "embedding"),
        "WITH c AS (SELECT label, i, avg(e::DOUBLE) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS e FROM embeddings) GROUP BY ALL), d AS (SELECT e.label, e.vec_id, round(sqrt(sum((e.x::DOUBLE - c.m) * (e.x::DOUBLE - c.m))), 9) AS dist FROM (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY 1, 2) SELECT label, vec_id AS representative FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS r FROM d) WHERE r = 1",
    ),
    "k03_strict_clusters": (lambda t: K.linkage_clusters(t.embeddings, 0.70, "vec_id", "embedding", ("label",)), None),
    "k06_leader_clusters": (
        lambda t: K.leader_clusters(t.embeddings, 0.3, "vec_id", "embedding", ("label",), ("vec_id",)),
        leaders_sql("s AS (SELECT label AS bucket, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings)", "list_cosine_similarity(l.v, s.v) >= 0.3", "label", "vec_id"),
    ),
    "k12_components": (
        lambda t: components(_pairs(t, 0.35).select("a", "b")),
        f"WITH RECURSIVE {_PAIRS.replace('>= 0.3)', '>= 0.35)')}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a) SELECT node, min(reach) AS component FROM r GROUP BY 1",
    ),
    "k13_exact_priority": (
        lambda t: K.exact_priority(t.questions, "qtext", ("subject_id",)),
        "SELECT subject_id, key, frequency, years, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY frequency DESC, key) AS rank FROM (SELECT subject_id, substr(qtext, 1, 100) AS key, count(*) AS frequency, count(DISTINCT exam_year) AS years FROM questions GROUP BY 1, 2)) WHERE rank <= 20",
    ),
    "k14_key_terms": (_terms, f"WITH {_NORM}, {_GRAMS} SELECT g, term, n, rank FROM terms"),
    "k15_topic_phrases": (_phrases, f"WITH {_NORM}, {_GRAMS}, {_PHRASES} SELECT topic_id, form, g, phrase FROM phrases"),
    "k16_canonical_phrase": (lambda t: K.canonical_phrase(_phrases(t), ("g",), "topic_id"), f"WITH {_NORM}, {_GRAMS}, {_PHRASES} SELECT g, phrase AS topic FROM (SELECT g, phrase, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, min(topic_id), phrase) AS r FROM phrases WHERE phrase <> '' GROUP BY 1, 2) WHERE r = 1"),
}


def _study(t: Tables):
    named = _topics(t).withColumn("topic_name", F.concat_ws(" ", "topic_name", "part"))
    return A.study_order(named, ("subject_id",)).select("subject_id", "topic_name", "rank", A.recommendation(F.col("frequency")).alias("recommendation"))
