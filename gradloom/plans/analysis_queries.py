"""Queries for the analysis of subjects, replacing tables, extraction by format and model calls, with their oracle SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gradloom.functions.text import clean
from gradloom.lineage import cut, new_path
from gradloom.operators import calls as C
from gradloom.operators import density as D
from gradloom.operators import formats, topics
from gradloom.operators import merge as M
from gradloom.operators import rules
from gradloom.operators import stats as A
from gradloom.operators.segment import segment
from gradloom.operators.table_functions import register
from gradloom.plans import later_queries as L
from gradloom.plans import relational_queries as Q
from gradloom.plans.exam import ASKED, Tables
from gradloom.sources import versions
from gradloom.sources.files import extract_pages, failed, papers_text
from gradloom.streaming import progress as P

_ORDER = ("paper_id", "question_no", "topic_id", "supplier_id", "marks", "qtext")
# module 5 is unknown, so its questions are without one
_LOOSE = "SELECT paper_id, question_no, topic_id, supplier_id, subject_id, nullif(module_number, 5) AS module_number, part, marks, exam_year, qtext FROM questions"


def _analysed(t: Tables):
    """All subjects analysed, then two of them again: 1 with its Part A alone, 2 with nothing."""
    folder = new_path(t.spark, "topics")
    all_ = t.sql(_LOOSE)
    topics.refresh_subjects(all_, folder, all_.select("subject_id"), _ORDER)
    again = all_.select("subject_id").where("subject_id IN (1, 2)")
    topics.refresh_subjects(all_.where("subject_id <> 2 AND part = 'A'"), folder, again, _ORDER)
    return topics.topics_of(t.spark, folder)


def _replaced(t: Tables):
    """Memberships of all subjects, then those of subject 3 replaced by its papers that aren't deleted, and subject 4's by nothing."""
    folder = new_path(t.spark, "papers")
    rows = t.papers.select("paper_id", "subject_id", F.lit("old").alias("run"))
    versions.refresh(rows, folder, ("subject_id",))
    new = t.papers.where("subject_id = 3 AND NOT is_deleted").select("paper_id", "subject_id", F.lit("new").alias("run"))
    versions.refresh(new, folder, ("subject_id",), t.papers.select("subject_id").where("subject_id IN (3, 4)"))
    return versions.read(t.spark, folder, ("subject_id",))


def _expected() -> str:
    """What stands in the papers of ``printed``, from the columns that they were made of."""

    def rows(where: str, layout: str, items: list[tuple[int, int, str, int]]) -> list[str]:
        return [f"SELECT p_partkey AS paper_id, {pos} AS pos, '{n}' AS question_number, {text} AS text, {marks} AS marks, '{layout}' AS layout FROM part WHERE {where}" for pos, n, text, marks in items]

    part_a = [(i, i + 1, f"'{w} the role of ' || p_name || ' in detail'", 3) for i, w in enumerate(ASKED[:10])]
    numbered = [(n - 1, n, f"'Discuss ' || p_name || ' case {n} of ' || p_type || ' OR Compare ' || p_brand || ' with ' || p_name", 14) for n in range(11, 21)]
    pairs = [x for m in range(1, 6) for x in (f"'Discuss ' || p_name || ' topic {m} at length OR Compare ' || p_brand || ' for {m} or more'", f"'Derive ' || p_type || ' rule {m} in ' || p_name || ' OR'")]
    modules = [(i + 10, i + 11, x, 14) for i, x in enumerate(pairs)]
    compare = "'Compare ' || p_type || ' models of ' || p_name"
    loose = [(n - 1, n, f"'Explain ' || p_name || ' usage in ' || p_brand || ' plants OR ' || {compare}" + (f" || ' ' || repeat('=', 398 - length({compare}))" if n == 13 else ""), 14) for n in (11, 12, 13)]
    lines = [(13, 17, "'Discuss the ' || p_name || ' economy of ' || p_brand", 14), (14, 18, "'Outline the whole ' || p_type || ' plan'", 14)]
    alone = [(n - 1, n, f"'Explain the ' || p_name || ' rule {n} of ' || p_type", 3) for n in range(1, 7)]
    return " UNION ALL ".join([
        *rows("p_partkey % 4 = 0", "numbered", part_a + numbered), *rows("p_partkey % 8 = 1", "modules", part_a + modules), *rows("p_partkey % 8 = 5", "modules+loose", part_a + modules[:6]),
        *rows("p_partkey % 4 = 2", "modules+loose+lines", part_a + loose + lines), *rows("p_partkey % 4 = 3", "modules+loose+lines", alone),
    ])


# A model whose replies follow from the prompt alone, so that the oracle can say them too.


def _judge(prompt: str) -> str:
    """Says of a pair what the length of its second text says."""
    n = len(prompt.rsplit("\nB: ", 1)[1])
    if n % 7 == 0:
        raise TimeoutError("no answer")
    return f"Same: {'NO' if n % 3 == 0 else 'YES'}\nVerdict: {'DIFFERENT' if n % 3 == 0 else 'SIMILAR'}\nConfidence: {76 + n % 20}"


def _namer(prompt: str) -> str:
    """Labels of a list: the second word; lists with a red topic get no array, those with an old one an entry too few."""
    lines = [x.split(". ", 1)[1] for x in prompt.split("\n\nReturn")[0].split("\n")[1:]]
    if any("red " in x for x in lines):
        return "I can't [do that"
    words = [x.split(" ")[1] if not x.startswith("big ") else "x" * 80 for x in lines]
    return "Here you are: " + json.dumps(words[:-1] if any(x.startswith("old ") for x in lines) else words)


def _first_word(prompt: str) -> str:
    lines = prompt.split("\n- ")[1:]
    if len(lines[0]) % 5 == 0:
        return " "
    return f" {len(lines)} {max(map(len, lines))} "


def _scribe(prompt: str) -> str | None:
    """Pages in capitals; of papers in promotion the last is lost, of small ones nothing comes back."""
    pages = prompt.split("\n\n", 1)[1]
    if "SMALL" in pages:
        return None
    return pages.rsplit("=== PAGE", 1)[0].upper() if "PROMO" in pages else pages.upper().replace("=== PAGE SEPARATOR ===", "===page separator===")


def _memory(t: Tables) -> str:
    return new_path(t.spark, "answers")


def _members(t: Tables):
    return t.qlines.select(F.col("topic_id").alias("cluster"), (F.col("topic_id") % 7).alias("module"), (F.col("form") + 1).alias("seen"), "line", ((F.col("topic_id") * 5 + F.col("form") * 3) % 50 / 100 + 0.5).alias("score"))


def _refined(t: Tables):
    return C.refined(_members(t), ["module"], ["seen"], "line", "score", [("judge", _judge)], _memory(t), tries=1)


def _twice(t: Tables):
    """The same clusters confirmed twice with one memory: what was asked the second time."""
    folder, chain = _memory(t), [("judge", _judge)]
    C.confirmed(_members(t), ["module"], ["seen"], "line", chain, folder, budget=50, tries=1).write.format("noop").mode("overwrite").save()
    first = C.answers(t.spark, folder).agg(F.count(F.lit(1)).alias("first_calls"))
    C.confirmed(_members(t), ["module"], ["seen"], "line", chain, folder, budget=50, tries=1).write.format("noop").mode("overwrite").save()
    return first.join(C.answers(t.spark, folder).agg(F.count(F.lit(1)).alias("all_calls")))  # one row each


_RANKED = "m AS (SELECT topic_id AS cluster, topic_id % 7 AS module, form + 1 AS seen, line, (topic_id * 5 + form * 3) % 50 / 100 + 0.5 AS score FROM qlines), r AS (SELECT m.*, (SELECT line FROM m f WHERE f.cluster = m.cluster AND f.seen = 1) AS first_text, seen > 1 AND row_number() OVER (PARTITION BY module, seen > 1 ORDER BY cluster, seen) <= {budget} AS in_budget FROM m)"
_SURE = "CASE WHEN length(line) % 7 = 0 THEN true ELSE length(line) % 3 <> 0 AND 76 + length(line) % 20 >= 80 END"


def _pages(t: Tables):
    """Papers in two pages, the second of them recognised badly."""
    return t.scans.select("paper_id", F.posexplode(F.split("text", "\nModule ", -1)).alias("page", "text"))


def _paged(t: Tables):
    return C.cleaned_pages(_pages(t), "paper_id", "page", "text", [("scribe", _scribe)], _memory(t), tries=1)


def _leg(t: Tables):
    """The recognised pages of a paper, cleaned together, joined and cut into questions."""
    joined = papers_text(_paged(t).select(F.col("paper_id").alias("path"), F.col("page").alias("page_number"), F.col("cleaned").alias("text"), F.lit(1.0).alias("confidence")), "\n")
    return segment(joined.select(F.col("path").alias("paper_id"), clean(F.col("text")).alias("text")))


_PART_TOPICS = "SELECT p_partkey AS topic_id, p_size % 6 AS module, p_name AS topic FROM part"

# questions with two values that people edit, and the forms that they sent, in order
_EDITED = "SELECT p_partkey AS id, CAST(p_size % 5 + 1 AS INT) AS module_number, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS difficulty FROM part"
_EDITS = "SELECT l_partkey AS id, l_orderkey AS paper, l_linenumber AS n, CAST(min(CASE WHEN p_partkey % 4 = 0 THEN p_size % 5 + 1 ELSE l_linenumber % 5 + 1 END) AS INT) AS module_number, min(CASE WHEN l_quantity > 40 THEN 'LARGE' WHEN p_size % 3 = 0 THEN NULL ELSE p_type END) AS difficulty, max(l_linestatus) = 'F' AND l_linenumber = 1 AS verified FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 3 <> 0 GROUP BY l_partkey, l_orderkey, l_linenumber"
_STICKY = {"module_number": "module_manually_set", "difficulty": "difficulty_manually_set"}


def _overridden(t: Tables):
    """Edits applied, then again, then a new classification of all."""
    rows = t.sql(_EDITED).withColumns({"module_manually_set": F.lit(False), "difficulty_manually_set": F.lit(False)})
    edits = t.sql(_EDITS)
    once = M.apply_edits(rows, edits, "id", ["paper", "n"], _STICKY, "verified")
    again = M.apply_edits(once, edits, "id", ["paper", "n"], _STICKY, "verified")
    return M.reclassified(again, rows.select("id", (F.col("id") % 5 + 1).cast("int").alias("module_number"), F.lit("computed").alias("difficulty")), "id", _STICKY)


def _priorities(t: Tables):
    """Tiers by Part A alone, then by all questions, when every third topic has become a concept."""
    first = M.assign_priorities(t.spark.createDataFrame([], "cluster_id long, tier int, tier_label string, frequency long"), A.cluster_groups(t.questions.where("part = 'A'"), ("topic_id",)).select(F.col("topic_id").alias("cluster_id"), "frequency", F.lit("strict_repetition").alias("cluster_type")))
    then = A.cluster_groups(t.questions.where("topic_id % 5 <> 0"), ("topic_id",)).select(F.col("topic_id").alias("cluster_id"), "frequency", F.expr("CASE WHEN topic_id % 3 = 0 THEN 'concept_similarity' ELSE 'strict_repetition' END").alias("cluster_type"))
    return M.assign_priorities(first.drop("state"), then)


def _streamed(t: Tables):
    """The states of jobs as a stream of micro-batches writes them, the last one twice."""
    folder, source = new_path(t.spark, "progress"), new_path(t.spark, "changes")
    changes = t.events.select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), F.expr(L._STATE).alias("status"))
    changes.repartition(3).write.parquet(source)
    stream = t.spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    P.follow(stream, folder, new_path(t.spark, "checkpoint")).awaitTermination()
    P.upserts(folder)(changes.where("event_id % 3 = 0"), 2)
    return P.progress(t.spark, folder)


def _from_sql(t: Tables):
    """The papers' pages, cut into questions by a function that SQL calls."""
    register(t.spark)
    return t.spark.sql("SELECT paper_id, pos, question_number, text, part, marks, module_hint, pages FROM segment_pages(TABLE (SELECT paper_id, page, text FROM {pages}))", pages=_pages_of(t))


def _pages_of(t: Tables):
    """The scans in two pages each; joined by a line feed they are what they were."""
    return t.scans.select("paper_id", F.posexplode(F.array(F.substring_index("text", "\n", 8), F.expr("substr(text, length(substring_index(text, chr(10), 8)) + 2)"))).alias("page", "text"))


def _rule_writer(prompt: str) -> str | None:
    """Rules on a length: by the number's rest of 5 right, right in a code block, right when told what is wrong, never right, or no reply."""
    n = int(prompt.split("longer than ")[1].split(" ")[0])
    told = rules.REPAIR in prompt
    right = f"length(question_text) > {n}"
    return [right, f"```sql\n{right} AND NOT contains(question_text, 'OR')\n```", right if told else f"reflect('x', '{n}') > 1", f"length(question_text) + {n}; drop table x", None][n % 5]


def _compiled(t: Tables):
    """A rule for each brand, compiled by a model, and the questions that it holds for."""
    wanted = t.part.select(F.regexp_extract("p_brand", r"(\d+)", 1).alias("n")).distinct().select(F.concat(F.lit("rule-"), "n").alias("rule_id"), F.lit("length").alias("kind"), F.concat(F.lit("questions longer than "), F.col("n"), F.lit(" characters")).alias("words"))
    found = cut(rules.compile_rules(wanted, [("writer", _rule_writer)], _memory(t), tries=1), "rules")
    questions = t.qlines.select(F.col("line").alias("question_text"), F.array().cast("array<string>").alias("keywords"), F.lit(None).cast("int").alias("marks"))
    hits = rules.execute_all(questions, rules.compiled(found)).select(F.explode("results").alias("rule_id", "holds")).where("holds").groupBy("rule_id").agg(F.count(F.lit(1)).alias("questions"))
    return found.join(hits, "rule_id", "left").select("rule_id", F.col("expression").isNotNull().alias("accepted"), "tries", F.coalesce("questions", F.lit(0)).alias("questions"))


def _reset(t: Tables):
    """Subject 2 and one that has nothing are reset: papers by status, and what is left of questions and groups."""
    questions, groups = new_path(t.spark, "questions"), new_path(t.spark, "groups")
    versions.refresh(t.questions.select("subject_id", "paper_id", "qtext"), questions, ("subject_id",))
    versions.refresh(A.cluster_groups(t.questions, ("subject_id", "topic_id")), groups, ("subject_id",))
    subjects = t.spark.createDataFrame([(2,), (99,)], "subject_id long")
    papers = topics.reset_subjects(t.papers, subjects, questions, groups).groupBy("subject_id").agg(F.count(F.when(F.col("status") == "pending", 1)).alias("pending"), F.count(F.lit(1)).alias("papers"))
    left = lambda folder, name: versions.read(t.spark, folder, ("subject_id",)).groupBy("subject_id").agg(F.count(F.lit(1)).alias(name))
    return papers.join(left(questions, "questions"), "subject_id", "left").join(left(groups, "groups"), "subject_id", "left").fillna(0)


def _layer(data: bytes) -> list[tuple[str, float]]:
    """A text layer: pages by form feeds; broken files have none."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    return [(p, 1.0) for p in data.decode()[5:].split("\f")]


def _recognised(data: bytes) -> list[tuple[str, float]]:
    """Recognition: of images alone, one page, half sure."""
    return [(data[4:].decode().upper(), 0.5)] if data.startswith(b"IMG-") else []


#: Files made of parts: with a text layer, as images, with a layer of a few characters, and of neither kind.
_FILES = "SELECT 'part-' || CAST(p_partkey AS STRING) AS path, CAST(CASE p_partkey % 4 WHEN 0 THEN '%PDF-' || p_name || chr(12) || p_type WHEN 1 THEN 'IMG-' || p_name WHEN 2 THEN '%PDF-a' ELSE 'XXX-' || p_name END AS BINARY) AS content FROM part"


def _cascade(t: Tables):
    return extract_pages(t.sql(_FILES, costly=True), [("layer", _layer), ("recognition", _recognised)], least_chars=5)


QUERIES = {
    "s05_extraction_cascade": (
        _cascade,
        "SELECT 'part-' || p_partkey AS path, CAST(i AS INT) AS page_number, CASE p_partkey % 4 WHEN 0 THEN [p_name, p_type][i] WHEN 1 THEN upper(p_name) END AS text, CASE p_partkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence, "
        "CASE p_partkey % 4 WHEN 0 THEN 'layer' WHEN 1 THEN 'recognition' WHEN 2 THEN 'failed (layer: 1 characters, recognition: 0 characters)' ELSE 'failed (layer: ValueError, recognition: 0 characters)' END AS method FROM part, UNNEST(CASE p_partkey % 4 WHEN 0 THEN [1, 2] WHEN 1 THEN [1] ELSE [0] END) AS u(i)",
    ),
    "s06_failed_files": (lambda t: failed(_cascade(t)), "SELECT 'part-' || p_partkey AS path, CASE p_partkey % 4 WHEN 2 THEN 'failed (layer: 1 characters, recognition: 0 characters)' ELSE 'failed (layer: ValueError, recognition: 0 characters)' END AS reason FROM part WHERE p_partkey % 4 >= 2"),
    "st08_reset": (
        _reset,
        "WITH p AS (SELECT subject_id, count(CASE WHEN status = 'pending' OR subject_id = 2 THEN 1 END) AS pending, count(*) AS papers FROM papers GROUP BY 1), q AS (SELECT subject_id, count(*) AS questions, count(DISTINCT topic_id) AS groups FROM questions WHERE subject_id <> 2 GROUP BY 1) "
        "SELECT p.subject_id, pending, papers, coalesce(questions, 0) AS questions, coalesce(groups, 0) AS groups FROM p LEFT JOIN q ON p.subject_id = q.subject_id",
    ),
    "x01_compiled_rules": (
        _compiled,
        "WITH b AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS n FROM part) SELECT 'rule-' || n AS rule_id, n % 5 < 3 AS accepted, CASE WHEN n % 5 < 2 THEN 1 ELSE 2 END AS tries, "
        "CASE WHEN n % 5 < 3 THEN (SELECT count(*) FROM qlines WHERE length(line) > n AND NOT (n % 5 = 1 AND contains(line, 'OR'))) ELSE 0 END AS questions FROM b",
    ),
    "x07_segment_in_sql": (_from_sql, f"SELECT paper_id, pos, question_number, text, part, marks, module_hint, 2 AS pages FROM ({Q.segmented()})"),
    "x07_question_counts": (
        lambda t: _from_sql(t).groupBy("paper_id").agg(F.count(F.lit(1)).alias("questions"), F.max("pages").alias("pages"), F.max("module_hint").alias("module")),
        "SELECT paper_id, len(regexp_extract_all(text, '(?m)^\\s*\\d{1,2}\\s*\\.\\s+\\S')) AS questions, 2 AS pages, TRY_CAST(regexp_extract(text, '(?m)^Module (\\d)$', 1) AS INT) AS module FROM scans",
    ),
    "s28_edits_survive": (
        _overridden,
        f"WITH q AS ({_EDITED}), e AS ({_EDITS}), s AS (SELECT e.*, module_number IS DISTINCT FROM coalesce_m AS m_changed, difficulty IS DISTINCT FROM coalesce_d AS d_changed FROM (SELECT e.*, CASE WHEN row_number() OVER w = 1 THEN q.module_number ELSE lag(e.module_number) OVER w END AS coalesce_m, "
        "CASE WHEN row_number() OVER w = 1 THEN q.difficulty ELSE lag(e.difficulty) OVER w END AS coalesce_d FROM e JOIN q ON e.id = q.id WINDOW w AS (PARTITION BY e.id ORDER BY e.paper, e.n)) e), "
        "l AS (SELECT id, arg_max(struct_pack(m := module_number, d := difficulty), (paper, n)) AS last, bool_or(m_changed) OR bool_or(verified) AS m_set, bool_or(d_changed) AS d_set FROM s GROUP BY id) "
        "SELECT q.id, CASE WHEN m_set THEN last.m ELSE CAST(q.id % 5 + 1 AS INT) END AS module_number, CASE WHEN d_set THEN last.d ELSE 'computed' END AS difficulty, coalesce(m_set, false) AS module_manually_set, coalesce(d_set, false) AS difficulty_manually_set FROM q LEFT JOIN l ON q.id = l.id",
    ),
    "s24_priorities": (
        _priorities,
        f"WITH a AS (SELECT topic_id, count(DISTINCT exam_year) AS f FROM questions WHERE part = 'A' GROUP BY 1), b AS (SELECT topic_id, count(DISTINCT exam_year) AS f FROM questions WHERE topic_id % 5 <> 0 AND topic_id % 3 <> 0 GROUP BY 1), r AS (SELECT coalesce(b.topic_id, a.topic_id) AS cluster_id, coalesce(b.f, a.f) AS frequency, CASE WHEN b.f IS NULL THEN 'kept' WHEN a.f IS NULL THEN 'created' WHEN a.f = b.f THEN 'unchanged' ELSE 'updated' END AS state FROM a FULL JOIN b ON a.topic_id = b.topic_id WHERE b.f IS NOT NULL OR a.topic_id % 5 = 0) "
        f"SELECT cluster_id, frequency, state, {Q.TIER.format('frequency')} AS tier, {Q.LABEL.format('(' + Q.TIER.format('frequency') + ')')} AS tier_label FROM r",
    ),
    "st02_stream_progress": (lambda t: _streamed(t).select("job", "status", "progress"), f"WITH {L._JOBS} SELECT job, status, progress FROM jobs"),
    "k10_density_clusters": (lambda t: D.density_clusters(t.embeddings, "vec_id", "embedding", ("label",)), None),
    "v17_confirmed": (
        lambda t: C.confirmed(_members(t), ["module"], ["seen"], "line", [("judge", _judge)], _memory(t), budget=50, tries=1),
        f"WITH {_RANKED.format(budget=50)} SELECT module, cluster, count(*) AS members, count(CASE WHEN in_budget THEN 1 END) AS asked, bool_and(NOT in_budget OR {_SURE}) AS confirmed FROM r GROUP BY 1, 2",
    ),
    "v17_calls": (
        _twice,
        f"WITH {_RANKED.format(budget=50)} SELECT count(DISTINCT first_text || chr(10) || line) AS first_calls, count(DISTINCT first_text || chr(10) || line) AS all_calls FROM r WHERE in_budget AND length(line) % 7 <> 0",
    ),
    "k08_refined_by_model": (
        lambda t: _refined(t).select("cluster", "seen", "module", "in_budget", "asked", "stays"),
        f"WITH {_RANKED.format(budget=100)} SELECT cluster, seen, module, in_budget, in_budget AND score >= 0.65 AND score < 0.85 AS asked, CASE WHEN NOT in_budget THEN true WHEN score >= 0.85 THEN true WHEN score < 0.65 THEN false WHEN length(line) % 7 = 0 THEN score >= 0.75 ELSE length(line) % 3 <> 0 END AS stays FROM r",
    ),
    "k18_topic_labels": (
        lambda t: C.topic_labels(t.sql(_PART_TOPICS), ["module"], ["topic_id"], "topic", [("namer", _namer)], _memory(t), tries=1),
        f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY topic_id) - 1 AS k FROM ({_PART_TOPICS})), l AS (SELECT *, k // 50 AS list FROM a), s AS (SELECT module, list, bool_or(contains(topic, 'red ')) AS bad, bool_or(topic LIKE 'old %') AS short, max(k) AS last_k FROM l GROUP BY 1, 2), "
        "w AS (SELECT l.*, CASE WHEN bad OR (short AND k = last_k) THEN NULL WHEN topic LIKE 'big %' THEN repeat('x', 80) ELSE string_split(topic, ' ')[2] END AS reply FROM l JOIN s ON l.module = s.module AND l.list = s.list) SELECT topic_id, module, topic, CASE WHEN length(reply) > 2 AND length(reply) < 80 THEN reply ELSE topic END AS label FROM w",
    ),
    "t41_cleaned_questions": (
        lambda t: C.cleaned_questions(t.sql(_PART_TOPICS), ["module"], ["topic_id"], "topic", [("namer", _namer)], _memory(t), tries=1),
        f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY topic_id) - 1 AS k FROM ({_PART_TOPICS})), l AS (SELECT *, k // 12 AS list FROM a), s AS (SELECT module, list, bool_or(contains(topic, 'red ')) AS bad, bool_or(topic LIKE 'old %') AS short, max(k) AS last_k FROM l GROUP BY 1, 2), "
        "w AS (SELECT l.*, CASE WHEN bad OR (short AND k = last_k) THEN NULL WHEN topic LIKE 'big %' THEN repeat('x', 80) ELSE string_split(topic, ' ')[2] END AS reply FROM l JOIN s ON l.module = s.module AND l.list = s.list) SELECT topic_id, module, topic, CASE WHEN length(reply) >= 10 THEN reply END AS cleaned FROM w",
    ),
    "k17_cluster_labels": (
        lambda t: C.cluster_labels(t.qlines, "topic_id", ["form"], "line", F.concat(F.lit("Module "), F.col("topic_id") % 5 + 1), [("first", _first_word)], _memory(t), tries=1),
        "SELECT topic_id, CASE WHEN arg_min(length(line), form) % 5 = 0 THEN 'Module ' || (topic_id % 5 + 1) ELSE count(*) || ' ' || max(length(line)) END AS label FROM qlines WHERE form < 5 GROUP BY topic_id",
    ),
    "t41_cleaned_pages": (
        lambda t: _paged(t).select("paper_id", "page", "cleaned", "model"),
        "WITH p AS (SELECT paper_id, CAST(i - 1 AS INT) AS page, string_split(text, chr(10) || 'Module ')[i] AS page_text, len(string_split(text, chr(10) || 'Module ')) AS n, contains(text, 'SMALL') AS small, contains(text, 'PROMO') AS promo FROM scans, UNNEST(range(1, 3)) AS u(i)) "
        "SELECT paper_id, page, CASE WHEN small THEN page_text WHEN promo AND page = n - 1 THEN '' ELSE regexp_replace(regexp_replace(upper(replace(page_text, 'ﬁ', 'FI')), '(?i)PAGE\\s+\\d+\\s*:\\s*', '', 'g'), '\\A\\s+|\\s+\\z', '', 'g') END AS cleaned, CASE WHEN small THEN 'none' ELSE 'scribe' END AS model FROM p",
    ),
    "p22_recognised_questions": (lambda t: _leg(t).select("paper_id", "pos", "question_number", "text"), None),
    "p16_by_format": (lambda t: formats.questions_by_format(t.printed), _expected()),
    "p18_line_parser": (
        lambda t: formats.questions_by_line(t.lined.withColumn("known", F.when(F.col("paper_id") % 2 == 0, F.array(F.lit("2")))), existing="known").select("paper_id", "question_number", "text"),
        "SELECT p_partkey AS paper_id, '1' AS question_number, 'Define ' || p_name || ' in terms of ' || p_type AS text FROM part UNION ALL SELECT p_partkey, '2', 'What is ' || p_brand || '? more on ' || p_name FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, '4', 'Discuss ' || p_brand || ' at length' FROM part",
    ),
    "k00_analyze_subjects": (lambda t: _analysed(t).drop("cluster"), None),
    "k00_module_totals": (
        lambda t: _analysed(t).groupBy("subject_id", "module_number").agg(*[F.sum(c).alias(c) for c in ("question_count", "total_marks", "part_a_count", "part_b_count")]),
        f"SELECT subject_id, module_number, count(*) AS question_count, CAST(sum(marks) AS BIGINT) AS total_marks, count(CASE WHEN part = 'A' THEN 1 END) AS part_a_count, count(CASE WHEN part = 'B' THEN 1 END) AS part_b_count FROM ({_LOOSE}) WHERE subject_id <> 2 AND (subject_id <> 1 OR part = 'A') GROUP BY 1, 2",
    ),
    "st06_replaced_papers": (
        _replaced,
        "SELECT paper_id, subject_id, 'old' AS run FROM papers WHERE subject_id NOT IN (3, 4) UNION ALL SELECT paper_id, subject_id, 'new' FROM papers WHERE subject_id = 3 AND NOT is_deleted",
    ),
}
