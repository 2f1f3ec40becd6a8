"""Model calls: what is remembered, what is within a budget, and lists in one call."""

import os

import pytest
from pyspark.sql import functions as F

from gradloom.operators import calls as C
from gradloom.operators import rules as R
from gradloom.operators import segment, table_functions
from gradloom.sources import files


class Counted:
    """A model that notes every call in a file, and stops working when a prompt holds ``breaks``."""

    def __init__(self, reply, log, breaks=None):
        self.reply, self.log, self.breaks = reply, str(log), breaks

    def __call__(self, prompt):
        fd = os.open(self.log, os.O_APPEND | os.O_CREAT | os.O_WRONLY)
        os.write(fd, (repr(prompt) + "\n").encode())
        os.close(fd)
        if self.breaks and self.breaks in prompt and not os.path.exists(self.log + ".mended"):
            raise SystemExit("the worker is lost")  # no provider's failure: the task fails
        return self.reply(prompt)

    @property
    def calls(self):
        return open(self.log).read().splitlines() if os.path.exists(self.log) else []


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, p string")


def test_nothing_is_asked_twice(spark, tmp_path):
    model = Counted(lambda p: None if p == "mute" else p.upper(), tmp_path / "log")
    rows = prompts(spark, ["a", "b", "a", None, "mute", ""])
    got = {x.id: (x.answer, x.model) for x in C.ask_once(rows, ["id"], "p", [("m", model)], f"{tmp_path}/answers", tries=1).collect()}
    assert got == {0: ("A", "m"), 1: ("B", "m"), 2: ("A", "m"), 3: (None, "none"), 4: (None, "none"), 5: (None, "none")}
    assert sorted(model.calls) == sorted(map(repr, ["a", "b", "mute", ""]))
    more = prompts(spark, ["b", "c", "a"])
    assert [x.answer for x in C.ask_once(more, ["id"], "p", [("m", model)], f"{tmp_path}/answers", tries=1).orderBy("id").collect()] == ["B", "C", "A"]
    assert len(model.calls) == 5 and repr("c") in model.calls


def test_a_stopped_run_goes_on(spark, tmp_path):
    model = Counted(str.upper, tmp_path / "log", breaks="t7")
    rows, folder = prompts(spark, [f"t{i}" for i in range(30)]), f"{tmp_path}/answers"
    with pytest.raises(Exception):  # noqa: B017
        C.ask_once(rows, ["id"], "p", [("m", model)], folder, at_a_time=5, tries=1).collect()
    kept = {x.answer.lower() for x in C.answers(spark, folder).collect()}
    open(tmp_path / "log.mended", "w").close()
    before = len(model.calls)
    assert [x.answer for x in C.ask_once(rows, ["id"], "p", [("m", model)], folder, at_a_time=5, tries=1).orderBy("id").collect()] == [f"T{i}" for i in range(30)]
    again = [eval(x) for x in model.calls[before:]]
    assert len(again) == 30 - len(kept) and not kept & set(again)  # no committed answer is asked for again


def test_many_prompts_take_no_more_jobs_than_few(spark, tmp_path):
    """All are read and asked once, and not once a round."""

    def jobs(n):
        group = f"asked {n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            got = C.ask_once(prompts(spark, [f"t{i}" for i in range(n)]), ["id"], "p", [("m", str.upper)], f"{tmp_path}/{n}", at_a_time=4, tries=1)
            assert {(x.id, x.answer, x.model) for x in got.collect()} == {(i, f"T{i}", "m") for i in range(n)}
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setJobGroup("", "")

    assert jobs(60) <= jobs(4) + 2  # adaptive plans may differ by a stage or two; 15 rounds were 14 jobs more


def test_tasks_that_ended_keep_their_answers(spark, tmp_path):
    """A stopped job loses the calls of the tasks that were running, here of four with one call or a few each."""

    class Tires(Counted):
        def __call__(self, prompt):
            if len(self.calls) >= 40 and not os.path.exists(self.log + ".mended"):
                raise SystemExit("the worker is lost")
            return super().__call__(prompt)

    model, folder = Tires(str.upper, tmp_path / "log"), f"{tmp_path}/answers"
    rows = prompts(spark, [f"t{i}" for i in range(60)])
    with pytest.raises(Exception):  # noqa: B017
        C.ask_once(rows, ["id"], "p", [("m", model)], folder, at_a_time=4, tries=1).collect()
    kept = {x.answer.lower() for x in C.answers(spark, folder).collect()}
    assert len(kept) >= 20
    open(tmp_path / "log.mended", "w").close()
    before = len(model.calls)
    got = C.ask_once(rows, ["id"], "p", [("m", model)], folder, at_a_time=4, tries=1).collect()
    assert {(x.id, x.answer) for x in got} == {(i, f"T{i}") for i in range(60)}
    again = [eval(x) for x in model.calls[before:]]
    assert len(again) == 60 - len(kept) and not kept & set(again)


MEMBERS = "cluster long, module long, seen int, t string, score double"


def test_refining_within_a_budget(spark, tmp_path):
    model = Counted(lambda p: "Verdict: DIFFERENT\nConfidence: 90" if "other" in p else "Verdict: SIMILAR", tmp_path / "log")
    rows = [(c, None if c > 3 else 1, s, "other" if s == 2 else "same", [1.0, 0.9, 0.7, 0.6][s - 1] if c != 2 else 0.7) for c in range(1, 6) for s in range(1, 5)]
    got = {(x.cluster, x.seen): (x.in_budget, x.asked, x.stays) for x in C.refined(spark.createDataFrame(rows, MEMBERS), ["module"], ["seen"], "t", "score", [("m", model)], f"{tmp_path}/a", budget=5, tries=1).collect()}
    assert all(got[c, 1] == (False, False, True) for c in range(1, 6))  # a representative is never judged
    assert [got[1, s] for s in (2, 3, 4)] == [(True, False, True), (True, True, True), (True, False, False)]
    assert [got[2, s] for s in (2, 3, 4)] == [(True, True, False), (True, True, True), (False, False, True)]  # the sixth stays
    assert [got[3, s] for s in (2, 3, 4)] == [(False, False, True)] * 3
    assert got[4, 4] == (True, False, False) and got[5, 4] == (False, False, True)  # clusters of no module have their own budget
    assert len(model.calls) == 2  # equal pairs are one call


def test_confirmation(spark, tmp_path):
    def judge(p):
        return {"down": None, "unsure": "Same: YES\nConfidence: 79", "no": "Same: NO\nConfidence: 99"}.get(p.rsplit("B: ", 1)[1], "Same: YES\nConfidence: 0.8")

    clusters = [["x", "y"], ["x", "y", "no"], ["x", "unsure"], ["x", "down"], ["x"], ["x", "no", "z"]]
    rows = [(c, 1, s, t, 1.0) for c, ts in enumerate(clusters) for s, t in enumerate(ts, 1)]
    got = {x.cluster: (x.members, x.asked, x.confirmed) for x in C.confirmed(spark.createDataFrame(rows, MEMBERS), ["module"], ["seen"], "t", [("m", judge)], f"{tmp_path}/a", budget=5, tries=1).collect()}
    assert got == {0: (2, 1, True), 1: (3, 2, False), 2: (2, 1, False), 3: (2, 1, True), 4: (1, 0, True), 5: (3, 0, True)}


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('["ab cd", "xy", "long enough label"]', ["ab cd", None, "long enough label"]), ('Sure!\n["one label"]\nbye', ["one label", None, None]), ("no list", [None] * 3), ('["open', [None] * 3), (None, [None] * 3),
        ('["first", null, "' + "z" * 80 + '", "too many"]', ["first", None, None]), ("[1, 2", [None] * 3), ("[]", [None] * 3),
    ],
)
def test_lists_in_one_call(spark, tmp_path, reply, want):
    model = Counted(lambda p: reply, tmp_path / "log")
    topics = spark.createDataFrame([(i, None, f"topic {i}") for i in range(3)], "i int, module int, name string").selectExpr("*", "1 AS reply2", "2 AS h")
    got = C.topic_labels(topics, ["module"], ["i"], "name", [("m", model)], f"{tmp_path}/a", tries=1).orderBy("i").collect()
    assert [x.label for x in got] == [w or f"topic {i}" for i, w in enumerate(want)]
    assert len(model.calls) == 1


def test_long_groups_are_many_lists(spark, tmp_path):
    model = Counted(lambda p: "[" + ",".join('"label of ' + x.split(". ")[1] + '"' for x in p.split("\n\nReturn")[0].split("\n")[1:]) + "]", tmp_path / "log")
    rows = spark.createDataFrame([(i, f"text {i} " + "y" * 900) for i in range(100)], "i int, t string")
    got = C.cleaned_questions(rows.withColumn("g", F.lit(None).cast("int")), ["g"], ["i"], "t", [("m", model)], f"{tmp_path}/a", tries=1).orderBy("i").collect()
    assert [x.cleaned for x in got] == [f"label of text {i} " + "y" * (350 - len(f"text {i} ")) for i in range(100)]
    assert len(model.calls) == 9 and max(map(len, model.calls)) < 13 * 350 + 400


def test_pages_come_back_by_position(spark, tmp_path):
    def scribe(p):
        pages = p.split("\n\n", 1)[1]
        return None if "down" in pages else pages.replace("bad", "good").rsplit("=== PAGE", 1)[0] if "lost" in pages else pages.replace("bad", "good") + ("===  Page Separator ===more" if "extra" in pages else "")

    papers = {1: ["bad one", "bad two"], 2: ["bad", "lost"], 3: ["down", "bad"], 4: ["extra", "bad"], 5: ["bad " + "w" * 60, "bad " * 10, None], 6: [None]}
    rows = [(p, i, t) for p, ts in papers.items() for i, t in enumerate(ts, 1)]
    model = Counted(scribe, tmp_path / "log")
    got = {(x.paper, x.page): (x.cleaned, x.model) for x in C.cleaned_pages(spark.createDataFrame(rows, "paper int, page int, t string"), "paper", "page", "t", [("m", model)], f"{tmp_path}/a", most_chars=60, tries=1).collect()}
    assert [got[k][0] for k in ((1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (4, 2))] == ["good one", "good two", "good", "", "down", "bad", "extra", "good"]
    assert got[3, 1][1] == "none" and got[5, 1][0] == "good " + "w" * 60 and got[5, 2][0] == ("good " * 10).strip() and got[5, 3][0] == "" and got[6, 1][0] == ""
    assert len(model.calls) == 7  # paper 5 took two


def test_labels_of_clusters(spark, tmp_path):
    model = Counted(lambda p: "" if "mute" in p else f" topic of {p.count(chr(10))} ", tmp_path / "log")
    rows = [(c, i, ("mute" if c == 2 else "q") + "x" * 500) for c in (1, 2, 3) for i in range(c * 3)]
    got = {x.c: x.label for x in C.cluster_labels(spark.createDataFrame(rows, "c int, i int, t string"), "c", ["i"], "t", F.concat(F.lit("Module "), F.col("c")), [("m", model)], f"{tmp_path}/a", tries=1).collect()}
    assert got == {1: "topic of 3", 2: "Module 2", 3: "topic of 5"} and max(map(len, model.calls)) < 5 * 210 + 200


# rules and table functions -------------------------------------------------------------------


def test_rules_are_compiled_repaired_or_refused(spark, tmp_path):
    replies = {
        "good": ["marks > 5"], "fenced": ["```sql\nlower(question_text) LIKE '%map%'\n```"], "mended": ["length(question_text)", "length(question_text) > 3"], "call": ["java_method('java.lang.Runtime', 'x') = 'a'", "reflect('x') = 1"],
        "column": ["no_such > 1", "no_such > 2"], "query": ["(SELECT max(1)) > 0", "exists(keywords, x -> x = 'a')"], "two": ["true; drop table x", "true -- x"], "mute": [None],
    }

    def writer(p):
        return replies[p.split("Rule: ")[1].split("\n")[0]][R.REPAIR in p] if len(replies[p.split("Rule: ")[1].split("\n")[0]]) > (R.REPAIR in p) else None

    model = Counted(writer, tmp_path / "log")
    wanted = spark.createDataFrame([(k, "keyword", k) for k in replies], "rule_id string, kind string, words string")
    found = R.compile_rules(wanted, [("m", model)], f"{tmp_path}/a", tries=1)
    got = {r.rule_id: (r.expression, r.tries) for r in found.collect()}
    assert got == {
        "good": ("marks > 5", 1), "fenced": ("lower(question_text) LIKE '%map%'", 1), "mended": ("length(question_text) > 3", 2), "call": (None, 2), "column": (None, 2),
        "query": ("exists(keywords, x -> x = 'a')", 2), "two": (None, 2), "mute": (None, 2),
    }
    assert all((r.error is None) == (r.expression is not None) for r in found.collect())
    calls = len(model.calls)
    assert calls == len(replies) + 6  # one repair each of those that can't be used
    R.compile_rules(wanted.where("rule_id != 'mute'"), [("m", model)], f"{tmp_path}/a", tries=1)
    assert len(model.calls) == calls  # all of these are remembered
    questions = spark.createDataFrame([("A flood map", ["a"], 9), ("no", [], None)], R.SCHEMA)
    results = [r.results for r in R.execute_all(questions, R.compiled(found)).collect()]
    assert results == [{"fenced": True, "good": True, "mended": True, "query": True}, {"fenced": False, "mended": False, "query": False}]


def test_segmenter_in_sql(spark):
    papers = {1: "PART A\n1. Define the flood hazard (3 marks)\n2. State its kinds\nPART B\nModule 1\n11. Discuss all of that (7 marks)", 2: "", 3: "1. Explain this question here"}
    table = spark.createDataFrame([(p, i, x) for p, t in papers.items() for i, x in enumerate(t.split("\n"))] + [(4, 0, None)], "paper_id long, page int, text string")
    table_functions.register(spark)
    names = [x.split()[0] for x in segment.SCHEMA.split(", ")]
    got = spark.sql("SELECT * FROM segment_pages(TABLE ({t}))".replace("({t})", "(SELECT * FROM {t})"), t=table)
    want = segment.segment(spark.createDataFrame(list(papers.items()), "paper_id long, text string"))
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect())) and got.count() >= 4
    with pytest.raises(Exception, match="not there: text"):
        spark.sql("SELECT * FROM segment_pages(TABLE (SELECT paper_id, page FROM {t}))", t=table).collect()
    joined = spark.sql("SELECT pages, text FROM segment_pages(TABLE (SELECT * FROM {t} WHERE paper_id = 3), joint => ' ')", t=table).collect()
    assert [(x.pages, x.text) for x in joined] == [(1, "Explain this question here")]


def test_files_that_nothing_reads_are_rows(spark):
    def layer(data):
        if not data.startswith(b"%"):
            raise ValueError("no PDF")
        return [(p, 1.0) for p in data.decode()[1:].split("\f")]

    rows = [("a", b"%first page\fsecond page"), ("b", b"%x"), ("c", b"zzz"), ("d", None), ("e", b"")]
    pages = files.extract_pages(spark.createDataFrame(rows, "path string, content binary"), [("layer", layer), ("none", lambda d: [])], least_chars=5)
    assert {(r.path, r.page_number, r.text) for r in pages.collect()} == {("a", 1, "first page"), ("a", 2, "second page"), *((p, 0, None) for p in "bcde")}
    assert {r.path: r.reason for r in files.failed(pages).collect()}["c"] == "failed (layer: ValueError, none: 0 characters)"
    assert {r.path: (r.text, r.page_count) for r in files.papers_text(pages).collect()} == {"a": ("first page\n\nsecond page", 2), **{p: ("", 0) for p in "bcde"}}
    with pytest.raises(ValueError, match="no text in"):
        files.required(pages)
    assert files.required(pages.where("path = 'a'")).count() == 2


def test_batches_of_files_are_bounded_by_bytes(spark):
    """Small files come many at a time, large ones few; a smaller setting stays."""
    import pyarrow as pa

    from gradloom.workers import batches_of

    def sizes(length, *limits):
        rows = spark.range(0, 200, 1, 1).selectExpr(f"cast(repeat('x', {length}) as binary) AS c")
        with batches_of(spark, *limits):
            return [r.n for r in rows.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()]

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    assert sizes(10, files.FILES_A_BATCH, files.BYTES_A_BATCH) == [200]
    assert max(sizes(1 << 20, files.FILES_A_BATCH, files.BYTES_A_BATCH)) <= 5
    spark.conf.set(key, "1m")
    try:
        assert max(sizes(1 << 20, files.FILES_A_BATCH, files.BYTES_A_BATCH)) <= 2
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
