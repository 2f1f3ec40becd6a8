"""Replacing tables, topic analysis, extraction by format and linkage with ties."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.operators import clusters as K
from gradloom.operators import density, formats, topics
from gradloom.operators.plugins import hashing_embedder
from gradloom.sources import versions

ROWS = [(1, None, "a"), (1, 2, "b"), (2, None, "c"), (None, 1, "d")]
SCHEMA = "subject long, module int, x string"


def held(spark, folder):
    return sorted((str(x.subject), str(x.module), x.x) for x in versions.read(spark, folder, ["subject"]).collect())


# replacing ----------------------------------------------------------------------------------


def test_refresh_replaces_keys_as_a_whole(spark, tmp_path):
    folder, rows = f"{tmp_path}/t", spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError):
        versions.read(spark, folder, ["subject"])
    assert versions.refresh(rows, folder, ["subject"]) == 1
    before = versions.read(spark, folder, ["subject"])
    new = spark.createDataFrame([(1, 9, "new"), (None, 9, "null")], SCHEMA)
    assert versions.refresh(new, folder, ["subject"]) == 2
    assert held(spark, folder) == [("1", "9", "new"), ("2", "None", "c"), ("None", "9", "null")]
    assert before.count() == 4 and versions.read(spark, folder, ["subject"], at=1).count() == 4  # a reader that began before
    # an empty new result leaves nothing of the key, null included
    versions.refresh(new.where("false"), folder, ["subject"], rows.where("subject = 1 OR subject IS NULL"))
    assert held(spark, folder) == [("2", "None", "c")]
    gone = versions.vacuum(spark, folder)
    assert "commits/000000000001" in gone and held(spark, folder) == [("2", "None", "c")]
    with pytest.raises(ValueError, match="aren't to be replaced"):
        versions.refresh(rows, folder, ["subject"], rows.where("subject = 1"))
    assert held(spark, folder) == [("2", "None", "c")]


def test_writer_that_stops_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    folder, rows = f"{tmp_path}/t", spark.createDataFrame(ROWS, SCHEMA)
    versions.refresh(rows, folder, ["subject"])
    want = held(spark, folder)

    @F.udf("string")
    def fails(x):
        raise RuntimeError("executor lost")

    with pytest.raises(Exception, match="executor lost"):  # while rows are written
        versions.refresh(rows.withColumn("x", fails("x")), folder, ["subject"])
    assert held(spark, folder) == want

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "_create", killed)  # all is written, the commit isn't
    with pytest.raises(KeyboardInterrupt):
        versions.refresh(rows.withColumn("x", F.lit("half")), folder, ["subject"])
    monkeypatch.undo()
    assert held(spark, folder) == want
    versions.refresh(rows.withColumn("x", F.lit("whole")), folder, ["subject"])
    assert {x for _, _, x in held(spark, folder)} == {"whole"}


def test_two_writers_keep_each_others_keys(spark, tmp_path, monkeypatch):
    folder, rows = f"{tmp_path}/t", spark.createDataFrame(ROWS, SCHEMA)
    versions.refresh(rows, folder, ["subject"])
    real, others = versions._create, []

    def late(s, f, number, name):
        if not others:  # another writer commits first
            others.append(1)
            versions.refresh(rows.where("subject = 2").withColumn("x", F.lit("other")), folder, ["subject"])
        return real(s, f, number, name)

    monkeypatch.setattr(versions, "_create", late)
    assert versions.refresh(rows.where("subject = 1").withColumn("x", F.lit("mine")), folder, ["subject"]) == 3
    assert held(spark, folder) == [("1", "2", "mine"), ("1", "None", "mine"), ("2", "None", "other"), ("None", "1", "d")]


# linkage ------------------------------------------------------------------------------------


def brute_linkage(v, weight, distance):
    """Merges the nearest pair of clusters, of equally near ones the first; means are over all pairs of rows, with weights."""
    u = v / np.where((n := np.linalg.norm(v, axis=1)) == 0, 1, n)[:, None]
    s, parts = u @ u.T, {i: [i] for i in range(len(v))}
    while True:
        best = None
        for i, j in itertools.combinations(sorted(parts), 2):
            a, b = parts[i], parts[j]
            w = np.outer(weight[a], weight[b])
            mean = 1 - float((w * s[np.ix_(a, b)]).sum() / w.sum())
            if mean < distance and (best is None or mean < best[0] - 1e-12):
                best = (mean, i, j)
        if best is None:
            return {frozenset(p) for p in parts.values()}
        parts[best[1]] += parts.pop(best[2])


def test_weighted_linkage_with_ties():
    g = np.random.default_rng(7)
    for trial in range(150):
        n = int(g.integers(1, 12))
        v = np.unique(g.integers(0, 2, size=(n, 4)).astype(float), axis=0)  # of ones and zeros: ties everywhere
        g.shuffle(v)
        weight = g.integers(1, 4, size=len(v)).astype(float)
        for distance in (0.2, 0.45, 0.7):
            owner = K.average_linkage(v, distance, weight)
            assert {frozenset(np.flatnonzero(owner == o).tolist()) for o in set(owner.tolist())} == brute_linkage(v, weight, distance), trial


def test_weights_stand_for_copies():
    g = np.random.default_rng(8)
    v = g.normal(size=(12, 3))
    times = g.integers(1, 4, size=12)
    for distance in (0.2, 0.5, 0.9):
        one, all_ = K.average_linkage(v, distance, times.astype(float)), K.average_linkage(np.repeat(v, times, axis=0), distance)
        starts = np.cumsum(times) - times
        assert [one[i] == one[j] for i in range(12) for j in range(12)] == [all_[starts[i]] == all_[starts[j]] for i in range(12) for j in range(12)]


def test_phrase_clusters_depend_on_phrases_alone(spark):
    r = random.Random(5)
    words = ["flood", "risk", "hazard", "map", "plan"]
    rows = [(i, r.choice([None, 1, 2]), " ".join(sorted(r.sample(words, r.randint(0, 3)))) or None) for i in range(120)]

    def run(rows):
        out = K.phrase_clusters(spark.createDataFrame(rows, "q long, m int, p string"), "p", ["m"], ["q"], 0.55).collect()
        groups = {}
        for x in out:
            groups.setdefault(x.cluster, []).append(x)
        assert len(out) == len(rows) and all(sorted(x.seen for x in g) == list(range(1, len(g) + 1)) and len({x.m for x in g}) == 1 for g in groups.values())
        return {frozenset((x.m, x.p) for x in g) for g in groups.values()}

    once = run(rows)
    shuffled = rows[:]
    r.shuffle(shuffled)
    assert run([(i, m, p) for i, (_, m, p) in enumerate(shuffled)]) == once
    ids = spark.createDataFrame(rows, "q long, m int, p string").select("m", F.coalesce("p", F.lit("")).alias("p"), F.xxhash64(F.to_json(F.struct("m")), F.coalesce("p", F.lit(""))).alias("id")).groupBy("m", "p", "id").count().orderBy("id").collect()
    for m in (None, 1, 2):  # against the rule, all phrases of a bucket at once
        mine = [x for x in ids if x.m == m]
        far = {frozenset(mine[i].p for i in c) for c in brute_linkage(hashing_embedder()([x.p for x in mine]), np.array([float(x["count"]) for x in mine]), 0.45)}
        assert {frozenset(p or "" for _, p in c) for c in once if next(iter(c))[0] == m} == far


# topics -------------------------------------------------------------------------------------

QUESTIONS = "subject_id long, module_number int, qtext string, exam_year string, marks int, part string, n int"


def test_subject_analysis(spark, tmp_path):
    ask = [("Explain the flood hazard map (3 marks)", "A"), ("Describe flood hazard map in detail", "B"), ("Define stakeholder participation", "A")]
    rows = [(s, m, q, str(2018 + y), 3, part, y * 10 + i) for s in (1, 2) for m in (1, None) for y in range(4) for i, (q, part) in enumerate(ask)]
    rows.append((2, None, None, "", None, None, 99))
    questions, folder = spark.createDataFrame(rows, QUESTIONS), f"{tmp_path}/topics"
    topics.refresh_subjects(questions, folder, questions.select("subject_id"), ["n"])
    got = topics.topics_of(spark, folder).collect()
    assert sum(x.question_count for x in got) == len(rows)
    for s, m in ((1, 1), (1, None), (2, 1), (2, None)):
        mine = [x for x in got if (x.subject_id, x.module_number) == (s, m)]
        top = max(mine, key=lambda x: (x.question_count, x.topic_name))
        assert top.frequency == 4 and top.priority_tier == 1 and "2018" in top.years
        assert sum(x.question_count for x in mine) == 12 + (s == 2 and m is None)
    topics.refresh_subjects(questions.where("subject_id = 1"), folder, questions.select("subject_id").where("subject_id = 2"), ["n"])
    assert {x.subject_id for x in topics.topics_of(spark, folder).collect()} == {1}  # subject 2 had no questions any more
    assert topics.topics_of(spark, folder, at=1).count() == len(got)


def test_equal_texts_are_analysed_once(spark):
    """Totals of clusters come from distinct texts, each with its count, and are those of all rows."""
    from gradloom.operators.stats import question_texts, text_clusters, topic_clusters

    r = random.Random(3)
    words = [None, "", "Explain the flood hazard map (3 marks)", "Describe flood hazard map in detail", "Define stakeholder participation"]
    rows = [(r.choice([1, None]), r.choice([1, 2, None]), r.choice(words), r.choice([None, "", "2019", "2020", "2021"]), r.choice([None, 3, 14]), r.choice(["A", "B", None]), i) for i in range(400)]
    questions = spark.createDataFrame(rows, QUESTIONS)
    texts = question_texts(questions, topics.BY, ["n"]).cache()
    assert texts.count() == len({(s, m, q) for s, m, q, *_ in rows})
    want, got = topic_clusters(questions, [*topics.BY, "qtext"]), text_clusters(texts, [*topics.BY, "qtext"])
    assert got.select(want.columns).schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    firsts = {(x.subject_id, x.module_number, x.qtext): x["first"].n for x in texts.collect()}
    assert all(firsts[s, m, q] == min(x[6] for x in rows if x[:3] == (s, m, q)) for s, m, q, *_ in rows)
    clusters, members = topics.analyze(questions, ["n"])
    members = members.collect()
    assert sorted(x.n for x in members) == list(range(400))
    firsts = {x.cluster: x.qtext for x in members if x.seen == 1}
    assert {x.cluster: x.representative_text for x in clusters.collect()} == firsts


# extraction ---------------------------------------------------------------------------------


def found(spark, text):
    out = formats.questions_by_format(spark.createDataFrame([(1, text)], "paper_id long, text string")).orderBy("pos").collect()
    return [(x.question_number, x.text, x.marks) for x in out], {x.layout for x in out}


PART_A = "PART A\n" + "\n".join(f"Explain topic number {chr(97 + i)} in short 3" for i in range(10)) + "\n"


def test_vote_of_the_layout(spark):
    hits = [f"{n} a) First half of question {n}x b) Second half of it here 7" for n in range(11, 21)]
    both, layout = found(spark, PART_A + "PART B\n" + "\n".join(hits))
    assert layout == {"numbered"} and both[10] == ("11", "First half of question 11x OR Second half of it here", 14) and len(both) == 20
    below = "Module -1\na) Taken from the module heading\nb) and its second part here\n"
    few, layout = found(spark, PART_A + "PART B\n" + below + "\n".join(hits[:6]))  # six hits are too few
    assert layout == {"modules+loose"} and few[10][1].startswith("Taken from the module heading OR and its second part here")
    assert [q[0] for q in few[10:]][:2] == ["11", "12"]


def test_misread_numbers_and_orphans(spark):
    hits = ["I I a) The first one is misread", "l2 a) This is no number at all, as before", "1 1 a) digits apart are a number", *[f"{n} a) Question of number {n} is long" for n in range(13, 21)], "99 a) Not a number of Part B"]
    got, layout = found(spark, PART_A + "PART 8\n" + "\n".join(hits))
    assert layout == {"numbered"} and [q[0] for q in got[10:]] == ["11", "11", *map(str, range(13, 21))]
    got, _ = found(spark, PART_A + "PART B\nModule - 1\nb) orphan of no question\na) short\nb) follows a short one\na) long enough to be asked\nstill the same part\n2019\nModule - 2\na) another one stands here\nMarks\n")
    assert [q[1] for q in got[10:]] == ["long enough to be asked still the same part", "another one stands here"]


@pytest.mark.parametrize("text", [None, "", "\n", "PART A\n", "PART B\n", "PART A\nPART B\nModule -1", "x" * 300_000, "a) " * 20_000, "PART B\n" + "11 a) " * 5000])
def test_odd_papers(spark, text):
    found(spark, text)
    assert formats.questions_by_line(spark.createDataFrame([(1, text)], "paper_id long, text string")).count() <= 1


def brute_lines(text, taken):
    out, now = {}, None
    for line in [*(x.strip() for x in text.split("\n")), None]:
        start = line is not None and re.match(r"(\d{1,2})\s*[.)\]:\s]+(.*)$", line)
        if line is None or (start and 1 <= int(start[1]) <= 20):
            if now and now[0] not in taken and now[0] not in out and len(now[1]) >= 10:
                out[now[0]] = now[1]
            now = (start[1], start[2].strip()) if start else None
        elif now and len(line) > 3 and not any(re.match(p, line) for p in formats.NOT_MORE):
            now = (now[0], now[1] + " " + line)
    return list(out.items())


def test_lines_equal_brute_force(spark):
    r = random.Random(9)
    some = ["1. Define it", "2) What is that thing", "3 : short", "21. no start here", "0. none", "PART B", "Page 3", "12", "ab", "goes on with more words", "  and more ", "", "3] again with a longer text", "CSE301 code", "time is up", "07. zero seven is a number"]
    papers = [(i, "\n".join(r.choice(some) for _ in range(r.randint(0, 25))), r.choice([None, ["1"], ["2", "3"]])) for i in range(150)]
    got = {}
    for x in formats.questions_by_line(spark.createDataFrame(papers, "paper_id long, text string, known array<string>"), existing="known").orderBy("paper_id", "pos").collect():
        got.setdefault(x.paper_id, []).append((x.question_number, x.text))
    for i, text, known in papers:
        assert got.get(i, []) == brute_lines(text, known or ()), i


# density ------------------------------------------------------------------------------------


def brute_density(v, k=2, least=2):
    """From the largest distance down, by components of the whole graph below each distance: sets of keys that stand."""
    n, norm = len(v), np.linalg.norm(v, axis=1)
    u = v / np.where(norm == 0, 1, norm)[:, None]
    d = np.maximum(np.round(1 - u @ u.T, 12), 1e-12)
    core = np.array([np.sort(np.delete(d[i], i))[min(k, n - 1) - 1] for i in range(n)])
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    levels = sorted(set(m[np.triu_indices(n, 1)]), reverse=True)

    def parts(keys, below):
        keys, out = set(keys), []
        while keys:
            todo = [keys.pop()]
            part = set(todo)
            while todo:
                x = todo.pop()
                near = {y for y in keys if m[x, y] < below}
                keys -= near
                part |= near
                todo += near
            out.append(frozenset(part))
        return out

    def cluster(keys, birth, at):
        mass, now = 0.0, keys
        while True:
            density, inner = 1 / levels[at], parts(now, levels[at])
            big = [p for p in inner if len(p) >= least]
            at += 1
            if len(big) == 1:
                mass += (len(now) - len(big[0])) * (density - birth)
                now = big[0]
                continue
            mass += len(now) * (density - birth)
            below = [cluster(p, density, at) for p in big]
            total = sum(x for x, _ in below)
            return (total, [c for _, cs in below for c in cs]) if total > mass * (1 + 1e-12) else (mass, [keys])

    now = frozenset(range(n))
    for at, level in enumerate(levels):
        big = [p for p in parts(now, level) if len(p) >= least]
        if len(big) != 1:
            return {c for p in big for c in cluster(p, 1 / level, at + 1)[1]}
        now = big[0]
    return set()


def some_vectors(trial, g):
    n = int(g.integers(3, 28))
    v = g.normal(size=(n, 3)) if trial % 3 else np.repeat(g.normal(size=(4, 3)), 8, axis=0)[:n] + g.normal(size=(n, 3)) * 0.05
    v = np.vstack([v, v[: n // 3]]) if trial % 5 == 0 else v
    return g.integers(0, 2, size=(n, 3)).astype(float) if trial % 7 == 0 else v


def test_excess_of_mass_by_its_definition():
    g = np.random.default_rng(1)
    for trial in range(90):
        v = some_vectors(trial, g)
        norm = np.linalg.norm(v, axis=1)
        u = v / np.where(norm == 0, 1, norm)[:, None]
        core = np.array([np.sort(np.delete(density._far(u, i), i))[min(2, len(v) - 1) - 1] for i in range(len(v))])
        a, b, w = map(np.array, zip(*density.spanning_tree(u, core, np.arange(len(v))), strict=True))
        got = {}
        for key, c in density.excess_of_mass(a, b, w).items():
            got.setdefault(c, set()).add(key)
        assert {frozenset(x) for x in got.values()} == brute_density(v), trial
        assert all(min(x) == c for c, x in got.items())


def test_density_clusters_over_blocks(spark):
    g = np.random.default_rng(3)
    centres = g.normal(size=(12, 6))
    v = np.vstack([np.repeat(centres, 20, axis=0) + g.normal(size=(240, 6)) * 0.15, g.normal(size=(60, 6))])  # 300 points
    rows = [(i, 1 if i % 4 else None, x.tolist()) for i, x in enumerate(v)] + [(1000, 7, [1.0] * 6), (1001, 8, None)]
    df = spark.createDataFrame(rows, "id long, b int, v array<double>").selectExpr("*", "1 AS place", "2 AS own")
    got = density.density_clusters(df, "id", "v", ("b",), block=40).collect()  # six blocks and two: rounds of joins
    assert len(got) == 301 and {x.id: (x.noise, x.frequency, x.tier, x.cluster) for x in got}[1000] == (True, 1, 4, 1000)
    for b in (1, None):
        ids = np.array([i for i, x, _ in rows[:300] if x == b])
        found = {}
        for x in got:
            if x.b == b and not x.noise:
                found.setdefault(x.cluster, set()).add(x.id)
        assert {frozenset(c) for c in found.values()} == {frozenset(ids[list(c)].tolist()) for c in brute_density(v[ids])}
        assert all(x.frequency == len(found[x.cluster]) and x.tier == {1: 4, 2: 3, 3: 2}.get(x.frequency, 1) for x in got if x.b == b and not x.noise)


def test_a_paper_is_walked_once_for_each_pattern(spark):
    """Not once for each group of a pattern: long papers cost what their walks cost."""
    import re

    plan = formats.questions_by_format(spark.createDataFrame([(1, "PART A")], "paper_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (formats.HIT, *formats.NUMBERED_LINES, formats.PARTS):
        groups = re.findall(r"regexp_extract_all\([^,]*, " + re.escape(pattern) + r", (\d)\)", plan)
        assert len(groups) == 1, pattern
    assert r"[\s\S]*?" not in plan


def test_sections_are_cut_where_the_next_number_stands(spark):
    text = "PART A\nMarks\nState the causes of floods Marks \n\nPART B\nx\n" + "\n \n".join(f"{n} a)Discuss the rule number {n}  7\n b) Compare {n} with\tthe others 7" for n in ("I I", 12, 13, 14, 15, 16, 17, 18))
    out = formats.questions_by_format(spark.createDataFrame([(1, text), (2, None)], "paper_id long, text string")).orderBy("pos").collect()
    got = [(x.question_number, x.text) for x in out if x.marks == 14]
    assert got == [(str(n), f"Discuss the rule number {w} OR Compare {w} with the others") for n, w in ((11, "I I"), (12, 12), (13, 13), (14, 14), (15, 15), (16, 16), (17, 17), (18, 18))]
    assert [(x.question_number, x.text) for x in out if x.marks == 3] == [("1", "State the causes of floods")] and {x.paper_id for x in out} == {1}
