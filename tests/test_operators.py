"""Clustering, similarity, streams, sources and the guard around the llm folder."""

import collections
import random
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from gradloom.operators import clusters as K
from gradloom.operators import plugins
from gradloom.operators.graph import components
from gradloom.operators.similarity import shared_token_pairs, similar_links, similar_pairs, token_links
from gradloom.sources import files
from gradloom.streaming import ingest


def test_extractors(spark):
    from gradloom.operators import extract as X

    text = """PART A
(Answer all questions)
I What is meant by a natural disaster? 3
2 Define the term hazard with one example 3
3 List the phases of disaster management 3
4 State the role of the community 3
5 Explain the risk map of a region 3
l2 Ignored because its number is too high
PART B
Module II
13 a) Explain the early warning system in detail 8
13 b) Describe the role of the district authority 14
Module IV
17 a) Discuss the hazards of coastal flooding"""
    papers = spark.createDataFrame([(1, text), (2, "1) Explain everything about floods (5 marks)\nPage 3\n11 Describe the recovery phase\nof a disaster 9"), (3, ""), (4, None)], "paper_id long, text string")
    got = [(r.paper_id, r.question_number, r.marks, r.part, r.module_hint) for r in X.extract_questions(papers).orderBy("paper_id", "pos").collect()]
    assert got[:8] == [(1, str(n), 3, "A", None) for n in range(1, 6)] + [(1, n, 7, "B", m) for n, m in (("13a", 2), ("13b", 2), ("17a", 4))]  # its texts hold no digits, so marks never show
    assert got[8:] == [(2, "1", 3, "A", None), (2, "11", 9, "B", None)]
    lines = spark.createDataFrame([("Q1. Define risk (3 marks)",), ("11(a) Explain the plan (8 marks)",), ("no marks",)], "line string")
    assert sorted((r.question_number, r.sub_part or "", r.text, r.marks, r.part) for r in X.marked_lines(lines, "line").collect()) == [(1, "", "Define risk", 3, "A"), (11, "a", "Explain the plan", 8, "B")]


def test_components(spark):
    r = random.Random(0)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500, 500 + i) for i in range(1, 60)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocked_pairs_and_clusters(spark):
    g = np.random.default_rng(1)
    v = g.normal(size=(120, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, v array<double>, b int")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 3 == j % 3 and s[i, j] >= 0.4}
    assert {(x.a, x.b) for x in similar_pairs(df, 0.4, "id", "v", ("b",), block=10).collect()} == want
    got = collections.defaultdict(set)
    for x in K.linkage_clusters(df, 0.5, "id", "v", ("b",)).collect():
        got[x.cluster].add(x.id)
    for b in range(3):
        ids = np.arange(b, 120, 3)
        owner = K.average_linkage(v[ids], 0.5)
        whole = {frozenset(ids[owner == o].tolist()) for o in set(owner.tolist()) if (owner == o).sum() > 1}
        assert {frozenset(c) for c in got.values() if next(iter(c)) % 3 == b} == whole


def test_links_connect_what_pairs_connect(spark):
    """A bucket in which nearly all pairs pass gives a link for each row of two blocks, and not a row for each pair."""
    g = np.random.default_rng(2)
    v = np.vstack([g.normal(size=(300, 8)) * 0.3 + np.eye(8)[0], g.normal(size=(80, 8)), np.zeros((1, 8))])
    df = spark.createDataFrame([(i * 7 % 1009, x.tolist(), i % 2) for i, x in enumerate(v)], "id long, v array<double>, b int").cache()
    for least in (0.5, 0.8):
        pairs, links = similar_pairs(df, least, "id", "v", ("b",)).select("a", "b"), similar_links(df, least, "id", "v", ("b",), block=64)
        assert {tuple(r) for r in components(links).collect()} == {tuple(r) for r in components(pairs).collect()}
        assert all(r.a < r.b for r in links.collect())
    assert similar_links(df, 0.5, "id", "v", ("b",)).count() <= 381 < similar_pairs(df, 0.5, "id", "v", ("b",)).count() / 20


def test_linkage_of_many_rows_is_done_in_few_rounds(monkeypatch):
    """Clusters that are each other's nearest are merged together: looks are counted by the searches for their places."""
    g, looked, search = np.random.default_rng(6), [], np.searchsorted
    monkeypatch.setattr(K.np, "searchsorted", lambda a, b: looked.append(len(b)) or search(a, b))
    v = np.repeat(g.normal(size=(400, 16)), 4, axis=0) + g.normal(size=(1600, 16)) * 0.05
    owner = K.average_linkage(v, 0.1)
    assert len(set(owner.tolist())) == 400 and 1600 <= sum(looked) < 3 * 1600 and len(looked) < 20


def brute_linkage(v, distance):
    """The two clusters of least mean distance are merged as long as it is below ``distance``."""
    u = v / np.where((n := np.linalg.norm(v, axis=1)) == 0, 1, n)[:, None]
    d, parts = 1 - u @ u.T, [[i] for i in range(len(v))]
    while len(parts) > 1:
        least, x, y = min((d[np.ix_(p, q)].mean(), x, y) for y, q in enumerate(parts) for x, p in enumerate(parts[:y]))
        if least >= distance:
            break
        parts[x] += parts.pop(y)
    return {frozenset(p) for p in parts}


def test_average_linkage_is_that_of_all_pairs():
    g = np.random.default_rng(4)
    for n, width in ((1, 3), (2, 3), (9, 2), (25, 3), (30, 6)):
        v = g.normal(size=(n, width))
        v = np.vstack([v, v[: n // 3]])  # copies
        v[0] = 0
        for distance in (0.05, 0.3, 0.75, 1.1):
            owner = K.average_linkage(v, distance)
            assert {frozenset(np.flatnonzero(owner == o).tolist()) for o in set(owner.tolist())} == brute_linkage(v, distance)
            assert all(owner[o] == o <= i for i, o in enumerate(owner))


def test_leaders(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.0, 1.0], 0), (3, [0.5, 0.5], 0), (4, [0.1, 0.9], 0)], "id long, v array<double>, m int")
    assert {x.id: x.leader for x in K.leader_clusters(df, 0.7, "id", "v", ("m",), ("id",)).collect()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 2}


def test_token_pairs(spark):
    r = random.Random(2)
    sets = [sorted({r.choice("abcdefghijkl") for _ in range(r.randint(1, 8))}) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, ts array<string>")
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.7}
    assert {(x.a, x.b) for x in shared_token_pairs(df, "id", "ts", 0.7).collect()} == want


def test_token_links(spark):
    r = random.Random(3)
    sets = [sorted({r.choice("abcdefghijkl") for _ in range(r.randint(1, 9))}) for _ in range(150)]
    base = [f"w{i}" for i in range(40)]
    sets += [sorted(set(base[: r.randint(12, 40)]) - set(r.sample(base, 2))) for _ in range(60)]
    score = lambda i, j: len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j]))
    df = spark.createDataFrame(list(enumerate(sets)), "id long, ts array<string>")
    rep = [sets.index(s) for s in sets]
    for least in (0.5, 0.8):
        want = {(rep[i], i): 1.0 for i in range(len(sets)) if rep[i] != i}
        want |= {(i, j): score(i, j) for i in set(rep) for j in set(rep) if i < j and score(i, j) >= least}
        got = token_links(df, "id", "ts", least).collect()
        assert len(got) == len(want) and {(x.a, x.b): x.score for x in got} == want


def test_token_links_of_copies(spark):
    """A thousand copies are a thousand rows and not every two of them."""
    df = spark.range(1000).selectExpr("id", "array('a', 'b', 'c', 'd', 'e') AS ts").union(spark.range(1000, 1001).selectExpr("id", "array('a', 'b', 'c', 'd') AS ts"))
    got = {(x.a, x.b): x.score for x in token_links(df, "id", "ts", 0.8).collect()}
    assert got == {(0, i): 1.0 for i in range(1, 1000)} | {(0, 1000): 0.8}


def test_rate_limit(spark, tmp_path):
    assert ingest.allow([0, 1, 2, 3, 4, 5, 3_600_004, 3_600_005], 0, 0)[0] == [True] * 5 + [False, True, True]
    rows = [(a, i, i * 700_000 + a) for a in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "address long, event_id long, at_ms long")
    batch = {(x.address, x.event_id): x.accepted for x in ingest.rate_limited_batch(df).collect()}
    df.write.parquet(f"{tmp_path}/in")
    stream = ingest.rate_limited(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(x.address, x.event_id): x.accepted for x in spark.read.parquet(f"{tmp_path}/out").collect()} == batch


def test_incremental_ingest(spark, tmp_path):
    seen = []
    for i in range(2):
        spark.range(i * 3, i * 3 + 3).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark, f"{tmp_path}/in", "id long", lambda df, n: seen.append(sorted(r.id for r in df.collect())), f"{tmp_path}/cp").awaitTermination()
    assert sorted(sum(seen, [])) == list(range(6)) and len(seen) == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n" + b"x" * 2048)
    (tmp_path / "b.txt").write_bytes("one\ftwo é".encode())
    up = files.uploads(spark, str(tmp_path))
    assert {r.name: r.verdict for r in up.collect()} == {"a.pdf": "Valid", "b.txt": "File must be a .pdf"}

    def broken(data):
        raise ValueError

    pages = files.extract_pages(up, [("broken", broken), ("text", files.plain_text)])
    got = {r.path.rsplit("/", 1)[1]: r for r in files.papers_text(pages).collect()}
    assert (got["b.txt"].text, got["b.txt"].page_count) == ("one\n\ntwo é", 2)


def test_plugins(spark):
    def fails(prompt):
        raise RuntimeError

    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, p string")
    assert [tuple(r) for r in plugins.ask(df, "id", "p", [("first", fails), ("second", lambda p: p.upper())], tries=2, wait=0).orderBy("id").collect()] == [(1, "X", "second"), (2, "Y", "second")]
    assert [tuple(r) for r in plugins.ask(df, "id", "p", [("first", fails)], tries=1).orderBy("id").collect()] == [(1, None, "none"), (2, None, "none")]
    v = plugins.encode(df, "id", "p").collect()
    assert abs(sum(x * x for x in v[0].embedding) - 1) < 1e-6


def test_entry_works_without_the_llm_folder():
    code = "import sys; sys.modules['gradloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 100


def test_keyword_leaders_take_what_is_like_them(spark):
    from gradloom.functions.vectors import keyword_similarity
    from gradloom.operators.clusters import keyword_leaders

    r = random.Random(2)
    rows = [(i % 2, i, r.sample("alpha beta gamma delta epsilon zeta".split(), r.randint(0, 4))) for i in range(40)]
    df = spark.createDataFrame(rows, "b int, id long, ks array<string>")
    x, y = df.alias("x"), df.selectExpr("b AS b2", "id AS id2", "ks AS ks2")
    score = {(p.id, p.id2): p.s for p in x.join(y, F.col("b") == F.col("b2")).select("id", "id2", keyword_similarity(F.col("ks"), F.col("ks2")).alias("s")).collect()}
    want: dict[int, int] = {}
    for b in range(2):
        for i in range(b, 40, 2):
            if i not in want:
                want |= {j: i for j in range(i, 40, 2) if j == i or j not in want and score[i, j] >= 0.55}
    assert {x.id: x.leader for x in keyword_leaders(df, 0.55, "id", "ks", ("b",)).collect()} == want


def test_segmenter_carries_headings_and_stitches(spark):
    from gradloom.operators.segment import parse, stitched

    assert stitched("a long\nline ends (3 marks)\nnext\n(Dec 2022, 7 marks)\n\nmore") == ["a long line ends (3 marks)", "next (Dec 2022, 7 marks)", "", "more"]
    text = "PART A\nModule 2\nDecember 2022\n1. Define hazard mapping (4 marks)\n(a) with one example\nand some more text\nPART B\nQn 11\n• Explain the whole process\nModule IV\n* Describe every phase of it\n13) Compare both methods\nFinal prioritized list\n14. Never reached here"
    got = [(q.number, q.part, q.marks, q.module, q.session, q.group, q.full_text) for q in parse(text)]
    assert got == [
        ("1", "A", 4, 2, "December 2022", None, "Define hazard mapping and some more text with one example"), ("11b1", "B", 14, 2, "December 2022", "11", "Explain the whole process"),
        ("11b2", "B", 14, 4, "December 2022", "11", "Describe every phase of it"), ("13", "B", 14, 4, "December 2022", "11", "Compare both methods"),
    ]
    assert parse(None) == parse("") == []


def test_progress_extends_a_known_table(spark):
    from gradloom.operators.jobs import call_statistics, job_progress, poll, retried

    one = spark.createDataFrame([(1, 1, "queued"), (1, 2, "analyzing"), (2, 1, "extracting")], "job int, at int, status string")
    two = spark.createDataFrame([(1, 3, "failed"), (2, 5, "completed"), (3, 9, "odd")], "job int, at int, status string")
    known = job_progress(two, job_progress(one))
    assert {(r.job, r.status, r.progress) for r in known.collect()} == {(1, "failed", 65), (2, "completed", 100), (3, "odd", 0)}
    assert {(r.job, r.status) for r in poll(known, spark.createDataFrame([(1,), (7,)], "job int")).collect()} == {(1, "failed"), (7, "not found")}
    pages = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.9), (3, "c", 0.1)], "page int, text string, confidence double")
    again = spark.createDataFrame([(1, "worse", 0.2), (2, "x", 1.0)], "page int, text string, confidence double")
    assert {(r.page, r.text, r.retried) for r in retried(pages, again).collect()} == {(1, "worse", True), (2, "b", False), (3, "c", False)}
    assert call_statistics(spark.createDataFrame([("m", True)] * 3 + [("m", False)], "provider string, ok boolean"), 2).first().asDict() == {"provider": "m", "calls": 3, "failures": 1, "success_rate": 0.75, "free_remaining": 0, "within_free": False}


def test_bloom_level_ties_and_defaults(spark):
    from gradloom.functions.classify import bloom_level

    rows = [("zzz", "understand"), ("Define it", "remember"), ("design a plan", "create"), ("define, define; explain", "remember"), (None, None), ("", "understand"), ("judge and use", "apply")]
    df = spark.createDataFrame(rows, "t string, w string")
    assert all(r.got == r.w for r in df.select("w", bloom_level(F.col("t")).alias("got")).collect())
