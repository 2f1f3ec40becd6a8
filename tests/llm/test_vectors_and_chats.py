"""Hard negatives, chat formatting and whitening against brute-force versions, and their defined results for odd input."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.llm import chat_format, hard_negatives, whitening

VECTORS = "vec_id long, embedding array<float>, label int"
ODD_VECTORS = [(9001, None, 1), (9002, [], 1), (9003, [1.0, None, 2.0], 1), (9004, [float("nan")] * 3, 1), (9005, [float("inf")] * 3, 2), (9006, [1.0, 2.0], 3)]


# 11 -----------------------------------------------------------------------------------------


def brute_negatives(rows):
    data = sorted({(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, v, lab in rows})
    out = []
    for i, lab, q in data:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j, other) for j, other, p in data if j != i)
        for s, j in [(-s, j) for s, j, other in scored if other == lab][:5]:
            fit = [(-t, k) for t, k, other in scored if other != lab and 30 * s <= -100 * t <= 90 * s][:10]
            out += [(i, j, r, k, s, t) for r, (t, k) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "scale", "same"), [(400, 5, 0.3, 0), (300, 70, 0.2, 100), (250, 3, 90.0, 0), (120, 4, 0.0, 0)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, dims, scale, same):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)  # many blocks and groups
    monkeypatch.setattr(hard_negatives, "GROUP", 2)
    r = np.random.default_rng(n)
    v = r.normal(size=(n, dims)).astype(np.float32) * np.float32(scale)
    v[:same] = v[0]  # a third of all rows and more are one vector
    rows = [(i, [float(c) for c in x], int(r.integers(0, 3))) for i, x in enumerate(v)]
    got = sorted(map(tuple, hard_negatives.op11(spark.createDataFrame(rows + rows[:50], VECTORS)).collect()))
    assert got == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    good = [(100, [1.0, 0.5, 0.0], 1), (3, [1.0, 0.4, 0.0], 1), (4, [0.8, 0.1, 0.2], 2), (5, [0.7, 0.2, 0.1], None), (7, [1.0, 0.3, 0.0], 0)]
    odd = [*ODD_VECTORS, (None, [1.0, 1.0, 1.0], 2), (9007, [3e38, 0.0, 0.0], 2)]
    table = spark.createDataFrame(good + odd, VECTORS).selectExpr("*", "1 AS planes", "2 AS ANCHOR", "3 AS q")
    got = hard_negatives.op11(table).collect()
    assert sorted({(x.anchor_id, x.positive_id, x.negative_id) for x in got}) == [(100, 3, 4), (100, 7, 4)]  # 7's label becomes 1
    assert hard_negatives.op11(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.op11(spark.createDataFrame(ODD_VECTORS[:2], VECTORS)).count() == 0


def test_planes_give_products():
    r = np.random.default_rng(1)
    q = r.integers(-300, 300, size=(50, 130))
    bits = 10
    p, w = hard_negatives.planes(q, bits), hard_negatives.weights(bits)
    for i, j in [(0, 1), (7, 7), (20, 49)]:
        total = sum(w[a] * w[b] * int(np.bitwise_count(p[a, :, i] & p[b, :, j]).sum()) for a in range(bits) for b in range(bits))
        assert total == int(q[i] @ q[j])


def test_candidates_are_dropped_before_the_last_plane(monkeypatch):
    r = np.random.default_rng(2)
    q = np.floor(256 * r.normal(size=(4000, 64)) / 8).astype(int)
    bits = 10
    p = hard_negatives.planes(q, bits)
    seen = []
    real = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: seen.append(x.shape[1]) or real(x))
    (at, score), = hard_negatives.best(np.arange(4000), np.zeros(4000), p, p[:, :, 0], 0, 0, int(np.minimum(q[0], 0).sum()), int(np.maximum(q[0], 0).sum()), True, 5, [(-(2**62), 2**62, -(2**62))])
    want = sorted((-int(q[0] @ q[i]), i) for i in range(1, 4000))[:5]
    assert [(-int(s), int(i)) for i, s in zip(at, score, strict=True)] == want
    assert seen[-1] < 400 < seen[0]


# 12 -----------------------------------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string"
TRICKS = ["", None, "\\", "\\\\[INST]", "[\\INST]", "</s>", "[INST] ok [/INST]", "<<SYS>><</SYS>>", "<<ROLE>> x <</ROLE>>", "[[INST]INST]", "<<s>s>", " ", "\n", "é日本 <s>\\s", "a\\", "[INST", "INST]", " [/INST"]


@pytest.fixture
def dealt(spark):
    """Small inputs keep all their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_chat(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", hashlib.md5((t[2] or "").encode()).hexdigest()))
    learnt = "".join(x or "" for _, r, x in turns if r == "assistant")
    state, error = "start", None
    for i, (_, role, _) in enumerate(turns):
        state = chat_format.INSTRUCT.moves.get(state, {}).get(role or "", "error")
        error = i if state == "error" and error is None else error
    error = len(turns) if error is None and state != "answered" else error
    return len(turns), hashlib.sha256("".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), error is None, error


def test_chats_equal_brute_force(spark, dealt):
    r = random.Random(3)
    chats = {c: [(t if r.random() < 0.95 else None, r.choice(["user", "assistant", "system", "tool", None, "[INST]", "us\\er"]) if r.random() < 0.2 else ("user", "assistant")[t % 2], r.choice(TRICKS)) for t in range(r.choice([1, 2, 3, 8]))] for c in range(60)}
    chats[None] = [(0, "user", "x" * 200_000), (0, "user", "x" * 200_000), (1, "assistant", "long [INST] " * 20_000)]
    chats[77] = [(t, ("user", "assistant")[t % 2], r.choice(TRICKS)) for t in range(3000)]  # most of all turns, over several partitions
    rows = [(c, *t) for c, turns in chats.items() for t in turns]
    r.shuffle(rows)
    got = {x.conv_id: x for x in chat_format.op12(spark.createDataFrame(rows, CHATS).selectExpr("*", "1 AS part", "2 AS POS", "3 AS segments")).collect()}
    said = "</s>[INST] ok [/INST]"
    chats[-1] = [(0, "user", said), (1, "assistant", said)]
    assert set(got) == set(chats)
    for c, turns in chats.items():
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256, x.valid, x.first_error) == brute_chat(turns), c


def test_machine_goes_on_across_partitions(spark, dealt):
    turns = [(5, t, ("user", "assistant")[t % 2], "x") for t in range(4000)]
    turns[2500] = (5, 2500, "system", "late")
    pieces = chat_format.formatted(spark.createDataFrame(turns, CHATS))
    assert pieces.select("part").distinct().count() > 1
    states = [x.state for x in pieces.orderBy("part", "pos").collect()]
    assert states[:2500] == ["asked", "answered"] * 1250 and set(states[2500:]) == {"error"}


def test_whole_conversation_is_read_by_its_marks(spark):
    turns = [(("system", "user", "assistant", "tool", "")[i % 5], t or "") for i, t in enumerate(TRICKS * 3)]
    text = "".join(s for role, t in turns for s, _ in chat_format.INSTRUCT.segments(role, t))
    assert chat_format.INSTRUCT.turns(text) == turns
    back = chat_format.read_back(chat_format.formatted(spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], CHATS))).orderBy("part", "pos").collect()
    assert [(x.role, x.text) for x in back] == turns
    assert [x.learnt for x in back] == [t if r == "assistant" else None for r, t in turns]


def test_templates_that_cannot_be_read_back_are_refused():
    good = {"roles": {"user": ("[A] ", " [B]", False)}, "moves": {"start": {"user": "start"}}, "ends": frozenset(), "other": ("<o> ", " <p> ", " <q>"), "control": ("[A]", "[B]", "<o>", "<p>", "<q>")}
    chat_format.Template(**good)
    for change in ({"control": ("[A]", "]B")}, {"control": ("\\a", "[B]")}, {"roles": {"user": ("[A]", " [B]", False)}}, {"roles": {"user": ("[A] ", " b", False)}}, {"roles": {"user": ("[A] ", " [B]", False), "bot": ("[A] ", " [B]", True)}}):
        with pytest.raises(ValueError):
            chat_format.Template(**(good | change))


def test_no_conversations(spark):
    assert [x.conv_id for x in chat_format.op12(spark.createDataFrame([], CHATS)).collect()] == [-1]
    assert chat_format.digests(chat_format.formatted(spark.createDataFrame([], CHATS))).count() == 0


# 13 -----------------------------------------------------------------------------------------


def check_whitening(got, vectors, k):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    cov = np.cov((x - s / n).T, bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * k
    for c in range(k):
        mine = {r.vec_id: r for r in got if r.component == c + 1}
        a, b = np.array([mine[i].whitened for i in range(n)]), (x - s / n) @ u[:, c] / np.sqrt(e[c])
        assert np.abs(a - np.sign((a * b).sum()) * b).max() < 1e-8
        assert all(mine[i].deviation == sum(int(n * y - t) ** 2 for y, t in zip(x[i].tolist(), s.tolist(), strict=True)) for i in range(n))
        assert all(abs(r.explained - e[c] / np.trace(cov)) < 1e-9 and r.n == n and r.identity_error < 1e-9 for r in mine.values())


@pytest.mark.parametrize(("dims", "pairs"), [(12, 4096), (12, 7), (3, 4096)])
def test_whitening_equals_numpy(spark, monkeypatch, dims, pairs):
    monkeypatch.setattr(whitening, "PAIRS", pairs)
    r = np.random.default_rng(dims)
    v = (r.normal(size=(200, dims)) * np.linspace(1, 3, dims) + 5).tolist()
    v[50:120] = [v[0]] * 70
    rows = [(i, x, 0) for i, x in enumerate(v)]
    odd = [o for o in ODD_VECTORS if dims != 3 or o[0] != 9006]
    table = spark.createDataFrame(rows + odd, VECTORS).selectExpr("*", "1 AS x", "2 AS W1", "3 AS each")
    got = whitening.op13(table).collect()
    check_whitening(got, v, min(8, dims))


def test_whitening_without_variance(spark):
    assert whitening.op13(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.op13(spark.createDataFrame(ODD_VECTORS[:5], VECTORS)).count() == 0
    assert whitening.op13(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(9)], VECTORS)).count() == 0
    flat = whitening.op13(spark.createDataFrame([(i % 3, [float(i), 7.0, float(2 * i)], 0) for i in range(9)], VECTORS)).collect()
    assert len(flat) == 9 and {x.component for x in flat} == {1} and abs(flat[0].explained - 1) < 1e-12


def test_whitening_of_huge_entries(spark):
    got = whitening.op13(spark.createDataFrame([(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (None, [0.0, 3.0], 0)], VECTORS)).collect()
    assert {x.vec_id for x in got} == {1, 2, None} and all(np.isfinite(x.whitened) for x in got)
    assert {x.deviation for x in got if x.vec_id == 1} == {None}


def test_rows_are_not_moved(spark):
    x, dims = whitening.quantised(spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], 0) for i in range(50)], VECTORS))
    plan = whitening.project(x, whitening.fit(x, dims)).select(F.sum("w1"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2  # that of the last sum
