"""Streams whose state ends, progress that a replay doesn't change, and merges that see what changes."""

import random

import pytest

from gradloom.operators import merge as M
from gradloom.operators.jobs import job_progress
from gradloom.sources import versions
from gradloom.streaming import ingest
from gradloom.streaming import progress as P

HOUR = 3_600_000
UPLOADS = "address long, event_id long, at_ms long"


def test_state_of_expired_addresses_disappears(spark, tmp_path):
    r = random.Random(4)
    # each file is an hour and more later than the one before; addresses come for one hour and not again, but for one
    rows = [[(a + 10 * f, f * 1000 + i, f * 2 * HOUR + r.randint(0, HOUR)) for a in range(10) for i in range(7 * a, 7 * a + 7)] + [(5000, f * 1000 + 900, f * 2 * HOUR + 1)] for f in range(6)]
    for f, part in enumerate(rows):
        spark.createDataFrame(part, UPLOADS).coalesce(1).write.parquet(f"{tmp_path}/in/{f}")
    watch = P.Watch()
    spark.streams.addListener(watch)
    try:
        stream = spark.readStream.schema(UPLOADS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = ingest.rate_limited(stream, "30 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(watch)
    flat = [x for part in rows for x in part]
    got = {(x.address, x.event_id): x.accepted for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(x.address, x.event_id): x.accepted for x in ingest.rate_limited_batch(spark.createDataFrame(flat, UPLOADS)).collect()}
    assert got == want and not all(want.values())
    state = [s for _, n, s in watch.batches]
    assert sum(n for _, n, _ in watch.batches) == len(flat) and watch.ended[-1] is None
    assert max(state) < 30 and len({a for a, _, _ in flat}) == 61  # of two files at most, not of all


def test_batch_limit_equals_the_walk(spark):
    r = random.Random(6)
    rows = [(a, i, int(r.choice([0.05, 0.3, 1.5, 3]) * HOUR * i) + r.randint(0, HOUR // 2) if a % 2 else i * r.choice([1000, HOUR // 4])) for a in range(8) for i in range(40)]
    got = {(x.address, x.event_id): x.accepted for x in ingest.rate_limited_batch(spark.createDataFrame(rows + [(99, 1, 5)], UPLOADS)).collect()}
    for a in range(8):
        mine = sorted((t, e) for x, e, t in rows if x == a)
        for (_, e), ok in zip(mine, ingest.allow([t for t, _ in mine], 0, 0)[0], strict=True):
            assert got[a, e] == ok
    assert got[99, 1]


CHANGES = "job string, at long, status string"


def changes_of(r, n):
    states = ["queued", "extracting", "classifying", "analyzing", "embedding", "detecting", "completed", "failed", None, "odd"]
    return [(f"job{r.randint(0, 40)}", r.randint(0, 50), r.choice(states)) for _ in range(n)]


def test_replayed_batches_change_nothing(spark, tmp_path):
    r = random.Random(8)
    parts = [changes_of(r, 60) for _ in range(4)]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    folder = f"{tmp_path}/progress"
    P.follow(stream, folder, f"{tmp_path}/cp").awaitTermination()
    want = sorted(map(tuple, job_progress(spark.createDataFrame([x for p in parts for x in p], CHANGES)).collect()))
    held = lambda: sorted(map(tuple, P.progress(spark, folder).collect()))
    assert held() == want and len(versions.commits(spark, folder)) == 4
    step = P.upserts(folder)
    step(spark.createDataFrame(parts[3], CHANGES), 3)  # the last micro-batch again, as after a failure before its number was kept
    step(spark.createDataFrame(parts[0], CHANGES), 0)
    assert held() == want
    P.follow(stream, folder, f"{tmp_path}/cp2").awaitTermination()  # all again, from a lost checkpoint
    assert held() == want
    uploads = spark.createDataFrame([("job1", 7), ("new", 9), ("new", 8)], "job string, at long")
    assert sorted(map(tuple, P.queued(uploads, P.progress(spark, folder)).collect())) == [("new", 8, "queued")]


def test_update_or_create(spark):
    known = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3)], "id int, x string, n int")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (4, None, None)], "id int, x string, n int")
    got = {r.id: (r.x, r.n, r.state) for r in M.update_or_create(known, new, ["id"], ["x", "n"]).collect()}
    assert got == {1: ("a", 1, "unchanged"), 2: ("b", 2, "updated"), 3: ("c", 3, "kept"), 4: (None, None, "created")}


def test_concepts_never_keep_a_tier(spark):
    known = spark.createDataFrame([(1, 1, "Top Priority", 9), (2, 4, "Low Priority", 1), (9, 3, "Medium Priority", 2)], "cluster_id long, tier int, tier_label string, frequency long")
    groups = spark.createDataFrame([(1, 9, "concept_similarity"), (2, 4, "strict_repetition"), (3, 3, "strict_repetition")], "cluster_id long, frequency long, cluster_type string")
    first = M.assign_priorities(known, groups)
    assert {r.cluster_id: (r.tier, r.state) for r in first.collect()} == {2: (1, "updated"), 3: (2, "created"), 9: (3, "kept")}
    assert {r.state for r in M.assign_priorities(first.drop("state"), groups).collect()} == {"unchanged", "kept"}


STICKY = {"m": "m_set", "d": "d_set"}


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_edits_mark_real_changes_and_survive_runs(spark, runs):
    rows = spark.createDataFrame([(i, 1, "easy", False, False, "kept") for i in range(8)] + [(8, None, None, None, None, "kept"), (9, 1, "easy", True, False, "kept")], "id int, m int, d string, m_set boolean, d_set boolean, other string")
    edits = spark.createDataFrame(
        [(0, 1, 1, "easy", None), (1, 1, 2, "easy", None), (2, 1, 2, "easy", None), (2, 2, 1, "easy", None), (3, 1, None, "easy", None), (4, 1, 1, "easy", True), (5, 1, 1, "hard", False), (5, 2, 1, "hard", None), (8, 1, None, None, None), (77, 1, 3, "x", None)],
        "id int, at int, m int, d string, seen boolean",
    )
    computed = spark.createDataFrame([(i, 5, "computed") for i in range(9)], "id int, m int, d string")
    for _ in range(runs):
        rows = M.apply_edits(rows, edits, "id", ["at"], STICKY, "seen")
    got = {r.id: (r.m, r.d, r.m_set, r.d_set) for r in rows.collect()}
    assert got == {
        0: (1, "easy", False, False), 1: (2, "easy", True, False), 2: (1, "easy", True, False), 3: (None, "easy", True, False), 4: (1, "easy", True, False), 5: (1, "hard", False, True),
        6: (1, "easy", False, False), 7: (1, "easy", False, False), 8: (None, None, False, False), 9: (1, "easy", True, False),
    }
    after = {r.id: (r.m, r.d, r.other) for r in M.reclassified(rows, computed, "id", STICKY).collect()}
    assert after[0] == (5, "computed", "kept") and after[1] == (2, "computed", "kept") and after[5] == (5, "hard", "kept") and after[9] == (1, "easy", "kept") and after[3][0] is None
