"""The views over the driver's tables: how their work is spread."""

import os

import pytest

from gradloom.plans.exam import COSTLY, Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("view", sorted(COSTLY))
def test_costly_views_run_in_many_tasks(spark, view):
    """One small file, which is one task where it is read."""
    rows = getattr(Tables(spark, FOLDER), view)
    sizes = [n for n in rows.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect() if n]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
def test_questions_of_large_tables_come_in_bounded_tasks(spark, monkeypatch):
    from gradloom.plans import exam

    few = sorted(map(str, Tables(spark, FOLDER).questions.collect()))
    monkeypatch.setattr(exam, "ROWS_A_TASK", 500)
    many = Tables(spark, FOLDER).questions
    sizes = many.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()
    assert sorted(map(str, many.collect())) == few
    assert len(sizes) == -(-len(few) // 500) and max(sizes) < 1000


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
def test_lines_of_a_topic_are_made_once(spark):
    """Pairs of a topic's lines come from one reading of the lines, and not from a join of two."""
    from gradloom.plans.relational_queries import _self

    df = _self(Tables(spark, FOLDER))
    assert df.count() == 200 * 21  # every two of seven forms
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == Tables(spark, FOLDER).qlines._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_a_label_is_decided_once_for_equal_texts(spark):
    from pyspark.sql import functions as F

    from gradloom.operators.stats import distribution

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def label(text):
        calls.add(1)
        return "" if text == "t0" else text[:1]

    rows = spark.range(1000).selectExpr("id % 2 AS subject_id", "concat('t', id % 10) AS qtext")
    got = {(r.subject_id, r.label): r["count"] for r in distribution(rows, label("qtext"), "label", ("qtext",)).collect()}
    assert got == {(0, "t"): 400, (1, "t"): 500} and calls.value == 10


def test_buckets_that_go_on_in_the_next_batch(spark):
    from gradloom.operators.clusters import keyword_leaders

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(90).selectExpr("id % 3 AS b", "id AS i", "array(concat('w', id % 5), 'x') AS ks").repartition(1)
    spark.conf.set(key, "7")
    try:
        got = {r.i: r.leader for r in keyword_leaders(rows, 0.9, "i", "ks", ("b",)).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {i: min(j for j in range(90) if j % 15 == i % 15) for i in range(90)}
