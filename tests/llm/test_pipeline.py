"""The corpus pipeline on a small fixture, stage by stage."""

import random

from tests.llm.test_operators import DOCS, edited, prose


def test_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(0)
    base = [prose(150, i) for i in range(30)]
    texts = [*base, base[0], edited(base[1], 2, 1), "too short", "x " * 200, base[2] + ' token = "k9Qz7Lm2Xw8RtB4v"', None, ""]
    rows = [(i, t, "en", r.choice(["a", "b", "c"]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
        kept.append(docs)
    assert sorted(x.doc_id for x in kept[0].collect()) == [*range(32), 34]
    assert sorted(x.doc_id for x in kept[1].collect()) == [*range(30)]
    assert kept[2].count() == 30
    words = sum(len(t.split()) for t in base)
    assert abs(sum(len(x.text.split()) for x in kept[3].collect()) - words) <= 3 * 150
    pieces = kept[4].collect()
    assert {x.doc_id for x in pieces} == {x.doc_id for x in kept[3].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows, null ids and sources, columns with names that operators use."""
    import corpus_pipeline

    rows = [(1, prose(80, 1), "en", None, 7), (1, prose(80, 1), "en", None, 7), (None, prose(80, 2), None, "a", None), (3, None, "en", "a", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS node", "'x' AS uses", "2 AS failed", "3 AS __key")
    for some in (docs, docs.limit(0)):
        out = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
        assert {(x.doc_id, x.node, x.uses, x.failed) for x in out.collect()} <= {(1, 1, "x", 2), (None, 1, "x", 2)}
        pieces = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect()
        assert {x.doc_id for x in pieces} == {x.doc_id for x in out.collect()}
