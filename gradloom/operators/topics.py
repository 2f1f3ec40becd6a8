"""The analysis of a subject's topics: questions to topic clusters with their tiers, and the table that holds them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradloom.functions.text import capitalize_words, topic_key
from gradloom.lineage import cut
from gradloom.operators.clusters import canonical_phrase, key_terms, phrase_numbers, topic_phrases
from gradloom.operators.plugins import Embedder, hashing_embedder
from gradloom.operators.stats import question_texts, text_clusters
from gradloom.sources import versions

# Fixed value: how alike two topic phrases are to be of one topic.
SIMILARITY = 0.55
BY = ("subject_id", "module_number")


def analyze(questions: DataFrame, order: Sequence[str], similarity: float = SIMILARITY, make: Callable[[], Embedder] = hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """Topic clusters of every module of every subject, and the questions with the number of theirs.

    ``questions`` has subject_id, module_number, qtext, exam_year, marks and part. Questions without a module are clustered among
    themselves, like those of a module. Questions are asked again word by word, year after year: a bucket's equal texts are counted first
    and all else is done with them, once for each. Each bucket's key terms stabilise its topic phrases, phrases are clustered, and
    a cluster is named by the commonest phrase of its own key terms. ``order`` says which question of a cluster represents it.
    """
    place = F.to_json(F.struct(*BY))
    texts = question_texts(questions, BY, order).withColumn("place", place).withColumn("normal", topic_key(F.col("qtext")))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()), "texts")  # written with its numbers, so they stay
    phrases = topic_phrases(texts, key_terms(texts, ("place",), "normal", weight="n"), ("place",), ("id",), "normal").select("id", "phrase")
    members = cut(phrase_numbers(texts.join(phrases, "id"), "phrase", BY, similarity, make, "n").drop("phrase"), "members")
    named = topic_phrases(members, key_terms(members, ("cluster",), "normal", weight="n"), ("cluster",), ("first", "n"), "normal")
    names = canonical_phrase(named, ("cluster",), "first", "n")
    first = members.groupBy("cluster").agg(F.min(F.struct("first", "qtext", "normal")).alias("m")).select("cluster", F.col("m.qtext").alias("representative_text"), F.col("m.normal").alias("first_normal"))
    key = F.coalesce("topic", "first_normal")
    clusters = text_clusters(members, ("cluster", *BY)).join(names, "cluster", "left").join(first, "cluster")
    clusters = clusters.select(*BY, "cluster", capitalize_words(key).alias("topic_name"), key.alias("normalized_key"), "representative_text", "frequency", "years", "total_marks", "priority_tier", "question_count", "part_a_count", "part_b_count", F.substring(key, 1, 100).alias("cluster_id"))
    of = members.select(F.col("place").alias("__place"), F.col("qtext").alias("__text"), "cluster")
    each = questions.withColumn("__own", place).join(of, (F.col("__own") == F.col("__place")) & F.col("qtext").eqNullSafe(F.col("__text"))).drop("__own", "__place", "__text")
    return clusters, each.withColumn("seen", F.row_number().over(Window.partitionBy("cluster").orderBy(*order, "qtext")))


def refresh_subjects(questions: DataFrame, folder: str, subjects: DataFrame, order: Sequence[str], similarity: float = SIMILARITY, make: Callable[[], Embedder] = hashing_embedder) -> int:
    """Analyses ``subjects`` (subject_id) anew and replaces all their topic clusters at once; a subject without
    questions has none afterwards. Readers (:func:`topics_of`) see the clusters before or the clusters after, of all these subjects."""

    def compute(part: DataFrame) -> DataFrame:
        return analyze(part, order, similarity, make)[0]

    return versions.recompute(questions, folder, ("subject_id",), subjects, compute)


def topics_of(spark, folder: str, at: int | None = None) -> DataFrame:
    """The topic clusters of all subjects as of the last refresh, or of refresh ``at``."""
    return versions.read(spark, folder, ("subject_id",), at)


def reset_subjects(papers: DataFrame, subjects: DataFrame, *folders: str) -> DataFrame:
    """Undoes the analysis of ``subjects`` (subject_id): in each of the tables in ``folders`` (questions, topic clusters; by subject) they have nothing
    left, and their papers are pending, without an error. A reader sees each table before or after."""
    for folder in folders:
        versions.refresh(versions.read(papers.sparkSession, folder, ("subject_id",)).where("false"), folder, ("subject_id",), subjects)
    mine = papers.join(subjects.select("subject_id").distinct().withColumn("__reset", F.lit(True)), "subject_id", "left")
    out = mine.withColumn("status", F.when(F.col("__reset"), "pending").otherwise(F.col("status")))
    if "processing_error" in papers.columns:
        out = out.withColumn("processing_error", F.when(F.col("__reset"), "").otherwise(F.col("processing_error")))
    return out.select(*papers.columns)
