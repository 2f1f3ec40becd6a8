"""Dashboard and report aggregations over questions, papers, modules and clusters.

Every metric is one grouped pass with partial aggregation; dimensions (modules, tiers,
levels) are joined after the counting, so the joins see a row for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradloom.functions.classify import TIER_LABELS, tier, tier_label
from gradloom.functions.text import percentage
from gradloom.lineage import cut

count_if = lambda c: F.count(F.when(c, 1))


def literal_rows(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A small table of fixed values with their order."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, position int")


def overview(questions: DataFrame, duplicate: Column, papers: DataFrame, modules: DataFrame) -> DataFrame:
    """Totals of each subject: questions, unique, duplicates and their share, papers, modules."""
    q = questions.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total_questions"), count_if(~duplicate).alias("unique_questions"))
    p = papers.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total_papers"))
    m = modules.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total_modules"))
    out = q.join(p, "subject_id", "left").join(m, "subject_id", "left")
    dup = F.col("total_questions") - F.col("unique_questions")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("subject_id", "total_questions", "unique_questions", dup.alias("duplicate_questions"), percentage(dup, F.col("total_questions")).alias("duplicate_percentage"), zero("total_papers"), zero("total_modules"))


def module_distribution(questions: DataFrame, modules: DataFrame) -> DataFrame:
    """Questions of every module, also of empty ones; unclassified ones as module 0, where there are any."""
    n = questions.groupBy("subject_id", "module_number").agg(F.count(F.lit(1)).alias("count"))
    known = modules.join(n, ["subject_id", "module_number"], "left").select("subject_id", "module_number", "module_name", F.col("weightage").cast("double").alias("weightage"), F.coalesce("count", F.lit(0)).alias("count"))
    none = n.where(F.col("module_number").isNull()).select("subject_id", F.lit(0).alias("module_number"), F.lit("Unclassified").alias("module_name"), F.lit(0.0).alias("weightage"), "count")
    return known.unionByName(none)


def distribution(questions: DataFrame, by: Column, name: str, of: Sequence[str] = ()) -> DataFrame:
    """Counts by a label; the empty label does not count. It goes after the counting, by an aggregate:
    a filter on the label itself would be pushed down and compute the label twice for each row.

    With ``of``, the columns that the label is made of, equal rows are counted first and the label is decided once for them."""
    n = F.count(F.lit(1))
    if of:
        questions, n = questions.groupBy("subject_id", *of).agg(n.alias("__n")), F.sum("__n")
    labelled = questions.select("subject_id", by.alias(name), *(["__n"] if of else []))
    counts = labelled.groupBy("subject_id", name).agg(n.alias("count"), F.max(name).alias("shown"))
    return counts.where(F.col("shown") != "").drop("shown")


def dense(counts: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """``counts`` with a row for every subject and fixed value, 0 where nothing was counted."""
    all_ = counts.select("subject_id").distinct().select("subject_id", F.explode(F.array(*map(F.lit, values))).alias(name))
    return all_.join(counts, ["subject_id", name], "left").select("subject_id", name, F.coalesce("count", F.lit(0)).alias("count"))


def complete_stats(questions: DataFrame, modules: DataFrame, levels: Sequence[str]) -> DataFrame:
    """``subject_id, metric, key, value``: totals, modules (empty ones with 0, unclassified as 0), difficulties and Bloom levels of every subject.

    ``questions`` has subject_id, module_number, duplicate, difficulty and bloom. They are read and counted once, by grouping sets; what
    is joined and filled up afterwards is the table of counts, a few rows for each subject.
    """
    sets = [["subject_id"], *(["subject_id", c] for c in ("module_number", "difficulty", "bloom"))]
    counts = questions.groupingSets(sets, "subject_id", "module_number", "difficulty", "bloom").agg(F.grouping_id().alias("of"), F.count(F.lit(1)).alias("n"), count_if(~F.col("duplicate")).alias("unique"))
    counts = cut(counts.select("subject_id", "module_number", "difficulty", "bloom", F.element_at(F.create_map(*[F.lit(x) for pair in ((7, "all"), (3, "module"), (5, "difficulty"), (6, "bloom")) for x in pair]), F.col("of").cast("int")).alias("of"), "n", "unique"), "counts")
    of = lambda name: counts.where(F.col("of") == name)
    row = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    total, unique = F.col("n"), F.col("unique")
    totals = of("all").select("subject_id", F.explode(F.array(row("total_questions", F.lit(""), total), row("unique_questions", F.lit(""), unique), row("duplicate_percentage", F.lit(""), percentage(total - unique, total)))).alias("r"))
    by_module = of("module").select("subject_id", "module_number", F.col("n").alias("count"))
    known = modules.join(by_module, ["subject_id", "module_number"], "left").select("subject_id", row("module", F.col("module_number"), F.coalesce("count", F.lit(0))).alias("r"))
    none = by_module.where("module_number IS NULL").select("subject_id", row("module", F.lit(0), F.col("count")).alias("r"))
    hard = of("difficulty").where("difficulty != ''").select("subject_id", row("difficulty", F.col("difficulty"), total).alias("r"))
    filled = dense(of("bloom").where("bloom != ''").select("subject_id", "bloom", F.col("n").alias("count")), "bloom", levels)
    out = totals.unionByName(known).unionByName(none).unionByName(hard).unionByName(filled.select("subject_id", row("bloom", F.col("bloom"), F.col("count")).alias("r")))
    return out.select("subject_id", "r.metric", "r.key", "r.value")


def subject_context(questions: DataFrame, modules: DataFrame) -> DataFrame:
    """``subject_id, module_number, part_a, part_b, tier_1 .. tier_4`` of every module of every subject, empty ones with 0: questions of
    each part, and topics (topic_id) of each tier. Questions are counted once, by topic."""
    by = ["subject_id", "module_number"]
    topics = questions.groupBy(*by, "topic_id").agg(count_if(F.col("part") == "A").alias("part_a"), count_if(F.col("part") == "B").alias("part_b"), tier(F.countDistinct("exam_year")).alias("tier"))
    own = topics.groupBy(*by).agg(F.sum("part_a").alias("part_a"), F.sum("part_b").alias("part_b"), *[count_if(F.col("tier") == i).alias(f"tier_{i}") for i in (1, 2, 3, 4)])
    return modules.select(*by).join(own, by, "left").fillna(0)


def year_trend(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """One row for each paper with a year, with its number of questions, 0 included."""
    n = questions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("count"))
    return papers.where(F.col("exam_year") != "").join(n, "paper_id", "left").select("paper_id", "exam_year", F.coalesce("count", F.lit(0)).alias("count"))


def top_topics(topics: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The n most frequent topics of each group; ties by name."""
    w = Window.partitionBy(*by).orderBy(F.desc("frequency"), "topic_name")
    return topics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def topic_clusters(questions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Topic clusters: frequency is the number of distinct exam years, 0 when none is known."""
    year = F.nullif("exam_year", F.lit(""))
    out = questions.groupBy(*by).agg(
        F.countDistinct(year).alias("frequency"), F.coalesce(F.sum("marks"), F.lit(0)).alias("total_marks"), F.count(F.lit(1)).alias("question_count"),
        count_if(F.col("part") == "A").alias("part_a_count"), count_if(F.col("part") == "B").alias("part_b_count"), F.array_join(F.array_sort(F.collect_set(year)), ",").alias("years"),
    )
    return out.withColumn("priority_tier", tier(F.col("frequency")))


def question_texts(questions: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The distinct texts of a group with what :func:`text_clusters` adds up: ``n`` rows, their marks, parts and known years; ``first`` is the least of ``order``."""
    year, order_of = F.nullif("exam_year", F.lit("")).alias("year"), F.struct(*order).alias("first")
    of_year = questions.select(*by, "qtext", year, "marks", "part", order_of).groupBy(*by, "qtext", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("marks").alias("marks"), count_if(F.col("part") == "A").alias("part_a"), count_if(F.col("part") == "B").alias("part_b"), F.min("first").alias("first"),
    )
    return of_year.groupBy(*by, "qtext").agg(*[F.sum(c).alias(c) for c in ("n", "marks", "part_a", "part_b")], F.min("first").alias("first"), F.collect_set("year").alias("asked"))


def text_clusters(texts: DataFrame, by: Sequence[str]) -> DataFrame:
    """What :func:`topic_clusters` gives of questions, of their texts as :func:`question_texts` counts them."""
    out = texts.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("asked")))).alias("asked"), F.coalesce(F.sum("marks"), F.lit(0)).alias("total_marks"), F.sum("n").alias("question_count"),
        F.sum("part_a").alias("part_a_count"), F.sum("part_b").alias("part_b_count"),
    )
    out = out.withColumn("frequency", F.size("asked").cast("long")).withColumn("years", F.array_join("asked", ",")).drop("asked")
    return out.withColumn("priority_tier", tier(F.col("frequency")))


def cluster_groups(questions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cluster groups: frequency is the number of distinct years, or of members when no year is known."""
    year = F.nullif("exam_year", F.lit(""))
    return questions.groupBy(*by).agg(
        F.coalesce(F.nullif(F.countDistinct(year), F.lit(0)), F.count(F.lit(1))).alias("frequency"), F.count(F.lit(1)).alias("question_count"), F.substring(F.min("qtext"), 1, 500).alias("representative")
    )


def back_propagate(questions: DataFrame, clusters: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each question with its cluster's frequency and years."""
    return questions.join(clusters.select(*by, F.col("frequency").alias("repetition_count"), F.col("years").alias("years_appeared")), list(by), "left")


def priority_assignments(clusters: DataFrame) -> DataFrame:
    """Tier and label of strict clusters; concept clusters get none."""
    strict = clusters.where(F.col("cluster_type") == "strict_repetition")
    t = tier(F.col("frequency"))
    return strict.select("cluster_id", t.alias("tier"), tier_label(t).alias("tier_label"), "frequency")


def tier_summary(clusters: DataFrame) -> DataFrame:
    """Clusters of each tier label, all labels present."""
    labels = literal_rows(clusters.sparkSession, "tier_label", list(TIER_LABELS.values()))
    n = clusters.groupBy(tier_label(F.col("priority_tier")).alias("tier_label")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(n, "tier_label", "left").select("tier_label", F.coalesce("n", F.lit(0)).alias("count"))


def tier_counts(clusters: DataFrame, by: Sequence[str]) -> DataFrame:
    return clusters.groupBy(*by).agg(*[count_if(F.col("priority_tier") == t).alias(f"tier_{t}") for t in (1, 2, 3, 4)], F.count(F.lit(1)).alias("topics"))


def classification_rate(questions: DataFrame) -> DataFrame:
    return questions.groupBy("subject_id").agg(percentage(F.count("module_number"), F.count(F.lit(1))).alias("classification_rate"))


def paper_status(papers: DataFrame) -> DataFrame:
    return papers.groupBy("subject_id").agg(*[count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")], F.count(F.lit(1)).alias("total"))


def paper_counters(questions: DataFrame) -> DataFrame:
    return questions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("questions_extracted"), F.count("module_number").alias("questions_classified"))


def sessions(questions: DataFrame, order: Sequence[str], default_marks: int, part: str) -> DataFrame:
    """Questions of a part by exam session in a fixed order, others last, with default marks."""
    labels = literal_rows(questions.sparkSession, "exam_type", order)
    rows = questions.where(F.col("part") == part).join(F.broadcast(labels), "exam_type", "left")  # a handful of fixed labels
    marks = F.coalesce(F.nullif("marks", F.lit(0)), F.lit(default_marks))
    return rows.groupBy("subject_id", "exam_type").agg(F.coalesce(F.min("position"), F.lit(999)).alias("session_order"), F.count(F.lit(1)).alias("questions"), F.sum(marks).alias("marks"))


def study_order(topics: DataFrame, by: Sequence[str], last_tier_most: int = 10) -> DataFrame:
    """Topics ranked through the tiers; of the last tier only the first ten are listed."""
    within = Window.partitionBy(*by, "priority_tier").orderBy(F.desc("frequency"), "topic_name")
    over = Window.partitionBy(*by).orderBy("priority_tier", F.desc("frequency"), "topic_name")
    listed = topics.withColumn("in_tier", F.row_number().over(within)).where((F.col("priority_tier") < 4) | (F.col("in_tier") <= last_tier_most))
    return listed.withColumn("rank", F.row_number().over(over))


def recommendation(frequency: Column) -> Column:
    text = F.when(frequency >= 4, "Must learn first").when(frequency == 3, "Strongly prepare").when(frequency == 2, "Prepare next").otherwise("Optional")
    return F.concat(text, F.lit(" — appeared "), frequency.cast("string"), F.when(frequency >= 2, " times.").otherwise(" time."))
