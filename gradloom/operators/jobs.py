"""Progress of analysis jobs and statistics of model calls, as tables that batches extend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a job and how far each is; a failed job stays as far as it came.
PROGRESS = {"queued": 0, "extracting": 5, "classifying": 40, "analyzing": 65, "embedding": 85, "detecting": 90, "completed": 100, "failed": 0}
FREE_CALLS = 1500


def _progress(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), F.lit(0))


def job_progress(changes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``job, at, status, progress``: each job's last state and the furthest it came.

    ``changes`` has job, at and status; ``known`` is the table so far, so that a micro-batch costs
    its own jobs. Of changes at one time the one with the later state counts.
    """
    rows = changes.select("job", "at", "status", _progress(F.col("status")).alias("progress"))
    rows = rows if known is None else known.select("job", "at", "status", "progress").unionByName(rows)
    last = F.max(F.struct("at", "progress", "status"))
    return rows.groupBy("job").agg(last.alias("l"), F.max("progress").alias("progress")).select("job", "l.at", "l.status", "progress")


def poll(progress: DataFrame, wanted: DataFrame) -> DataFrame:
    """The state of every job of ``wanted`` (job); ``not found`` where there is none."""
    return wanted.join(progress, "job", "left").select("job", F.coalesce("status", F.lit("not found")).alias("status"), F.coalesce("progress", F.lit(0)).alias("progress"))


def call_statistics(calls: DataFrame, free_calls: int = FREE_CALLS) -> DataFrame:
    """Of every provider: answered and failed calls, their rate (0 without calls), and what is left of the free ones.

    ``calls`` has provider and ok, one row for each call.
    """
    n = calls.groupBy("provider").agg(F.count(F.when(F.col("ok"), 1)).alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("failures"))
    total = F.col("calls") + F.col("failures")
    return n.select(
        "provider", "calls", "failures", F.when(total > 0, F.col("calls") / total).otherwise(0.0).alias("success_rate"),
        F.greatest(F.lit(0), F.lit(free_calls) - F.col("calls")).alias("free_remaining"), (F.col("calls") <= free_calls).alias("within_free"),
    )


def page_confidence(lines: DataFrame) -> DataFrame:
    """``page, text, confidence`` from recognised ``lines`` (page, line, text, confidence): the lines in order, their mean confidence."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    return lines.groupBy("page").agg(text.alias("text"), F.round(F.avg("confidence"), 6).alias("confidence"))


def retried(pages: DataFrame, again: DataFrame, least: float = 0.60) -> DataFrame:
    """``pages`` with the second reading wherever the first was below ``least``, also if the second is worse.

    ``again`` (page, text, confidence) need only hold the pages below ``least``; without a second reading the first stays.
    """
    second = again.select("page", F.col("text").alias("text_2"), F.col("confidence").alias("confidence_2"))
    both = pages.join(second, "page", "left")
    use = (F.col("confidence") < least) & F.col("confidence_2").isNotNull()
    return both.select("page", F.when(use, F.col("text_2")).otherwise(F.col("text")).alias("text"), F.when(use, F.col("confidence_2")).otherwise(F.col("confidence")).alias("confidence"), use.alias("retried"))


def images_near(questions: DataFrame, images: DataFrame) -> DataFrame:
    """``questions`` (paper_id, number, page) with the images (paper_id, image, page) of their page; without a page, the first."""
    q = questions.withColumn("page", F.coalesce("page", F.lit(1)))
    return q.join(images, ["paper_id", "page"], "left").groupBy("paper_id", "number", "page").agg(F.array_sort(F.collect_set("image")).alias("images"))
