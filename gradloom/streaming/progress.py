"""The progress table of analysis jobs as a stream keeps it, and what a stream says of itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from gradloom.operators.jobs import job_progress
from gradloom.sources import versions

BUCKETS, BY = 64, ("bucket",)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("job"), F.lit(BUCKETS)).cast("int")


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """``job, at, status, progress`` as of the last micro-batch."""
    return versions.read(spark, folder, BY).drop("bucket")


def upserts(folder: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` runs: the changes (job, at, status) of a micro-batch go into the table in ``folder``.

    Only the buckets of the batch's jobs are written again, and all of them become visible in one commit. A job's row is
    the last and the furthest of all its changes, which doesn't change when some of them come again: a
    micro-batch that Spark replays after a failure, with the same or another number, leaves the table as it is.
    """

    def step(batch: DataFrame, _: int) -> None:
        changes = batch.select("job", "at", "status").withColumn("bucket", _bucket())
        touched = changes.select("bucket").distinct()
        known = None
        if versions.commits(batch.sparkSession, folder):
            known = versions.read(batch.sparkSession, folder, BY).join(touched, "bucket", "left_semi")
        versions.refresh(job_progress(changes, known).withColumn("bucket", _bucket()), folder, BY, touched)

    return step


def follow(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the table in ``folder`` up to date with what the stream ``changes`` has, then stops."""
    return changes.writeStream.foreachBatch(upserts(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queued(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """``job, at, status``: a queued job for every upload (job, at) that has none yet, the first of those that repeat it."""
    return uploads.groupBy("job").agg(F.min("at").alias("at")).join(known.select("job"), "job", "left_anti").select("job", "at", F.lit("queued").alias("status"))


@dataclass
class Watch(StreamingQueryListener):
    """Notes the rows and the state of every micro-batch, and how queries ended. Add it with ``spark.streams.addListener``."""

    batches: list[tuple[int, int, int]] = field(default_factory=list)  # number, rows, rows of state
    ended: list[str | None] = field(default_factory=list)  # the error, None where there was none

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.batchId, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)
