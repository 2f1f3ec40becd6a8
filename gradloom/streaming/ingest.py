"""Streams: incremental ingest of papers and the upload rate limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradloom.lineage import cut
from gradloom.workers import ship

LIMIT, HOUR_MS = 5, 3_600_000


def ingest(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``step`` once on each new file of ``folder``, then stops; what was seen is in ``checkpoint``."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def allow(times: list[int], count: int, expires: int, limit: int = LIMIT, ttl: int = HOUR_MS) -> tuple[list[bool], int, int]:
    """The verdicts on uploads at ``times`` (ms, ascending) given the address's count and expiry.

    Every accepted upload sets the expiry anew; a rejected one changes nothing.
    """
    out = []
    for t in times:
        if t >= expires:
            count = 0
        ok = count < limit
        if ok:
            count, expires = count + 1, t + ttl
        out.append(ok)
    return out, count, expires


RATE = "address long, event_id long, at_ms long, accepted boolean"


def _limit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, expires = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches)).sort_values(["at_ms", "event_id"])
    verdicts, count, expires = allow(rows["at_ms"].tolist(), count, expires)
    state.update((count, expires))
    yield rows[["address", "event_id", "at_ms"]].assign(accepted=verdicts)


def _limit_until(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # no upload that is still to come is before its expiry
        state.remove()
        return
    yield from _limit(key, batches, state)
    if (expires := state.get[1]) > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(expires)
    else:
        state.remove()


def rate_limited(uploads: DataFrame, lateness: str | None = None) -> DataFrame:
    """Each upload (address, event_id, at_ms) of a stream with whether the limit lets it in.

    With ``lateness`` an address is forgotten when its count has expired for every upload that may still come, so state is held
    for the addresses of the last hour and not for all that there ever were; uploads that come later than ``lateness`` after a newer one
    get no verdict. Without it state is kept for ever, and every upload gets one.
    """
    ship(uploads.sparkSession)
    state = "count int, expires long"
    if lateness is None:
        return uploads.groupBy("address").applyInPandasWithState(_limit, RATE, state, "append", GroupStateTimeout.NoTimeout)
    timed = uploads.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", lateness)
    return timed.groupBy("address").applyInPandasWithState(_limit_until, RATE, state, "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited_batch(uploads: DataFrame) -> DataFrame:
    """The same verdicts over a table. An hour without uploads of an address ends all that came before, so a group is what
    came without such a pause, and not an address's whole history; groups within the limit need no walk."""
    ship(uploads.sparkSession)
    w = Window.partitionBy("address").orderBy("at_ms", "event_id")
    fresh = F.coalesce(F.col("at_ms") - F.lag("at_ms").over(w) >= HOUR_MS, F.lit(True))
    parted = uploads.select("address", "event_id", "at_ms").withColumn("fresh", fresh.cast("int")).withColumn("visit", F.sum("fresh").over(w))
    sized = cut(parted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("address", "visit"))).drop("fresh"), "visits")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at_ms", "event_id"])
        return rows[["address", "event_id", "at_ms"]].assign(accepted=allow(rows["at_ms"].tolist(), 0, 0)[0])

    few = sized.where(F.col("n") <= LIMIT).select("address", "event_id", "at_ms", F.lit(True).alias("accepted"))
    return few.unionByName(sized.where(F.col("n") > LIMIT).groupBy("address", "visit").applyInPandas(run, RATE))


def session_counts(events: DataFrame, gap: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Uploads of each address in sessions with no gap of an hour; on a stream give a watermark."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    window = F.session_window("ts", gap)
    return events.groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("uploads")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "uploads")
