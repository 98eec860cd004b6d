"""Streaming twins of the batch windows: sliding briefings, distinct URLs, sessions, a keyed cache, a guarded sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.times import WINDOW_HOURS
from siftwell.operators.dedup import shared_dir


def briefing_windows(events: DataFrame, ts: str = "ts", by: tuple[str, ...] = (), late: str | None = None, hours: int = WINDOW_HOURS) -> DataFrame:
    """Counts per sliding window of `hours`, a day apart, aligned to midnight UTC. Windows hold their start, not their end."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, f"{hours} hours", "24 hours").alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def tumbling(events: DataFrame, ts: str, width: str, by: tuple[str, ...], value: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_urls(articles: DataFrame, url: str = "url", ts: str = "published_at", within: str = "48 hours") -> DataFrame:
    return articles.withWatermark(ts, within).dropDuplicatesWithinWatermark([url])


def newest_per_key(entries: DataFrame, key: str = "key", ts: str = "created_at", value: str = "summary", days: int = 30) -> DataFrame:
    """A cache as state: the newest value per key (of equal times the larger), held by periods of so many days and forgotten with them.

    Each period tells its own newest, so that an update may be older than one before; `upserted` goes by time. What is
    forgotten is older than any row that the watermark still lets in.
    """
    rows = entries.withWatermark(ts, "1 hour").groupBy(F.window(ts, f"{days} days"), key).agg(F.max(F.struct(ts, value)).alias("x"))
    return rows.select(F.col(key).cast("string").alias(key), F.col(f"x.{ts}").alias("created_at"), F.col(f"x.{value}").cast("string").alias(value))


def guarded(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: empty batches leave the previous output."""

    def run(batch: DataFrame, epoch: int) -> None:
        if batch.limit(1).count():
            write(batch, epoch)

    return run


def drained(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Appends what there is now to a table in the shared folder and returns the table.

    Rows that a watermark may still change aren't appended yet; they come with a later call on the same checkpoint.
    """
    path = checkpoint or f"{shared_dir(stream.sparkSession)}/siftwell-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def upserted(stream: DataFrame, keys: list[str], order: str, checkpoint: str | None = None) -> DataFrame:
    """Runs an update-mode stream over what there is now: its latest row per key, from a table of all updates.

    Each batch of updates lands under its number, so a batch that is run again replaces itself.
    """
    path = checkpoint or f"{shared_dir(stream.sparkSession)}/siftwell-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={epoch}")

    query = stream.writeStream.outputMode("update").foreachBatch(guarded(write)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{path}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), F.struct(order, "batch")).alias("x")).select("x.*")
