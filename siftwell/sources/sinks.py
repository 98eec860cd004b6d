"""Sinks: daily partitions, index, status, audit and cache; an empty result doesn't overwrite."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.text import clean


def write_briefing(items: DataFrame, path: str, date: str, force: bool = False) -> str:
    """Overwrites the date's partition; nothing is written for no items unless forced. Returns what happened."""
    if not force and not items.limit(1).count():
        return "empty_result_preserved"
    dated = items.withColumn("briefing_date", F.lit(date).cast("date"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("briefing_date").parquet(path)
    return "written"


def read_briefings(spark: SparkSession, path: str) -> DataFrame:
    """All partitions; columns that older ones lack are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def index(briefings: DataFrame) -> DataFrame:
    """One row: dates in order and the latest."""
    dates = briefings.select(F.col("briefing_date").cast("string").alias("d")).distinct()
    return dates.agg(F.array_sort(F.collect_set("d")).alias("dates"), F.max("d").alias("latest"))


def latest_nonempty(briefings: DataFrame) -> DataFrame:
    """Rows of the newest date that has any."""
    return briefings.join(briefings.agg(F.max("briefing_date").alias("briefing_date")), "briefing_date", "left_semi")


def on_date(briefings: DataFrame, date: str) -> DataFrame:
    return briefings.where(F.col("briefing_date") == F.lit(date).cast("date"))


def written(rows: DataFrame, path: str, counters: dict[str, Column], mode: str = "overwrite") -> dict:
    """Writes the rows as Parquet and returns the counters, taken in the pass that writes: rows aren't read for them again."""
    seen = Observation()
    rows.observe(seen, *(c.alias(name) for name, c in counters.items())).write.mode(mode).parquet(path)
    return seen.get


def write_status(spark: SparkSession, path: str, ran: dt.datetime, success: bool, raw: int, candidates: int, final: int, sources_ok: int, sources_failed: int, message: str | None = None) -> None:
    row = spark.createDataFrame([(ran, success, raw, candidates, final, sources_ok, sources_failed, message)], "last_run_at timestamp, success boolean, raw_count int, candidate_count int, final_count int, sources_ok int, sources_failed int, message string")
    row.withColumn("message", F.when(F.col("message").isNotNull(), F.substring(clean(F.col("message")), 1, 200))).write.mode("overwrite").json(path)


def audit_report(audit: DataFrame, selected: DataFrame, key: list[str]) -> DataFrame:
    """audit with final_selected, selected rows first, then by score and title (Korean collation)."""
    rows = audit.join(selected.select(*key).distinct().withColumn("final_selected", F.lit(True)), key, "left").withColumn("final_selected", F.coalesce("final_selected", F.lit(False)))
    return rows.orderBy(F.desc("final_selected"), F.desc("score"), F.collate("title", "ko"))


def upserted_cache(cache: DataFrame, entries: DataFrame, most: int = 500) -> DataFrame:
    """Old and new entries, the newest of each key, the newest `most`."""
    newest = Window.partitionBy("key").orderBy(F.desc("created_at"), F.desc("__new"))
    both = cache.withColumn("__new", F.lit(0)).unionByName(entries.withColumn("__new", F.lit(1)))
    return both.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "__new").orderBy(F.desc("created_at"), "key").limit(most)


def write_cache(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").json(path)
