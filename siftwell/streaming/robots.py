"""Robots rules beside a stream of articles: a memo of what each origin allows, joined to every batch and kept fresh.

A batch looks its origins up in the memo, a table in the shared folder; only origins that it lacks, or holds for longer than
`ttl`, are fetched, each once and in the tasks that hold them, and appended under the batch's number. Then the batch joins
the memo, its longest rule decides, and rows land with `allowed`. A batch that is run again replaces what it wrote.

Defined cases: an origin whose fetch fails or gives nothing has no rules and allows all, until it is asked again; a null
URL has the origin '' and is allowed; an empty batch writes nothing, and a stream without rows gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftwell.functions.urls import origin
from siftwell.operators.dedup import shared_dir
from siftwell.sources.feeds import robots_allowed
from siftwell.streaming.windows import guarded

MEMO = "origin string, text string, fetched_at timestamp"


def memo_of(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of each origin: origin, text, fetched_at."""
    try:
        rows = spark.read.parquet(f"{path}/memo")
    except AnalysisException:  # before the first batch
        return spark.createDataFrame([], MEMO)
    return rows.groupBy("origin").agg(F.max_by(F.struct("text", "fetched_at"), F.struct("fetched_at", "batch")).alias("x")).select("origin", "x.text", "x.fetched_at")


def robots_memo(stream: DataFrame, fetch: Callable[[str], str | None], agent: str, path: str | None = None, ttl: str = "1 day", now: Column | None = None) -> DataFrame:
    """Runs a stream (id, url, ...) over what there is now: id, url and allowed of all its rows, as a table.

    fetch gets an origin and returns the text of its robots.txt; now: the time that entries are fetched and judged at,
    over a batch's columns (the latest of a batch counts), else the clock.
    """
    spark = stream.sparkSession
    path = path or f"{shared_dir(spark)}/siftwell-{uuid.uuid4().hex}"
    kind = dict(stream.dtypes)["id"]

    def fetched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = []
            for x in pdf["origin"]:
                try:
                    texts.append(fetch(x) or "")
                except Exception:  # noqa: BLE001  no rules are known then
                    texts.append("")
            yield pdf.assign(text=texts)

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        stamp = batch.agg(F.max(now if now is not None else F.current_timestamp()).alias("at")).first()["at"]
        held = memo_of(spark, path).where(F.col("fetched_at") >= F.lit(stamp) - F.expr(f"INTERVAL {ttl}"))
        origins = batch.select(F.coalesce(origin(F.col("url")), F.lit("")).alias("origin")).distinct().where("origin <> ''")
        lacking = origins.join(held, "origin", "left_anti").mapInPandas(fetched, "origin string, text string")
        lacking.withColumn("fetched_at", F.lit(stamp)).write.mode("overwrite").parquet(f"{path}/memo/batch={epoch}")
        known = memo_of(spark, path).join(origins, "origin", "left_semi")
        rows = robots_allowed(batch.select("id", "url"), known, agent).select("id", "url", "allowed")
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={epoch}")
        batch.unpersist()

    query = stream.writeStream.foreachBatch(guarded(write)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    columns = f"id {kind}, url string, allowed boolean"
    try:
        return spark.read.schema(columns).parquet(f"{path}/rows")
    except AnalysisException:  # no rows have come yet
        return spark.createDataFrame([], columns)
