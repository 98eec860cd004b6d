"""Ordered greedy deduplication: a row stays unless an earlier row that stays is its duplicate."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.text import fingerprint, match_form
from siftwell.functions.urls import canonical
from siftwell.operators.joins import event_forms, event_pairs, similar_title_pairs


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a session within one process may leave it unset."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read back, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of what stored() returned."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/siftwell-" in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place in the order (unique; the order must be total). Range-partitioned, then counted up per part."""
    parts = rows.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    parts = stored(parts)
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(before.select("__p", "__first", "__before"), "__p").withColumn(name, F.col("__m") - F.col("__first") + F.col("__before")).drop("__p", "__m", "__first", "__before")


def greedy_kept(nodes: DataFrame, member: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranks that stay. nodes: rank; member: rank, g; edges: g, h (both ways): rows of g and h are duplicates.

    Rows that are duplicates of the same rows share a group g, which is its own partner if it has an edge to itself, so
    a group of n copies costs n rows, not n squared pairs. A round keeps what has no undecided or kept earlier partner
    and removes what has a kept one; the result is that of going through the rows in order. There are as many rounds as
    the longest chain of decisions has steps.
    """
    member, edges = stored(member), stored(edges.distinct())
    state = stored(nodes.select("rank", F.lit(None).cast("boolean").alias("kept")))
    while True:
        held = member.join(state.where("kept is null or kept"), "rank")
        first = held.groupBy("g").agg(F.min(F.when(F.col("kept"), F.col("rank"))).alias("k"), F.min(F.when(F.col("kept").isNull(), F.col("rank"))).alias("o"))
        around = first.join(edges, "g").groupBy(F.col("h").alias("g")).agg(F.min("k").alias("k"), F.min("o").alias("o"))
        told = member.join(around, "g").groupBy("rank").agg(F.min("k").alias("k"), F.min("o").alias("o"))
        decided = F.coalesce(F.col("kept"), F.when(F.col("k") < F.col("rank"), F.lit(False)).when(F.col("o").isNull() | (F.col("o") >= F.col("rank")), F.lit(True)))
        before, state = state, stored(state.join(told, "rank", "left").select("rank", decided.alias("kept")))
        discard(before)
        if not state.where("kept is null").limit(1).count():
            discard(member, edges)
            return state.where("kept").select("rank")


def dedup_order() -> list[Column]:
    """Allowed sources first, then priority, score and time, all falling; the id decides ties."""
    priority = F.when(F.col("feed_priority") == "primary", 2).when(F.col("feed_priority") == "secondary", 1).otherwise(0)
    return [F.desc("source_allowed"), priority.desc(), F.desc("score"), F.desc("published_at"), F.asc("id")]


#: Rows that are decided at once, at first; each round decides twice as many.
FIRST_ROWS = 4096


def articles(rows: DataFrame, order: list[Column], distinct_urls: bool = True) -> DataFrame:
    """Rows (id, url, title, ...) that stay, url canonical: no null URL, no URL or similar title of an earlier kept row.

    Each round decides the first open rows beside those that stay already, and drops what has the URL or the very title
    of one that stays. Titles are compared with those that stay and within a round, not with all others; there are as many
    rounds as doublings of the first one's rows.
    """
    valid = ranked(rows.withColumn("url", canonical(F.col("url"))).where("url is not null"), order)
    left = stored(valid.select("rank", "url", "title", match_form(F.col("title")).alias("form")))
    kept, size = left.limit(0), FIRST_ROWS
    while n := left.count():
        last = left.agg(F.percentile_approx("rank", size / n, 10000)).first()[0] if n > 2 * size else None
        block = stored(kept.union(left.where(F.col("rank") <= last) if last is not None else left))
        before, kept = kept, stored(block.join(_stay(block, distinct_urls), "rank", "left_semi").select(*block.columns))
        rest = left.where(F.col("rank") > last) if last is not None else left.limit(0)
        if distinct_urls:
            rest = rest.join(kept.select("url"), "url", "left_anti")
        # A title without letters or digits is nobody's duplicate, not even of its own repeat.
        rest = rest.join(kept.where(fingerprint(F.col("title")) != "").select("form").distinct(), "form", "left_anti")
        gone, left, size = left, stored(rest.select(*block.columns)), 2 * size
        discard(before, gone, block)
    discard(left)
    return valid.join(kept.select("rank"), "rank", "left_semi")


def _stay(forms: DataFrame, distinct_urls: bool) -> DataFrame:
    """Ranks of the rows (rank, url, title, form) that stay among themselves."""
    titles = forms.groupBy("form").agg(F.min("rank").alias("id"), F.min_by("title", "rank").alias("title"))
    close = similar_title_pairs(titles.select("id", "title"))
    by_title = forms.join(titles.select("form", "id"), "form").select("rank", F.concat(F.lit("t"), "id").alias("g"))
    by_url = forms.select("rank", F.concat(F.lit("u"), "url").alias("g"))
    close = stored(close.select("a", "b"))
    both = close.union(close.select("b", "a")).toDF("a", "b").select(F.concat(F.lit("t"), "a").alias("g"), F.concat(F.lit("t"), "b").alias("h"))
    own = titles.where(fingerprint(F.col("title")) != "").select(F.concat(F.lit("t"), "id").alias("g"))
    own = own.union(by_url.select("g").distinct()) if distinct_urls else own
    member = by_title.union(by_url) if distinct_urls else by_title
    return greedy_kept(forms, member, both.union(own.select("g", F.col("g").alias("h"))))


#: Rows of each event that are decided at once, at first and at most, and what their entities and bigrams may come to.
BLOCK, MOST_BLOCK, BLOCK_ITEMS = 64, 1024, 200_000


def by_event(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (rank, id, title, event, entities, amounts, rounds) that stay, and the removed: id, title, kept_title, reason.

    Each round decides the first open rows of every event among themselves and then removes what those that stay are
    repeated by, so that rows meet the few that stay and not each other. All other rows of an event that share a token
    and an amount or a round with one that stays are its repeats, which bounds how many stay.
    """
    left, gone, size = stored(event_forms(rows)), [], BLOCK
    while not left.isEmpty():
        nth, sizes = Window.partitionBy("event").orderBy("rank"), F.size("entities") + F.size("g")
        # Rows are counted by event and rank alone, of the first rows only.
        block = left.select("event", "rank", sizes.alias("n")).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= size)
        block = block.withColumn("held", F.sum("n").over(nth.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("nth") == 1) | (F.col("held") <= BLOCK_ITEMS))
        block = stored(left.join(F.broadcast(block.select("rank")), "rank", "left_semi"))
        pairs = stored(event_pairs(block, block).select("a", "b"))
        kept = greedy_kept(block, block.select("rank", F.col("rank").alias("g")), pairs.union(pairs.select("b", "a")).toDF("g", "h"))
        found = event_pairs(block.join(F.broadcast(kept), "rank", "left_semi"), left)
        found = stored(found.groupBy("b").agg(F.min(F.struct("a", "reason")).alias("first")).select(F.col("b").alias("rank"), "first.*"))
        gone.append(found)
        before, left = left, stored(left.join(found, "rank", "left_anti").join(F.broadcast(block.select("rank")), "rank", "left_anti"))
        discard(before, block, pairs, kept)
        size = min(2 * size, MOST_BLOCK)
    discard(left)
    by = reduce(DataFrame.union, gone) if gone else rows.sparkSession.createDataFrame([], "rank long, a long, reason string")
    items = rows.join(by, "rank", "left_anti")
    by = by.join(rows.select(F.col("rank").alias("a"), F.col("title").alias("kept_title")), "a")
    return items, rows.select("rank", "id", "title").join(by, "rank").select("id", "title", "kept_title", "reason")


def best_per_key(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row per key in the order; rows with a null or empty key are all dropped."""
    first = Window.partitionBy("__key").orderBy(*order)
    return rows.withColumn("__key", key).where("__key <> ''").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__key", "__n")
