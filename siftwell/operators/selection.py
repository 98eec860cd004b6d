"""Orders, quotas and constrained selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import clean
from siftwell.functions.times import local_date


def output_order() -> list[Column]:
    return [local_date(F.col("published_at")).desc(), F.desc("score"), F.desc("published_at"), F.asc("id")]


def per_group(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group; unknown groups (null) are a group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def preselected(rows: DataFrame, per_category: int = 10, extra: int = 4, most: int = 30) -> DataFrame:
    """Rows (protected, connection_type, score, feed_priority, published_at, category, id): caps per category apart for
    protected rows (`extra` more), then the first `most` in order."""
    order = [F.desc("protected"), F.col("connection_type").isNotNull().desc(), F.desc("score"), (F.col("feed_priority") == "primary").desc(), F.desc("published_at"), F.asc("id")]
    own = Window.partitionBy("category", "protected").orderBy(*order)
    cap = F.when(F.col("protected"), per_category + extra).otherwise(per_category)
    return rows.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= cap).drop("__n").orderBy(*order).limit(most)


@dataclass(frozen=True)
class Limits:
    min_domestic: int = 8
    min_final: int = 10
    max_final: int = 15
    per_category: int = 5
    max_overseas: int = 3
    per_source: int = 2
    strict_domestic: int = 12
    strict_overseas: int = 16
    relaxed_domestic: int = 7
    relaxed_overseas: int = 12


def _steps(limits: Limits) -> list[tuple[bool, bool, int]]:
    """Passes as (strict, domestic only, target)."""
    return [(True, True, limits.min_domestic), (True, False, limits.max_final), (False, True, limits.min_domestic), (False, False, limits.min_final)]


def _step(limits: Limits, strict: bool, domestic_only: bool, target: int):
    """A pass's step: the chosen rows with x, if it may be added."""
    low_d, low_o = (limits.strict_domestic, limits.strict_overseas) if strict else (limits.relaxed_domestic, limits.relaxed_overseas)

    def step(acc: Column, x: Column) -> Column:
        many = lambda test: F.size(F.filter(acc, test))
        count = many(lambda y: y["is_domestic"]) if domestic_only else F.size(acc)
        good = x["score"] >= F.when(x["is_domestic"], low_d).otherwise(low_o)
        fits = (F.size(acc) < limits.max_final) & ~F.exists(acc, lambda y: y["id"] == x["id"]) & (many(lambda y: y["category"] == x["category"]) < limits.per_category)
        fits = fits & (x["is_domestic"] | (many(lambda y: ~y["is_domestic"]) < limits.max_overseas)) & (many(lambda y: y["own_source"] == x["own_source"]) < limits.per_source)
        fits = fits & good & (count < target)
        if strict:
            fits = fits & x["allowed"]
        if domestic_only:
            fits = fits & x["is_domestic"]
        return F.when(fits, F.concat(acc, F.array(x))).otherwise(acc)

    return step


def constrained(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Selection in four passes under caps on total, category, source and overseas rows.

    rows: id, score, category, source, is_domestic, source_allowed, published (date text) and connection_type; rows
    without a connection take no part. Domestic rows go first, then higher scores, later dates, smaller ids. Strict
    passes take allowed sources from a higher score up; relaxed ones run only while there are too few. Sources are told
    apart without case; a row without one is a source of its own. Only the best rows can be chosen: within a category,
    source, domestic and allowed group the first per_source, and beyond sources no more than max_final with those that
    full sources hold back, which bounds what is folded in one task whatever the input's size.
    """
    order = [F.desc("score"), F.desc("published"), F.asc("id")]
    named = F.nullif(F.lower(clean(F.col("source"))), F.lit(""))
    rows = rows.where("connection_type is not null").withColumn("__source", F.coalesce(F.concat(F.lit("s"), named), F.concat(F.lit("i"), F.col("id").cast("string"))))
    short = per_group(rows, ["category", "__source", "is_domestic", "source_allowed"], order, limits.per_source)
    short = per_group(short, ["category", "is_domestic", "source_allowed"], order, limits.max_final * (limits.max_final // limits.per_source + 1))
    domestic = F.coalesce("is_domestic", F.lit(False)).alias("is_domestic")
    item = F.struct("id", "score", F.coalesce("category", F.lit("")).alias("category"), "source", F.col("__source").alias("own_source"), domestic, F.coalesce("source_allowed", F.lit(True)).alias("allowed"), "published")
    ordered = F.array_sort(F.collect_list(item), lambda a, b: F.when(a["is_domestic"] != b["is_domestic"], F.when(a["is_domestic"], -1).otherwise(1)).when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["published"] != b["published"], F.when(a["published"] > b["published"], -1).otherwise(1)).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    held = short.agg(ordered.alias("items"))
    kind = held.schema["items"].dataType.simpleString()
    chosen = F.array().cast(kind)
    for strict, domestic_only, target in _steps(limits):
        held = held.withColumn("chosen", F.aggregate("items", chosen, _step(limits, strict, domestic_only, target)))
        chosen = F.col("chosen")
    return held.select(F.inline("chosen")).withColumnRenamed("allowed", "source_allowed").drop("own_source")


def shortages(selected: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    out = selected.agg(F.count("*").alias("total"), F.count_if("is_domestic").alias("domestic"))
    return out.withColumn("reasons", F.array_compact(F.array(F.when(F.col("domestic") < limits.min_domestic, "domestic_shortage"), F.when(F.col("total") < limits.min_final, "final_shortage"))))


def _with_next(items: Column, chosen: Column, bonus: int) -> Column:
    """The chosen and the best that is left."""
    left = F.filter(items, lambda x: ~F.exists(chosen, lambda y: y["event_key"] == x["event_key"]))
    worth = lambda x: x["importance"] + F.when(F.exists(chosen, lambda y: y["category"] == x["category"]), 0).otherwise(bonus)
    ranked = F.transform(left, lambda x: F.struct((-worth(x)).alias("minus"), x["id"].alias("key"), x.alias("item")))
    top = F.get(F.array_sort(ranked), F.lit(0))["item"]
    return F.when(top.isNotNull(), F.concat(chosen, F.array(top))).otherwise(chosen)


def diversified(rows: DataFrame, k: int = 3, bonus: int = 7) -> DataFrame:
    """k rows (id, importance, category, event_key): each time the best of importance plus a bonus for an unused
    category, event keys not used before. Per category only the best of each event key, k deep, can be chosen."""
    best = per_group(rows, ["category", "event_key"], [F.desc("importance"), F.asc("id")], 1)
    best = per_group(best, ["category"], [F.desc("importance"), F.asc("id")], 3 * k)
    out = best.agg(F.collect_list(F.struct("id", "importance", "category", "event_key")).alias("items"))
    kind = out.schema["items"].dataType.simpleString()
    chosen = F.array().cast(kind)
    for n in range(k):
        out = out.withColumn(f"c{n}", _with_next(F.col("items"), chosen, bonus))
        chosen = F.col(f"c{n}")
    return out.select(F.posexplode(chosen).alias("place", "x")).select((F.col("place") + 1).alias("place"), "x.*")


def display_order(mode: str) -> list[Column]:
    """importance, or latest (domestic rows first)."""
    return [F.desc("importance"), F.desc("published"), F.asc("id")] if mode == "importance" else [F.desc("is_domestic"), F.desc("published"), F.desc("score"), F.asc("id")]


def budget_flag(order: list[Column], most: int, eligible: Column) -> Column:
    """True for the first `most` eligible rows of all, given a window over a bounded candidate list."""
    return eligible & (F.row_number().over(Window.partitionBy(eligible).orderBy(*order)) <= most)


def newest(rows: DataFrame, column: str, most: int = 12) -> DataFrame:
    return rows.select(column).distinct().orderBy(F.desc(column)).limit(most)


def top_excluded(rows: DataFrame, most: int = 20) -> DataFrame:
    return rows.where("exclude_reason is not null").orderBy(F.desc("score"), "title", "id").limit(most)
