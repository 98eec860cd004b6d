"""Counts for reports: zero-filled, by reason, per source, funnels, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_over_domain(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Count per value of a fixed domain, zeros included; values outside it aren't counted."""
    fixed = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return fixed.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def reason_counts(rows: DataFrame, reason: str = "exclude_reason") -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def failure_rollup(rows: DataFrame, reason: str, source: str) -> DataFrame:
    """Failures by reason and by reason and source in one pass.

    Counted before the null reasons go: a filter on the reason would sink below it and compute it twice.
    """
    held = rows.groupBy(reason, source).agg(F.count(reason).alias("__n")).where("__n > 0")
    return held.rollup(reason, source).agg(F.sum("__n").alias("n"))


def success_rates(rows: DataFrame, source: str, ok: Column) -> DataFrame:
    out = rows.groupBy(source).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))
    return out.withColumn("percent", F.round(100 * F.col("n_ok") / (F.col("n_ok") + F.col("n_failed")), 1))


def diagnostics(rows: DataFrame, reasons: list[str], reason: str = "exclude_reason") -> DataFrame:
    """One row with a counter per named reason, and the total."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(reason) == r).alias(r) for r in reasons))


def funnel(counts: dict[str, Column], rows: DataFrame, most: int = 4) -> DataFrame:
    """The `most` largest non-zero of the named counters."""
    one = rows.agg(*(F.count_if(c).alias(k) for k, c in counts.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("stage"), F.col(f"`{k}`").alias("n")) for k in counts))
    return one.select(F.inline(pairs)).where("n > 0").orderBy(F.desc("n"), "stage").limit(most)


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, v: a + v)


def date_bounds(rows: DataFrame, date: str) -> DataFrame:
    return rows.agg(F.min(date).alias("first"), F.max(date).alias("latest"), F.countDistinct(date).alias("n_dates"))


def statistics(rows: DataFrame, overseas: Column, category: str, highlighted: str) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(~overseas).alias("domestic"), F.count_if(overseas).alias("overseas"), F.count_if(F.col(category) == highlighted).alias("highlighted"), F.countDistinct(category).alias("n_categories"))


def counts_of(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def totals_of(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.groupBy(column).agg(F.sum(value).alias("total"))
