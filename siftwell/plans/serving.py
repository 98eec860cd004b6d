"""Serving queries over published items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import search_form
from siftwell.functions.urls import host, href
from siftwell.operators.aggregates import statistics
from siftwell.operators.rules import facts, is_overseas, stored_or_found
from siftwell.operators.selection import display_order, diversified
from siftwell.packs import Pack


def with_region(items: DataFrame, pack: Pack) -> DataFrame:
    return items.withColumn("is_domestic", ~is_overseas(pack, F.col("category"), F.col("source"), host(F.col("url"))))


def found(query: str) -> Column:
    """Whether title, summary, source or company hold the query; an empty query finds all."""
    text = search_form(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("title", "summary", "source", "company"))))
    return text.contains(" ".join(query.lower().split()))


def listed(items: DataFrame, category: str | None = None, region: str | None = None, search: str = "", sort: str = "importance") -> DataFrame:
    rows = items.where(found(search))
    if category:
        rows = rows.where(F.col("category") == category)
    if region:
        rows = rows.where(F.col("is_domestic") == (region == "domestic"))
    return rows.orderBy(*display_order(sort))


def featured(items: DataFrame, k: int = 3) -> DataFrame:
    return diversified(items, k)


def card(items: DataFrame, highlighted: str) -> DataFrame:
    return statistics(items, ~F.col("is_domestic"), "category", highlighted)


def event_key(items: DataFrame) -> Column:
    """What marks items as one event: company, event and amount where there are any, else the title."""
    parts = F.concat_ws("|", *(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("company", "event", "amount")))
    return F.when(F.coalesce("company", F.lit("")) == "", F.lower(F.col("title"))).otherwise(parts)


def normalised(document: DataFrame) -> DataFrame:
    """Category counts taken anew from the items, never from the document; items without a title drop."""
    return document.where(F.col("title").isNotNull()).groupBy("category").agg(F.count("*").alias("n"))


def cards(items: DataFrame, pack: Pack) -> DataFrame:
    """What a list shows of each item: id, link, title, summary, facts (stored ones first), region and category."""
    found = facts(pack, F.col("title"), F.coalesce("summary", F.lit("")))
    stored = {n: F.col(n) for n in ("company", "amount", "stage", "event", "industry") if n in items.columns}
    rows = with_region(items, pack)
    region = F.when(F.col("is_domestic"), "domestic").otherwise("overseas").alias("region")
    return rows.select("id", href(F.col("url")).alias("link"), "title", F.coalesce("summary", F.lit("")).alias("summary"), stored_or_found(stored, found).alias("facts"), region, "category")


def filters(items: DataFrame) -> DataFrame:
    """kind, value, n: the categories and regions that the items can be narrowed to."""
    region = F.when(F.col("is_domestic"), "domestic").otherwise("overseas")
    kinds = F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")), F.struct(F.lit("region").alias("kind"), region.alias("value")))
    return items.select(F.inline(kinds)).where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))
