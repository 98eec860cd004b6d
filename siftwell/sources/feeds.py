"""Scans: feeds, sitemaps, list pages, robots rules, caches and archives. Fetched bytes come as rows or files."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.html import links
from siftwell.functions.similarity import search_similarity
from siftwell.functions.text import clean
from siftwell.functions.times import parsed
from siftwell.functions.urls import allowed, candidate, discovery_feed, host, is_safe, origin
from siftwell.operators.joins import longest_prefix
from siftwell.operators.rules import has_signal_or_keyword
from siftwell.packs import Pack


@dataclass(frozen=True)
class Source:
    """A feed and how it is read."""

    name: str
    type: str = "rss"
    url: str = ""
    base_url: str = ""
    allow: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    link_selectors: tuple[str, ...] = ()
    title_selector: str = ""
    date_selector: str = ""
    body_selectors: tuple[str, ...] = ()
    remove_selectors: tuple[str, ...] = ()
    max_items: int = 20
    weight: int = 0
    fetch_delay_ms: int = 0
    fetch_timeout_ms: int = 10_000
    priority: str = "primary"
    region: str = "domestic"
    enabled: bool = True
    fallback_for: str = ""
    fallback_threshold: int = 3


def source_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    rows = [(s.name, s.type, s.url, s.base_url, list(s.allow), list(s.hints), s.max_items, s.weight, s.priority, s.region, s.enabled, s.fallback_for, s.fallback_threshold) for s in sources]
    return spark.createDataFrame(rows, "name string, type string, url string, base_url string, allow array<string>, hints array<string>, max_items int, weight int, priority string, region string, enabled boolean, fallback_for string, fallback_threshold int")


_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "guid", "published", "description", "creator", "source")])
_FEED = T.StructType([T.StructField("entries", T.ArrayType(_ENTRY)), T.StructField("error", T.StringType())])


@F.pandas_udf(_FEED)
def _feed(text: pd.Series) -> pd.DataFrame:
    names = {"title": "title", "link": "link", "guid": "guid", "id": "guid", "pubdate": "published", "published": "published", "updated": "published", "date": "published", "description": "description", "summary": "description", "encoded": "description", "creator": "creator", "author": "creator", "source": "source"}

    def one(page: str | None) -> tuple[list[dict] | None, str | None]:
        try:
            root = ET.fromstring((page or "").strip().encode())
        except ET.ParseError as e:
            return [], f"parse: {e}"
        out = []
        for item in root.iter():
            if item.tag.rpartition("}")[2].lower() in ("item", "entry"):
                row = dict.fromkeys((f.name for f in _ENTRY), None)
                for x in item:
                    name = names.get(x.tag.rpartition("}")[2].lower())
                    if name and row[name] is None:
                        row[name] = (x.text or "").strip() or x.get("href") or x.get("url")
                out.append(row)
        return out, None

    return pd.DataFrame([one(t) for t in text], columns=["entries", "error"])


def rss(pages: DataFrame) -> DataFrame:
    """source, at, entry fields: a feed's first max_items entries; pages: source, text, max_items. Broken feeds give none."""
    rows = pages.withColumn("__feed", _feed("text")).select("source", "max_items", F.posexplode("__feed.entries").alias("at", "entry"))
    return rows.where(F.col("at") < F.col("max_items")).select(F.col("source").alias("feed"), "at", "entry.*")


def source_name(priority: Column, configured: Column, feed: Column, item_source: Column, creator: Column, author: Column) -> Column:
    """A primary feed's configured name (else its own); of other feeds the item's source, creator, author, feed."""
    named = lambda *cs: clean(F.coalesce(*(F.nullif(c, F.lit("")) for c in cs)))
    return F.when(priority == "primary", named(configured, feed)).otherwise(named(item_source, creator, author, feed))


def feed_status(pages: DataFrame) -> DataFrame:
    """source, succeeded, raw_count, error."""
    rows = pages.withColumn("__feed", _feed("text"))
    return rows.select("source", F.col("__feed.error").isNull().alias("succeeded"), F.coalesce(F.size("__feed.entries"), F.lit(0)).alias("raw_count"), F.col("__feed.error").alias("error"))


def sitemap(pages: DataFrame) -> DataFrame:
    """source, at, url, published of a sitemap's entries with a date and an allowed URL; pages: source, text, allow, max_items."""
    found = F.regexp_extract_all("text", F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))
    rows = pages.select("source", "allow", "max_items", F.posexplode(found).alias("at", "u"))
    value = lambda tag: F.trim(F.regexp_extract("u", rf"(?is)<{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1))
    rows = rows.select("source", "at", "allow", "max_items", value("loc").alias("url"), parsed(value("lastmod")).alias("published"))
    rows = rows.where(F.col("published").isNotNull() & allowed(F.col("url"), F.col("allow")))
    first = Window.partitionBy("source").orderBy("at")
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= F.col("max_items")).drop("n", "allow", "max_items")


def html_list(pages: DataFrame, pack: Pack, source: Source, details: DataFrame | None = None, robots: DataFrame | None = None, agent: str = "siftwell") -> DataFrame:
    """Links of list pages (page_id, url, html) whose title passes the keyword gate and which robots rules allow, with a
    date from the detail page or from near the link; links without a date drop. details: url, published; robots: origin, text."""
    rows = links(pages, "page_id", list(source.link_selectors), list(source.allow), most=source.max_items)
    rows = rows.where(has_signal_or_keyword(pack, F.col("title")))
    if robots is not None:
        rows = robots_allowed(rows.withColumn("id", F.xxhash64("page_id", "at")), robots, agent).where("allowed").drop("id", "allowed")
    near = parsed(F.regexp_replace(F.regexp_extract("near", r"(20\d{2}[.\-/]\s?\d{1,2}[.\-/]\s?\d{1,2})", 1), r"[./]\s?", "-"))
    rows = rows.withColumn("near_date", near).drop("near")
    if details is not None:
        rows = rows.join(details.select("url", "published").dropDuplicates(["url"]), "url", "left")
    else:
        rows = rows.withColumn("published", F.lit(None).cast("timestamp"))
    return rows.withColumn("published", F.coalesce("published", "near_date")).drop("near_date").where("published is not null")


def dispatched(pages: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """Union of what each type's reader makes of its pages, and the pages of types that have no reader."""
    parts = [read(pages.where(F.col("type") == kind)) for kind, read in readers.items()]
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, pages.where(~F.col("type").isin(*readers)).withColumn("error", F.concat(F.lit("unsupported type: "), "type"))


def fallback_sources(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """Fallback sources to run: their base gave fewer rows than their threshold. counts: name, raw_count."""
    base = counts.groupBy(F.col("name").alias("fallback_for")).agg(F.sum("raw_count").alias("n"))
    return sources.where("enabled and fallback_for <> ''").join(base, "fallback_for", "left").where(F.coalesce("n", F.lit(0)) < F.col("fallback_threshold")).drop("n")


def discovery_needed(candidates: DataFrame, enabled: bool, min_final: int = 10, min_domestic: int = 8) -> bool:
    """Whether search feeds run: allowed, and too few strong or strong domestic candidates."""
    if not enabled:
        return False
    strong = F.col("connection_type").isNotNull()
    row = candidates.agg(F.count_if(strong).alias("strong"), F.count_if(strong & F.col("is_domestic")).alias("domestic")).first()
    return row["strong"] < min_final or row["domestic"] < min_domestic


def discovery_feeds(queries: DataFrame) -> DataFrame:
    return queries.withColumn("url", discovery_feed(F.col("query")))


def fetched(pages: DataFrame, most_bytes: int = 5 << 20) -> DataFrame:
    """pages (url, status, content_type, html) with ok, reason: what a fetch would say of them."""
    reason = (
        F.when(F.col("status").isNull(), "network").when(~F.col("status").between(200, 299), F.concat(F.lit("http_"), F.col("status").cast("string")))
        .when(~F.coalesce("content_type", F.lit("text/html")).rlike("(?i)html|xml"), "content_type").when(F.octet_length("html") > most_bytes, "too_large")
    )
    return pages.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def failure_reason(error: Column, prefix: str = "fetch") -> Column:
    e = F.lower(error)
    return F.when(e.rlike("abort|timeout|timed out"), f"{prefix}_timeout").when(e.rlike("enotfound|eai_again|dns|name resolution"), f"{prefix}_dns").otherwise(f"{prefix}_network")


_RULES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("prefix", T.StringType())]))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """origin, kind, prefix of the rules for the agent or for all; robots: origin, text. Empty values say nothing."""
    name = agent.lower()

    @F.pandas_udf(_RULES)
    def rules(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            out, agents, in_rules = [], [], False
            for line in (t or "").splitlines():
                key, _, value = line.partition("#")[0].partition(":")
                key, value = key.strip().lower(), value.strip()
                if key == "user-agent":
                    agents = [value.lower()] if in_rules else [*agents, value.lower()]
                    in_rules = False
                elif key in ("allow", "disallow"):
                    in_rules = True
                    if value and any(a == "*" or a and a in name for a in agents):
                        out.append({"kind": key, "prefix": value})
            return out

        return text.map(one)

    return robots.dropDuplicates(["origin"]).select("origin", F.inline(rules("text")))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls (id, url) with `allowed` by the longest rule of their origin."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1)
    rows = urls.withColumns({"origin": F.coalesce(origin(F.col("url")), F.lit("")), "path": F.when(path == "", "/").otherwise(path)})
    return longest_prefix(rows, robots_rules(robots, agent)).drop("origin", "path")


def cache_entries(cache: DataFrame, now: Column, days: int = 30, most: int = 500) -> DataFrame:
    """Entries with a key, a summary and a time within the days, the newest `most`, one per key."""
    valid = cache.where(F.col("key").isNotNull() & F.col("summary").isNotNull() & (F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")))
    one = Window.partitionBy("key").orderBy(F.desc("created_at"), "summary")
    return valid.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n").orderBy(F.desc("created_at"), "key").limit(most)


def document(spark: SparkSession, path: str) -> DataFrame:
    """A published JSON document, one object or a list of them, as rows."""
    return spark.read.option("multiLine", True).json(path)


def cached(spark: SparkSession, path: str) -> DataFrame:
    """A cache's entries, one JSON object a line."""
    return spark.read.json(path)


def status(spark: SparkSession, path: str) -> DataFrame | None:
    """The last run's status; None where there is none or it can't be read."""
    try:
        found = document(spark, path)
        return found if found.columns and "_corrupt_record" not in found.columns else None
    except AnalysisException:
        return None


def publisher_search(articles: DataFrame, found: DataFrame, allow: list[str] = (), least: float = 0.48) -> DataFrame:
    """id, url, similarity: of the links that a publisher's search gave for an article, the one whose title is closest.

    articles: id, title, publisher (a URL); found: id, url, title. Links must be safe, on the publisher's host or below
    it, and match one of the patterns, if there are any.
    """
    bare = lambda u: F.regexp_replace(host(u), r"^www\.", "")
    rows = found.select("id", candidate(F.col("url")).alias("url"), F.col("title").alias("link_title")).join(articles.where(is_safe(F.col("publisher"))), "id")
    own, base = bare(F.col("url")), bare(F.col("publisher"))
    rows = rows.where(((own == base) | own.endswith(F.concat(F.lit("."), base))) & allowed(F.col("url"), F.array(*map(F.lit, allow)).cast("array<string>")))
    rows = rows.withColumn("similarity", search_similarity(F.col("title"), clean(F.col("link_title")))).where(F.col("similarity") >= least)
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "url")
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("id", "url", "similarity")


def archive_dates(spark: SparkSession, index: list[str], names: DataFrame) -> DataFrame:
    """Dates of the index and of files named YYYY-MM-DD.json (names: path), each once, in order."""
    named = names.select(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.json$", 1).alias("date"))
    listed = spark.createDataFrame([(d,) for d in index], "date string")
    return listed.union(named).where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).distinct().orderBy("date")


@dataclass
class Settings:
    """Knobs with their defaults; environment variables of the same names in capitals override them."""

    max_final_articles: int = 15
    min_final_articles: int = 10
    min_domestic_articles: int = 8
    max_overseas_articles: int = 3
    max_items_per_source: int = 2
    max_extraction_candidates: int = 30
    min_body_length: int = 300
    extra: dict = field(default_factory=dict)


def positive(value: str | None, fallback: int) -> int:
    try:
        n = int(str(value).strip())
    except ValueError:
        return fallback
    return n if n > 0 else fallback


def not_negative(value: str | None, fallback: int) -> int:
    try:
        n = int(str(value).strip())
    except ValueError:
        return fallback
    return n if n >= 0 else fallback


def settings(lines: list[str] = (), environment: dict[str, str] | None = None) -> Settings:
    """Settings from KEY=value lines, which don't override the environment; quotes around values go."""
    given = {}
    for line in lines:
        key, eq, value = line.partition("=")
        if eq and not key.strip().startswith("#"):
            given[key.strip()] = value.strip().strip("\"'")
    given |= dict(os.environ if environment is None else environment)
    out = Settings()
    for name, default in vars(out).copy().items():
        if isinstance(default, int):
            setattr(out, name, positive(given.get(name.upper()), default))
    return out
