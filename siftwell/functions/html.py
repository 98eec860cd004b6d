"""HTML to article text by patterns, as column expressions over a pack's boilerplate rules."""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.text import SPACES, any_matches, clean, decode_references, let, regex

#: Elements that hold no article text.
NOISE = ["script", "style", "noscript", "iframe", "form", "nav", "aside", "footer"]
MIN_BODY = 300
MAX_BODY = 12_000
MIN_BLOCK = 15
_BLOCK_END = r"(?i)</(?:p|h[1-6]|li|blockquote|div|section|article)>"


def without_noise(page: Column) -> Column:
    """Without comments and noise elements, each to its first end tag."""
    page = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in NOISE:
        page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return page


def selector(text: str) -> tuple[str, str] | None:
    """Kind (tag, id, class) and name of a simple selector's last part; None for others."""
    last = (text or "").split()[-1:] or [""]
    if m := re.fullmatch(r"(?:[A-Za-z][\w-]*)?([#.])([\w-]+)", last[0]):
        return ("id" if m[1] == "#" else "class", m[2])
    return ("tag", last[0].lower()) if re.fullmatch(r"[A-Za-z][\w-]*", last[0]) else None


def element_pattern(text: str) -> str | None:
    """A pattern for the selector's elements, up to the first end tag of that name (nested ones cut it short)."""
    found = selector(text)
    if not found:
        return None
    kind, name = found
    name = re.escape(name)
    if kind == "tag":
        return rf"(?is)<({name})\b[^>]*>.*?</\1>"
    inside = rf"[^\"']*(?<![\w-]){name}(?![\w-])[^\"']*" if kind == "class" else name
    return rf"(?is)<([a-z][a-z0-9]*)\b[^>]*\b{kind}\s*=\s*[\"']{inside}[\"'][^>]*>.*?</\1>"


def without_selected(page: Column, selectors: list[str]) -> Column:
    for s in selectors:
        if p := element_pattern(s):
            page = F.regexp_replace(page, p, " ")
    return page


def selected(page: Column, selectors: list[str]) -> Column:
    """The selectors' elements, in the selectors' order, on lines of their own."""
    found = [F.regexp_extract_all(page, F.lit(p), F.lit(0)) for s in selectors if (p := element_pattern(s))]
    return F.array_join(F.concat(*found), "\n") if found else F.lit("")


def body_region(page: Column) -> Column:
    """The article's inside, else main's, else the body's, else the page."""
    region = [F.nullif(F.regexp_extract(page, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), F.lit("")) for t in ("article", "main", "body")]
    return F.coalesce(*region, page)


def is_boilerplate(text: Column, pack) -> Column:
    own = any_matches(text, pack.bylines) | (text.rlike("^[▶◆■●※]") & (F.length(text) < 100)) | any_matches(text, pack.boilerplate)
    return F.coalesce(text == "", F.lit(True)) | own


def stripped(text: Column, pack) -> Column:
    """clean, without leading tags, agency marks, edit dates, trailing bylines, captions, addresses and menus."""
    out = clean(text)
    for pattern, instead in pack.strip:
        out = F.regexp_replace(out, regex(pattern), instead)
    return F.trim(F.regexp_replace(out, SPACES, " "))


def blocks(page: Column, pack) -> Column:
    """Texts between block ends, stripped; short and boilerplate ones out."""
    cut = F.split(F.regexp_replace(without_noise(page), _BLOCK_END, "\n"), "\n+")
    return F.filter(F.transform(cut, lambda b: stripped(b, pack)), lambda b: (F.length(b) >= MIN_BLOCK) & ~is_boilerplate(b, pack))


def block_key(block: Column) -> Column:
    return F.lower(F.regexp_replace(block, SPACES, ""))


def article_text(page: Column, pack) -> Column:
    """The distinct blocks in order, as one text."""

    def distinct(b: Column) -> Column:
        return F.filter(b["text"], lambda _, i: F.array_position(b["key"], F.get(b["key"], i)) == i + 1)

    keyed = let(blocks(page, pack), lambda own: F.struct(own.alias("text"), F.transform(own, block_key).alias("key")))
    return F.trim(F.array_join(let(keyed, distinct), " "))


def clipped(text: Column, most: int = MAX_BODY) -> Column:
    """At most `most` characters, up to the last sentence end if that keeps 65 % of them."""
    head = F.substring(text, 1, most)
    tail = F.length(F.regexp_extract(head, r"(?s)^.*[.!]", 0))
    return F.when(F.length(text) <= most, text).when(tail >= most * 0.65, F.trim(F.substr(head, F.lit(1), tail))).otherwise(F.trim(head))


def extraction(page: Column, pack, body_selectors: list[str] = (), remove: list[str] = (), least: int = MIN_BODY) -> Column:
    """Struct of text and failure: the configured body if it is long enough, else the region's; gates as reasons."""
    kept = without_selected(page, list(remove))
    configured = article_text(selected(kept, list(body_selectors)), pack) if body_selectors else F.lit("")
    text = F.when(F.length(configured) >= least, configured).otherwise(article_text(body_region(kept), pack))
    paywalled = any_matches(clean(page), pack.paywall) & (F.length(text) < max(1500, 3 * least))
    failure = F.when(page.isNull(), "fetch_failed").when(paywalled, "paywall").when(F.length(text) < least, "body_too_short")
    return F.struct(F.when(failure.isNull(), clipped(text)).otherwise("").alias("text"), failure.alias("failure"))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not, decoded; null if the tag hasn't it."""
    found = lambda t: [F.nullif(F.regexp_extract(t, rf"(?i)(?<![\w-]){name}\s*=\s*{q}", 1), F.lit("")) for q in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")]
    return decode_references(let(tag, lambda t: F.coalesce(*found(t))))


def meta(page: Column, key: str) -> Column:
    """Content of the first meta element of that property or name."""
    tags = F.regexp_extract_all(page, F.lit("(?is)<meta\\b[^>]*>"), F.lit(0))
    own = F.filter(tags, lambda t: t.rlike(rf"(?i)(?:property|name|itemprop)\s*=\s*[\"']?{re.escape(key)}[\"'\s/>]"))
    return attribute(F.get(own, F.lit(0)), "content")


def title(page: Column, fallback: Column | None = None, selectors: tuple[str, ...] = ()) -> Column:
    """og:title, the configured selectors' element (those of meta elements aside), first h1, title element, fallback."""
    configured = [F.nullif(clean(selected(page, [s])), F.lit("")) for s in selectors if s and not s.startswith("meta")]
    inside = configured + [F.nullif(clean(F.regexp_extract(page, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1)), F.lit("")) for t in ("h1", "title")]
    return F.coalesce(F.nullif(clean(meta(page, "og:title")), F.lit("")), *inside, fallback if fallback is not None else F.lit(None).cast("string"))


def description(page: Column, most: int = 1000) -> Column:
    return F.substring(clean(F.coalesce(meta(page, "og:description"), meta(page, "description"))), 1, most)


def published(page: Column, keys: tuple[str, ...] = ("article:published_time", "published_time", "date", "pubdate")) -> Column:
    """The first of the metas, JSON-LD, datetime attribute and inline date that parses."""
    from siftwell.functions.times import parsed

    json_ld = F.regexp_extract(page, r'"datePublished"\s*:\s*"([^"]+)"', 1)
    attr = F.regexp_extract(page, r"(?i)datetime\s*=\s*[\"']([^\"']+)[\"']", 1)
    inline = F.regexp_replace(F.regexp_extract(clean(page), r"(20\d{2}[.\-/]\s?\d{1,2}[.\-/]\s?\d{1,2})", 1), r"[./]\s?", "-")
    return F.coalesce(*(parsed(meta(page, k)) for k in keys), parsed(json_ld), parsed(attr), parsed(inline))


def original_url(page: Column) -> Column:
    """canonical link, og:url, meta refresh, first absolute anchor."""
    canonical = attribute(F.regexp_extract(page, r"(?is)<link\b[^>]*rel\s*=\s*[\"']?canonical[^>]*>", 0), "href")
    refresh = F.nullif(F.regexp_extract(page, r"(?is)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*url=([^\"'>\s]+)", 1), F.lit(""))
    anchor = F.nullif(F.regexp_extract(page, r"(?is)<a\b[^>]*href\s*=\s*[\"'](https?://[^\"']+)", 1), F.lit(""))
    return F.coalesce(canonical, meta(page, "og:url"), refresh, anchor)


_LINKS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("near", T.StringType())]))


def _anchor_matches(tag: str, selectors: list[str]) -> bool:
    for s in selectors:
        found = selector(s)
        if found and (found == ("tag", "a") or re.search(rf"\b{found[0]}\s*=\s*[\"'][^\"']*(?<![\w-]){re.escape(found[1])}(?![\w-])", tag)):
            return True
    return not selectors


def links(pages: DataFrame, key: str, selectors: list[str] = (), allow: list[str] = (), least_title: int = 8, most: int = 20) -> DataFrame:
    """key, at, url, title, near: a page's first `most` distinct links that the selectors and patterns let through."""
    wanted, patterns = list(selectors), [re.compile(p) for p in allow]

    @F.pandas_udf(_LINKS)
    def found(page: pd.Series, base: pd.Series) -> pd.Series:
        def one(text, root):
            out = []
            for m in re.finditer(r"<a\b([^>]*)>(.*?)</a>", text or "", re.I | re.S):
                href = re.search(r"href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", m[1], re.I)
                named = re.search(r"(?:aria-label|title)\s*=\s*[\"']([^\"']+)", m[1], re.I)
                if not href or not _anchor_matches(m[1], wanted):
                    continue
                try:
                    url = urljoin(root or "", entities.unescape(href[1] or href[2] or href[3] or "")).split("#")[0]
                except ValueError:
                    continue
                text_of = " ".join(entities.unescape(named[1] if named else re.sub(r"<[^>]*>", " ", m[2])).split())
                if url.startswith(("http://", "https://")) and len(text_of) >= least_title and (not patterns or any(p.search(url) for p in patterns)):
                    out.append({"at": m.start(), "url": url, "title": text_of, "near": text[max(0, m.start() - 500) : m.end() + 500]})
            return out

        return pd.Series([one(p, b) for p, b in zip(page, base, strict=True)])

    rows = pages.select(key, F.inline(found("html", "url")))
    first = Window.partitionBy(key, "url").orderBy("at")
    order = Window.partitionBy(key).orderBy("at")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return rows.drop("n")


def without_source(title: Column, source: Column, rounds: int = 3) -> Column:
    """The title without trailing "- source" parts."""
    for _ in range(rounds):
        tail = F.lower(F.trim(F.regexp_extract(title, r"\s[-–|]\s([^-–|]+)$", 1)))
        own = F.lower(F.trim(source))
        cut = (tail != "") & (own != "") & (own.contains(tail) | tail.contains(own))
        title = F.when(cut, F.trim(F.regexp_replace(title, r"\s[-–|]\s[^-–|]+$", ""))).otherwise(title)
    return title
