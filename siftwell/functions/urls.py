"""URL normal forms and predicates as column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.text import clean, decode_named, let

#: Parameters that only track.
TRACKING = ["fbclid", "gclid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
_PARTS = r"^(https?)://(?:([^/?#@]*)@)?([^/?#:]*)(?::(\d+))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), f"(?i){_PARTS}", k)


def host(url: Column) -> Column:
    """Lower-case host, '' if it isn't http(s)."""
    return F.lower(_part(F.coalesce(url, F.lit("")), 3))


def is_http(url: Column) -> Column:
    return (host(url) != "") & url.isNotNull()


def canonical(url: Column) -> Column:
    """http(s) only (else null): scheme and host in lower case, no default port, a path, no tracking, no fragment."""
    scheme, port = F.lower(_part(url, 1)), _part(url, 4)
    user = F.when(_part(url, 2) != "", F.concat(_part(url, 2), F.lit("@"))).otherwise("")
    odd = (port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443"))
    path = F.when(_part(url, 5) == "", "/").otherwise(F.replace(_part(url, 5), F.lit(" "), F.lit("%20")))
    kept = F.filter(F.split(_part(url, 6), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    full = F.concat(scheme, F.lit("://"), user, host(url), F.when(odd, F.concat(F.lit(":"), port)).otherwise(""), path, query)
    return F.when(is_http(url), full)


def repaired(url: Column, rounds: int = 3) -> Column:
    """Query separators that were encoded once or more (`&amp;`, `&#38;`, `%26amp%3B`) as they were."""
    for _ in range(rounds):
        url = F.regexp_replace(url, r"(?i)&(?:amp;|#0*38;|#x0*26;)|%26(?:amp%3B|amp;|%2338%3B)", "&")
    return url


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, link: pd.Series) -> pd.Series:
    """The link against its base; null if either makes no URL."""

    def one(b, u):
        try:
            return None if u is None else urljoin(b or "", u)
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, link, strict=True)])


def collected(url: Column, base: Column) -> Column:
    """Decoded, repaired, resolved against the base, http(s), without fragment; null if encoded separators remain."""
    plain = F.trim(repaired(decode_named(url)))
    full = F.when(plain.rlike("(?i)^https?://"), plain).otherwise(joined(base, plain))
    full = F.regexp_replace(full, "#.*$", "")
    return F.when(is_http(full) & ~full.rlike("(?i)&amp;|%26amp"), full)


def allowed(url: Column, patterns: Column) -> Column:
    """Whether one of the patterns (array) matches; an empty or null list allows all."""
    return F.coalesce(F.size(patterns) <= 0, F.lit(True)) | F.coalesce(F.exists(patterns, lambda p: F.regexp_like(url, p)), F.lit(False))


def is_safe(url: Column) -> Column:
    """http(s) and no loopback, link-local or private host."""
    private = r"^(?:localhost|.*\.local(?:host)?|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(?:1[6-9]|2\d|3[01])\..*|\[?::1\]?|\[?f[cd].*|\[?fe80.*)$"
    return is_http(url) & ~host(url).rlike(private)


def is_aggregator(url: Column, hosts: tuple[str, ...] = ("news.google.com",)) -> Column:
    return host(url).isin(*hosts)


def unwrapped(url: Column) -> Column:
    """The target of a redirect link (its parameter url or q), else the URL itself."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(url, rf"[?&]{p}=([^&#]*)", 1), F.lit("")) for p in ("url", "q")))
    return F.coalesce(F.try_url_decode(found), url)


def candidate(url: Column) -> Column:
    """The unwrapped URL if it is safe and no aggregator's."""
    return let(unwrapped(url), lambda target: F.when(is_safe(target) & ~is_aggregator(target), target))


def article_key(url: Column) -> Column:
    """The id in an aggregator's article path."""
    return F.nullif(F.regexp_extract(url, r"/(?:rss/)?(?:articles|read)/([^/?#]+)", 1), F.lit(""))


def legacy_target(key: Column) -> Column:
    """The URL that an old article id holds in base64 (null if it holds none)."""
    padded = F.rpad(F.translate(key, "-_", "+/"), F.ceil(F.length(key) / 4).cast("int") * 4, F.lit("="))
    return F.nullif(F.regexp_extract(F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1"), r"(https?://[\x21-\x7E]+)", 1), F.lit(""))


def resolution(url: Column, redirect: Column, from_html: Column, from_search: Column) -> Column:
    """Struct of the original URL and how it was found; the rungs that need a network come as columns."""
    rungs = {"legacy_decoded": legacy_target(article_key(url)), "http_redirect": redirect, "html_metadata": from_html, "publisher_search": from_search}

    def first(x: Column) -> Column:
        status = F.when(~is_aggregator(url), "not_required")
        for name in rungs:
            status = status.when(x[name].isNotNull(), name)
        found = F.coalesce(F.when(~is_aggregator(url), url), *(x[name] for name in rungs))
        return F.struct(found.alias("url"), status.otherwise("failed").alias("status"))

    return let(F.struct(*(candidate(c).alias(name) for name, c in rungs.items())), first)


def href(url: Column) -> Column:
    """The URL if a page may link to it, else '#'."""
    return F.when(is_http(url), url).otherwise("#")


def discovery_feed(query: Column, base: str = "https://news.google.com/rss/search", recency: str = "when:2d", locale: str = "hl=ko&gl=KR&ceid=KR:ko") -> Column:
    return F.concat(F.lit(f"{base}?q="), F.url_encode(F.concat(query, F.lit(f" {recency}"))), F.lit(f"&{locale}"))


def origin(url: Column) -> Column:
    return F.when(is_http(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), host(url), F.when(_part(url, 4) != "", F.concat(F.lit(":"), _part(url, 4))).otherwise("")))


def publisher_origin(*candidates: Column) -> Column:
    """The origin of the first candidate that is http(s)."""
    return F.coalesce(*(origin(clean(c)) for c in candidates))
