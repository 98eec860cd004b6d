"""More of the catalogue: operators over the driver's tables with their SQL, and texts made of the tables' rows with what they have to give."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import html, similarity, text, times, urls
from siftwell.operators import aggregates, dedup, quality, rules, selection, summaries
from siftwell.packs.corpus import PACK
from siftwell.plans import serving
from siftwell.plans.queries import _ORDER, _RANKED, ARTICLES, ORACLE, QUERIES, _quoted, _ranked, articles, query, s_case, s_clean, s_form, s_grams, s_has, s_hits, s_jaccard, s_joined, s_keyword, s_match, s_print, s_tokens, spread, table
from siftwell.sources import feeds, sinks


class Sql(str):
    """An expected value as SQL over k (the row's key) and x (its text)."""


def derived(name: str, of: str, key: str, x: tuple[Callable[[], Column], str], schema: str, results: str, found: Callable[[Column, Column, Column], list[Column]], shapes: list[tuple]) -> None:
    """A query over texts made of a table's rows: each row takes the shapes that its key falls to, given and expected ones.

    `{k}` in a shape is the key, `{x}` the row's text (as a column and as SQL), `{b}` an old article id that holds
    https://a.example/ and the key. results: the results' names; found: the results, from the given columns u, t and e
    where there are such.
    """
    given, names = [c.split()[0] for c in schema.split(", ")], results.split(", ")

    def run(spark, d):
        kind = F.pmod(F.col("k"), F.lit(len(shapes))).cast("int")
        rows = table(spark, d, of).select(F.col(key).cast("long").alias("k"), x[0]().cast("string").alias("x"))
        old = F.translate(F.rtrim(F.base64(F.concat(F.lit("\b\x13\"#"), F.lit("https://a.example/"), F.col("k").cast("string"))), F.lit("=")), "+/", "-_")

        def filled(at: int) -> Column:
            out = F.get(F.array(*(F.lit(s[at]).cast("string") for s in shapes)), kind)
            for slot, value in (("{k}", F.col("k").cast("string")), ("{x}", F.col("x")), ("{b}", old)):
                out = F.when(out.contains(slot), F.replace(out, F.lit(slot), value)).otherwise(out)
            return out

        rows = rows.select(F.col("k").alias("n"), *(filled(at).alias(c) for at, c in enumerate(given)))
        return rows.select("n", *(c.alias(n) for n, c in zip(names, found(F.col("u"), F.col("t"), F.col("e")), strict=True)))

    def told(value) -> str:
        if value is None or isinstance(value, Sql):
            return value or "NULL"
        if isinstance(value, str):
            return f"replace(replace({_quoted(value)}, '{{k}}', CAST(k AS VARCHAR)), '{{x}}', x)" if "{" in value else _quoted(value)
        return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else str(value).lower()

    case = lambda at: "CASE " + " ".join(f"WHEN k % {len(shapes)} = {n} THEN {told(s[at])}" for n, s in enumerate(shapes)) + " END"
    QUERIES[name] = run
    ORACLE[name] = f"SELECT k AS n, {', '.join(f'{case(len(given) + at)} AS {n}' for at, n in enumerate(names))} FROM (SELECT CAST({key} AS BIGINT) AS k, {x[1]} AS x FROM {of})"


_HOST = (lambda: urls.host(F.col("url")), r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))")
_CLOCK = (lambda: F.date_format("ts", "HH:mm:ss"), "strftime(ts, '%H:%M:%S')")
_NONE = (lambda: F.lit(""), "''")

# --- sources and sinks -----------------------------------------------------------------------------------------------


@query(
    "WITH a AS (SELECT doc_id AS id, doc_id // 40 AS feed, 'https://news.example.com/a/' || doc_id || '?a=1&b=2' AS link, strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id % 43200), '%a, %d %b %Y %H:%M:00 +0000') AS published FROM documents), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY feed ORDER BY id) - 1 AS INTEGER) AS \"at\" FROM a) SELECT 'f' || feed AS feed, \"at\", 'Title & ' || id AS title, link, published FROM r WHERE \"at\" < 25"
)
def rss_entries(spark, d):
    stamp = F.date_format(F.timestamp_add("MINUTE", (F.col("doc_id") % 43200).cast("int"), F.lit("2024-01-01").cast("timestamp")), "EEE, dd MMM yyyy HH:mm:00 '+0000'")
    item = F.concat(F.lit("<item><title>Title &amp; "), F.col("doc_id"), F.lit("</title><link>https://news.example.com/a/"), F.col("doc_id"), F.lit("?a=1&amp;b=2</link><pubDate>"), stamp, F.lit("</pubDate></item>"))
    rows = table(spark, d, "documents").groupBy(F.concat(F.lit("f"), F.floor(F.col("doc_id") / 40).cast("string")).alias("source")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("held"))
    pages = rows.select("source", F.concat(F.lit("<rss><channel>"), F.array_join("held.item", ""), F.lit("</channel></rss>")).alias("text"), F.lit(25).alias("max_items"))
    return feeds.rss(pages).select("feed", "at", "title", "link", "published")


@query(
    "WITH p AS (SELECT page_id, page_id // 30 AS s, url FROM pages), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY s ORDER BY page_id) - 1 AS INTEGER) AS \"at\" FROM p), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY \"at\") AS n FROM r WHERE page_id % 5 <> 0 AND regexp_matches(url, 'example\\.(org|net)')) "
    "SELECT 's' || s AS source, \"at\", trim(url) AS url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 28 AS INTEGER)) AS published FROM k WHERE n <= 10"
)
def sitemap_entries(spark, d):
    day = F.when(F.col("page_id") % 5 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")), "yyyy-MM-dd")).otherwise("")
    entry = F.concat(F.lit("<url><loc><![CDATA["), "url", F.lit("]]></loc><lastmod>"), day, F.lit("</lastmod></url>"))
    rows = table(spark, d, "pages").groupBy(F.concat(F.lit("s"), F.floor(F.col("page_id") / 30).cast("string")).alias("source")).agg(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("x")))).alias("held"))
    pages = rows.select("source", F.array_join("held.x", "\n").alias("text"), F.array(F.lit(r"example\.(org|net)")).alias("allow"), F.lit(10).alias("max_items"))
    return feeds.sitemap(pages)


derived(
    "fetch_failures", "events", "event_id", _CLOCK, "e string", "reason", lambda u, t, e: [feeds.failure_reason(e)],
    [
        ("The operation was aborted at {x}", "fetch_timeout"), ("request {k} timed out", "fetch_timeout"), ("getaddrinfo ENOTFOUND h{k}.example", "fetch_dns"), ("EAI_AGAIN h{k}.example at {x}", "fetch_dns"),
        ("socket {k} hang up", "fetch_network"), ("", "fetch_network"),
    ],
)


@query(
    "WITH p AS (SELECT page_id AS id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages) "
    "SELECT id, CASE WHEN starts_with(path, '/fr/1') THEN true WHEN starts_with(path, '/fr') OR starts_with(path, '/de') THEN false ELSE true END AS allowed FROM p"
)
def robots_check(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    rules_text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /fr # none\nAllow: /fr/1\nDisallow:\nDisallow: /de"
    robots = rows.select(urls.origin(F.col("url")).alias("origin")).distinct().withColumn("text", F.lit(rules_text))
    return feeds.robots_allowed(rows, robots, "siftwell").select("id", "allowed")


@query("SELECT s_name AS name FROM supplier LEFT JOIN (SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1) c ON n_name = (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) WHERE s_suppkey % 3 <> 0 AND coalesce(n, 0) < 60")
def fallback_sources(spark, d):
    nation = table(spark, d, "nation")
    sources = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 3 != 0).alias("enabled"), F.col("n_name").alias("fallback_for"), F.lit(60).alias("fallback_threshold"))
    counts = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("raw_count"))
    return feeds.fallback_sources(sources, counts).select("name")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM events UNION SELECT '2023-12-31' ORDER BY date")
def archive_index(spark, d):
    names = table(spark, d, "events").select(F.concat(F.lit("data/archive/"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".json")).alias("path"))
    return feeds.archive_dates(spark, ["2023-12-31", "no date"], names.union(spark.createDataFrame([("data/archive/index.json",)], "path string")))


derived(
    "source_names", "supplier", "s_suppkey", (lambda: F.col("s_name"), "s_name"), "p string, c string, f string, s string, a string", "source",
    lambda u, t, e: [feeds.source_name(F.col("p"), F.col("c"), F.col("f"), F.col("s"), F.lit(None).cast("string"), F.col("a"))],
    [
        ("primary", "{x} &amp; B", "Feed", "Item", None, "{x} & B"), ("primary", "", "{x}", "Item", None, "{x}"), ("discovery", "A", "Feed", " <b>{x}</b> ", "W", "{x}"), ("discovery", "A", "Feed", "", "W {k}", "W {k}"),
        ("secondary", "A", "{x} {k}", None, None, "{x} {k}"),
    ],
)


def _folder(spark) -> str:
    return f"{dedup.shared_dir(spark)}/siftwell-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-03'")
def daily_partition(spark, d):
    """Two dates are written, one of them twice, an empty one is not; one is read back."""
    path, rows = _folder(spark), table(spark, d, "events")
    day = lambda n: rows.where(F.to_date("ts") == F.lit(n).cast("date")).select("event_id", "event_type")
    for date, items in (("2024-01-03", day("2024-01-02")), ("2024-01-03", day("2024-01-03")), ("2024-01-04", day("2024-01-04")), ("2024-01-03", day("1999-01-01"))):
        sinks.write_briefing(items, path, date)
    return sinks.on_date(sinks.read_briefings(spark, path), "2024-01-03").select("event_id", "event_type")


@query("SELECT c_custkey, c_acctbal AS score, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS final_selected FROM customer")
def audit_flags(spark, d):
    audit = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("score"), F.col("c_name").alias("title"))
    chosen = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.audit_report(audit, chosen, ["c_custkey"]).select("c_custkey", "score", "final_selected")


@query(
    "WITH b AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS summary, ts AS created_at, event_id % 2 AS fresh FROM events), "
    "n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, fresh DESC) = 1) SELECT key, created_at FROM n ORDER BY created_at DESC, key LIMIT 50"
)
def cache_upsert(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("summary"), F.col("ts").alias("created_at"), (F.col("event_id") % 2 == 0).alias("old"))
    return sinks.upserted_cache(rows.where("old").drop("old"), rows.where("not old").drop("old"), 50).select("key", "created_at")


@query(
    "WITH a AS (SELECT page_id AS id, 'The story of number ' || page_id AS title, url FROM pages), "
    "c AS (SELECT id, 'https://www.' || regexp_extract(url, '://([^/?#]*)', 1) || '/s/' || id AS url, 16 + length(CAST(id AS VARCHAR)) AS n FROM a WHERE id % 3 < 2) SELECT id, url, CASE WHEN id % 3 = 0 THEN 1.0 ELSE round(n / (n + 4), 6) END AS similarity FROM c"
)
def publisher_title_search(spark, d):
    host = urls.host(F.col("url"))
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("The story of number "), F.col("page_id")).alias("title"), F.concat(F.lit("https://"), host, F.lit("/")).alias("publisher"), host.alias("h"))
    link = lambda base, title: rows.select("id", F.concat(F.lit("https://"), base, F.lit("/s/"), "id").alias("url"), title.alias("title"))
    found = link(F.concat(F.lit("www."), "h"), F.when(F.col("id") % 3 == 0, F.col("title")).when(F.col("id") % 3 == 1, F.concat("title", F.lit(" told"))).otherwise("Weather")).union(link(F.lit("other.example"), F.col("title"))).union(link(F.col("h"), F.lit("Weather")))
    return feeds.publisher_search(rows.drop("h"), found).withColumn("similarity", F.round("similarity", 6))


# --- URLs ------------------------------------------------------------------------------------------------------------

derived(
    "url_repair", "pages", "page_id", _HOST, "u string", "repaired, collected", lambda u, t, e: [urls.repaired(u), urls.collected(u, F.lit("https://x.example/list/"))],
    [
        ("https://{x}/?a={k}&amp;b=2", "https://{x}/?a={k}&b=2", "https://{x}/?a={k}&b=2"), ("https://{x}/?a=1%26amp%3Bb={k}#f", "https://{x}/?a=1&b={k}#f", "https://{x}/?a=1&b={k}"),
        ("/p/{k}?x=1&#38;y=2", "/p/{k}?x=1&y=2", "https://x.example/p/{k}?x=1&y=2"), ("q{k}.html", "q{k}.html", "https://x.example/list/q{k}.html"), ("mailto:a{k}@b.example", "mailto:a{k}@b.example", None), ("ftp://{x}/{k}", "ftp://{x}/{k}", None),
    ],
)
derived(
    "url_safety", "pages", "page_id", _HOST, "u string", "safe, aggregator, href, origin", lambda u, t, e: [urls.is_safe(u), urls.is_aggregator(u), urls.href(u), urls.publisher_origin(F.lit("no url"), u)],
    [
        ("https://{x}/{k}", True, False, "https://{x}/{k}", "https://{x}"), ("http://localhost/{k}", False, False, "http://localhost/{k}", "http://localhost"), ("http://10.1.2.3/{k}", False, False, "http://10.1.2.3/{k}", "http://10.1.2.3"),
        ("http://172.20.0.1/{k}", False, False, "http://172.20.0.1/{k}", "http://172.20.0.1"), ("http://172.40.0.1/{k}", True, False, "http://172.40.0.1/{k}", "http://172.40.0.1"), ("https://news.google.com/articles/{k}", True, True, "https://news.google.com/articles/{k}", "https://news.google.com"),
        ("javascript:alert({k})", False, False, "#", None), ("HTTPS://A.Example:8443/{k}", True, False, "HTTPS://A.Example:8443/{k}", "https://a.example:8443"),
    ],
)
derived(
    "url_unwrap", "pages", "page_id", _HOST, "u string", "target, candidate, key", lambda u, t, e: [urls.unwrapped(u), urls.candidate(u), urls.article_key(u)],
    [
        ("https://r.example/go?url=https%3A%2F%2F{x}%2F{k}%3Fy%3D1", "https://{x}/{k}?y=1", "https://{x}/{k}?y=1", None), ("https://r.example/go?q=http%3A%2F%2F127.0.0.1%2F{k}", "http://127.0.0.1/{k}", None, None),
        ("https://news.google.com/rss/articles/CBMi{k}?oc=5", "https://news.google.com/rss/articles/CBMi{k}?oc=5", None, "CBMi{k}"), ("https://{x}/plain/{k}", "https://{x}/plain/{k}", "https://{x}/plain/{k}", None),
    ],
)
derived(
    "url_resolution", "pages", "page_id", _HOST, "u string, r string, m string, s string", "url, status",
    lambda u, t, e: [urls.resolution(u, F.col("r"), F.col("m"), F.col("s"))["url"], urls.resolution(u, F.col("r"), F.col("m"), F.col("s"))["status"]],
    [
        ("https://{x}/{k}", None, None, None, "https://{x}/{k}", "not_required"), ("https://news.google.com/articles/abc{k}", "https://{x}/y{k}", None, None, "https://{x}/y{k}", "http_redirect"),
        ("https://news.google.com/articles/abc{k}", "https://news.google.com/z", "https://{x}/z{k}", None, "https://{x}/z{k}", "html_metadata"), ("https://news.google.com/articles/abc{k}", None, "http://10.0.0.{k}/", None, None, "failed"),
        ("https://news.google.com/articles/{b}", None, None, None, "https://a.example/{k}", "legacy_decoded"), ("https://news.google.com/read/abc{k}", None, None, "https://{x}/s/{k}", "https://{x}/s/{k}", "publisher_search"),
    ],
)


@query(r"SELECT page_id, regexp_matches(url, '/en/') OR regexp_matches(url, '\?page=2') AS let_through FROM pages")
def url_allowed(spark, d):
    return table(spark, d, "pages").select("page_id", urls.allowed(F.col("url"), F.array(F.lit("/en/"), F.lit(r"\?page=2"))).alias("let_through"))


# --- pages -----------------------------------------------------------------------------------------------------------

_AD = r"""(?is)<div\b[^>]*\bclass\s*=\s*["'][^"']*\bad\b[^"']*["'][^>]*>.*?</div>"""


@query(rf"SELECT page_id, md5(regexp_replace(regexp_replace(html, {_quoted(_AD)}, ' ', 'g'), '(?is)<h1\b[^>]*>.*?</h1>', ' ', 'g')) AS left_over, md5(array_to_string(list_concat(regexp_extract_all(html, '(?is)<h1\b[^>]*>.*?</h1>'), regexp_extract_all(html, {_quoted(_AD)})), chr(10))) AS chosen FROM pages")
def page_selectors(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.md5(html.without_selected(h, ["div.ad", "h1", "p > a:first"])).alias("left_over"), F.md5(html.selected(h, ["h1", ".ad"])).alias("chosen"))


@query(
    rf"WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS anchors FROM pages), x AS (SELECT page_id, origin, unnest(range(1, len(anchors) + 1)) AS n, unnest(anchors) AS a FROM l), "
    rf"y AS (SELECT page_id, n, origin || regexp_extract(a, '(?i)href\s*=\s*\x22([^\x22#]*)', 1) AS url, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM x), "
    "z AS (SELECT * FROM y WHERE length(title) >= 6 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY n) = 1) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS INTEGER) AS place, url, title FROM z QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n) <= 20"
)
def page_links(spark, d):
    from pyspark.sql import Window

    rows = html.links(table(spark, d, "pages"), "page_id", least_title=6)
    return rows.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("at")).alias("place"), "url", "title")


_BODY = "regexp_extract(substring(article, 1, 12000), '(?s)^.*[.!]', 0)"
_PAGE_ARTICLE = ORACLE["page_article"].replace("SELECT p.page_id, coalesce(article, '') AS article FROM", "SELECT p.page_id, p.html, coalesce(article, '') AS article FROM")


@query(
    f"WITH q AS ({_PAGE_ARTICLE}), f AS (SELECT *, CASE WHEN {s_match(s_clean('html'), '|'.join(PACK.paywall))} AND length(article) < 1500 THEN 'paywall' WHEN length(article) < 300 THEN 'body_too_short' END AS failure FROM q) "
    f"SELECT page_id, failure, CASE WHEN failure IS NOT NULL THEN '' WHEN length(article) <= 12000 THEN article WHEN length({_BODY}) >= 7800 THEN trim({_BODY}, ' ') ELSE trim(substring(article, 1, 12000), ' ') END AS text FROM f"
)
def page_extraction(spark, d):
    return table(spark, d, "pages").select("page_id", html.extraction(F.col("html"), PACK).alias("x")).select("page_id", "x.text", "x.failure")


_HEAD = '<html><head><meta property="og:title" content="A {k} &amp; B"><meta name=description content=\'Some words of {x}\'><meta property="og:url" content="https://{x}/o{k}"><meta property="article:published_time" content="2024-03-05T06:07:08Z"></head><body><h1>Head</h1></body></html>'
derived(
    "page_metadata", "pages", "page_id", _HOST, "h string", "title, configured, description, published, original",
    lambda u, t, e: [html.title(F.col("h")), html.title(F.col("h"), None, ("meta[x]", ".top")), html.description(F.col("h")), html.published(F.col("h")).cast("string"), html.original_url(F.col("h"))],
    [
        (_HEAD, "A {k} & B", "A {k} & B", "Some words of {x}", "2024-03-05 06:07:08", "https://{x}/o{k}"),
        ('<link rel="canonical" href="https://{x}/{k}"><h1> One <b>two {k}</b></h1><div class="top">Top {k}</div><time datetime="2024-01-02"></time>', "One two {k}", "Top {k}", "", "2024-01-02 00:00:00", "https://{x}/{k}"),
        ('<title>T {k}</title><script>{"datePublished": "2024-02-03T00:00:00Z"}</script><a href="https://{x}/y">x</a>', "T {k}", "T {k}", "", "2024-02-03 00:00:00", "https://{x}/y"),
        ('<p>on 2024. 5. 6 it was {k}</p>', None, None, "", "2024-05-06 00:00:00", None),
    ],
)
derived(
    "title_source", "documents", "doc_id", (lambda: F.coalesce("source", F.lit("Post")), "coalesce(source, 'Post')"), "t string, s string", "title", lambda u, t, e: [html.without_source(t, F.col("s"))],
    [("News {k} of today - {x}", "{x}", "News {k} of today"), ("A{k} - B - {x}", "{x}", "A{k} - B"), ("A{k} | Other", "{x}", "A{k} | Other"), ("A{k} - {x}", "", "A{k} - {x}")],
)

# --- texts and times -------------------------------------------------------------------------------------------------

derived(
    "title_forms", "documents", "doc_id", _NONE, "t string", "decoded, prepared, bare, comma", lambda u, t, e: [text.decode_references(t), text.prepared_title(t), text.without_quotes(t), text.top_comma(t)],
    [
        ("[속보] A{k}&#39;s plan...", "[속보] A{k}'s plan...", "A{k}&#39;s plan", "[속보] A{k}&#39;s plan,", -1), ("‘가나’, 다라 {k},000억", "‘가나’, 다라 {k},000억", "‘가나’, 다라 {k},000억", "가나, 다라 {k},000억", 4),
        ("(a, {k}) c", "(a, {k}) c", "(a, {k}) c", "(a, {k}) c", -1), ("", "", "", "", -1),
    ],
)
derived("particles", "customer", "c_custkey", _NONE, "t string", "subject, object", lambda u, t, e: [text.subject_particle(t), text.object_particle(t)], [("{k}회사", "가", "를"), ("{k}기업", "이", "을"), ("Acme{k}", "가", "를"), ("", "가", "를")])
derived(
    "parsed_times", "events", "event_id", _CLOCK, "t string", "parsed, seconds", lambda u, t, e: [times.parsed(t).cast("string"), times.retry_seconds(t)],
    [
        ("Tue, 05 Mar 2024 {x} GMT", "2024-03-05 {x}", None), ("2024-03-05T{x}Z", "2024-03-05 {x}", None), ("2024-03-05T{x}+09:00", Sql("strftime(CAST('2024-03-05 ' || x AS TIMESTAMP) - INTERVAL 9 HOURS, '%Y-%m-%d %H:%M:%S')"), None),
        ("2024.03.05", "2024-03-05 00:00:00", None), ("{k}h2m3.5s", None, Sql("CAST(k * 3600 + 123.5 AS DOUBLE)")), ("{k}ms", None, Sql("k / 1000")), ("soon {k}", None, None),
    ],
)


@query("SELECT event_id, ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AS inside, strftime(ts + INTERVAL 9 HOURS, '%Y.%m.%d %H:%M') AS label, strftime(ts + INTERVAL 9 HOURS, '%Y-%m-%d') AS date FROM events")
def range_and_label(spark, d):
    ts, at = F.col("ts"), lambda x: F.lit(x).cast("timestamp")
    return table(spark, d, "events").select("event_id", times.in_range(ts, at("2024-01-10"), at("2024-01-12")).alias("inside"), times.label(ts).alias("label"), times.briefing_date(times.local_iso(ts)).alias("date"))


# --- rules and scores ------------------------------------------------------------------------------------------------

_ANY = " OR ".join(s_keyword("tf", w) for words in PACK.categories.values() for w in words)
_SIGNAL = " OR ".join(s_match("title", s.pattern) for s in PACK.signals)


@query(f"WITH {ARTICLES}, b AS (SELECT *, {s_form('title')} AS tf, {s_form(s_joined('title', 'description'))} AS info FROM a) SELECT id, ({_SIGNAL}) OR {_ANY} AS gate, {s_hits('info', PACK.tech_words)} > 0 AS any_word, {s_has(s_clean('title'), 'direct_investment')} OR ({s_has(s_clean('title'), 'program')} AND {s_match(s_clean('title'), '선정|선발|selected')}) AS protected FROM b")
def keyword_gates(spark, d):
    title = F.col("title")
    return articles(spark, d).select("id", rules.has_signal_or_keyword(PACK, title).alias("gate"), rules.has_any_keyword(PACK.tech_words, title, F.col("description")).alias("any_word"), rules.protected(PACK, title).alias("protected"))


_ADJUST = " + ".join(f"CASE WHEN {s_match('body', s.pattern)} THEN {s.body} ELSE 0 END" for s in PACK.signals if s.body)
_EVENT_TYPE = "CASE " + " ".join(f"WHEN {s_match('tf', p)} THEN {_quoted(n)}" for n, p in PACK.event_types) + " END"


@query(f"WITH {ARTICLES}, b AS (SELECT *, {s_form('title')} AS tf FROM a) SELECT id, least(12, {_ADJUST}) AS adjustment, {_EVENT_TYPE} AS event, greatest(0, id % 30 - CASE id % 3 WHEN 0 THEN 5 WHEN 1 THEN 20 ELSE 0 END - CASE WHEN id % 7 = 0 THEN 8 ELSE 0 END) AS final FROM b")
def late_scores(spark, d):
    kind = F.when(F.col("id") % 3 == 0, "titleFallback").when(F.col("id") % 3 == 1, "unavailable").otherwise("description")
    return articles(spark, d).select("id", rules.body_adjustment(PACK, F.col("body")).alias("adjustment"), rules.event_type(PACK, F.col("title")).alias("event"), rules.final_score(F.col("id") % 30, kind, F.col("id") % 7 == 0).alias("final"))


@query("SELECT doc_id, CAST(doc_id % 20 AS INTEGER) + CASE WHEN lang = 'en' THEN 8 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END AS importance FROM documents")
def importance(spark, d):
    none = F.lit(None).cast("string")
    found = F.struct(F.when(F.col("doc_id") % 2 == 0, "1").alias("amount"), none.alias("stage"), F.when(F.col("doc_id") % 3 == 0, "x").alias("event"), F.lit("").alias("company"))
    return table(spark, d, "documents").select("doc_id", rules.importance((F.col("doc_id") % 20).cast("int"), F.col("lang") == "en", found).alias("importance"))


derived(
    "search_likeness", "part", "p_partkey", (lambda: F.col("p_name"), "p_name"), "a string, b string", "closeness", lambda u, t, e: [F.round(similarity.search_similarity(F.col("a"), F.col("b")), 4)],
    [
        ("{x} raises {k}", "{x} RAISES {k}!", 1.0), ("{x}", "{x} and more", Sql("round(length(replace(x, ' ', '')) / (length(replace(x, ' ', '')) + 7), 4)")), ("abcd{k}", "", 0.0), ("", "{x}", 0.0), ("abc{k}", "xyz!", 0.0),
        ("abcd", "abxy", 0.3333), ("{k}{x}", "{k}", Sql("round(length(CAST(k AS VARCHAR)) / (length(CAST(k AS VARCHAR)) + length(replace(x, ' ', ''))), 4)")),
    ],
)

# --- aggregates and orders -------------------------------------------------------------------------------------------


@query("SELECT event_type, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def totals(spark, d):
    return aggregates.totals_of(table(spark, d, "events"), "event_type", "value").withColumn("total", F.round("total", 4))


@query("SELECT count(*) AS total, count_if(event_type = 'click') AS click, count_if(event_type = 'none') AS none, count_if(event_type = 'view') AS view FROM events")
def diagnostics(spark, d):
    return aggregates.diagnostics(table(spark, d, "events"), ["click", "view", "none"], "event_type")


@query("SELECT event_type AS exclude_reason, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def reason_counts(spark, d):
    return aggregates.reason_counts(table(spark, d, "events").withColumn("exclude_reason", F.when(F.col("event_type") != "view", F.col("event_type"))))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY user_id")
def map_totals(spark, d):
    by = table(spark, d, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    return by.select("user_id", aggregates.map_total(F.col("m")).alias("total"))


@query(f"{_RANKED} SELECT id, CAST(row_number() OVER (ORDER BY strftime(published_at + INTERVAL 9 HOURS, '%Y-%m-%d') DESC, score DESC, published_at DESC, id) AS INTEGER) AS place FROM k QUALIFY place <= 40")
def output_places(spark, d):
    rows = _ranked(spark, d).orderBy(*selection.output_order()).limit(40)
    from pyspark.sql import Window

    return rows.select("id", F.row_number().over(Window.orderBy(*selection.output_order())).alias("place"))


@query(f"{_RANKED}, c AS (SELECT * FROM k ORDER BY {_ORDER} LIMIT 60) SELECT id, is_domestic AND row_number() OVER (PARTITION BY is_domestic ORDER BY score DESC, id) <= 12 AS sent FROM c")
def budgeted(spark, d):
    rows = _ranked(spark, d)
    order = [F.desc("protected"), F.col("connection_type").isNotNull().desc(), F.desc("score"), (F.col("feed_priority") == "primary").desc(), F.desc("published_at"), F.asc("id")]
    return rows.orderBy(*order).limit(60).select("id", selection.budget_flag([F.desc("score"), F.asc("id")], 12, F.col("is_domestic")).alias("sent"))


@query("SELECT DISTINCT CAST(ts AS DATE) AS date FROM events ORDER BY date DESC LIMIT 12")
def newest_dates(spark, d):
    return selection.newest(table(spark, d, "events").select(F.to_date("ts").alias("date")), "date")


@query(f"{_RANKED} SELECT id, score, category AS exclude_reason FROM k WHERE id % 3 = 0 ORDER BY score DESC, id LIMIT 20")
def top_excluded(spark, d):
    rows = _ranked(spark, d).withColumns({"exclude_reason": F.when(F.col("id") % 3 == 0, F.col("category")), "title": F.lit("x")})
    return selection.top_excluded(rows).select("id", "score", "exclude_reason")


# --- summaries and checks --------------------------------------------------------------------------------------------

derived("source_ranks", "events", "event_id", _NONE, "t string", "rank", lambda u, t, e: [summaries.source_rank(t)], [("openai_body", 5), ("local_extractive", 3), ("description", 2), ("titleFallback", 1), ("unavailable", 0), ("other {k}", 0), (None, 0)])
derived(
    "model_limits", "events", "event_id", _CLOCK, "e string", "kind", lambda u, t, e: [summaries.limit_kind(e)],
    [("Limit {k} reached at {x}: requests per day (RPD)", "daily"), ("{k} tokens per min (TPM)", "tpm"), ("{k} requests per min", "rpm"), ("bad gateway at {x}", "unknown"), ("daily quota of {k}", "daily")],
)
derived("summary_limits", "events", "event_id", _NONE, "t string", "most, similarity", lambda u, t, e: [quality.limits(t)[0], quality.limits(t)[1]], [("openai_description", 120, 1.01), ("structured_overseas", 100, 1.01), ("local_extractive", 100, 0.97), ("description", 100, 0.8)])


@query("SELECT count(*) AS requests, count_if(event_type NOT IN ('click', 'view')) AS succeeded, count_if(event_type IN ('click', 'view')) AS failed, count_if(event_type = 'click') AS daily_limits, count_if(event_type = 'view') AS rate_limits, round(sum(value), 3) AS seconds, CAST(sum(user_id) AS BIGINT) AS tokens FROM events")
def request_metrics(spark, d):
    error = F.when(F.col("event_type") == "click", "requests per day").when(F.col("event_type") == "view", "tokens per min")
    return summaries.request_metrics(table(spark, d, "events").select(error.alias("error"), F.col("value").alias("seconds"), F.col("user_id").alias("tokens")))


@query(f"WITH {ARTICLES} SELECT id, CAST(row_number() OVER (ORDER BY length({s_clean('body')}) >= 300 DESC, id) AS INTEGER) AS place FROM a QUALIFY place <= 50")
def summary_places(spark, d):
    from pyspark.sql import Window

    order = summaries.summary_order(F.col("body"), F.col("id"))
    return articles(spark, d).orderBy(*order).limit(50).select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(
    f"WITH {ARTICLES}, s AS (SELECT id, title, split_part(body, chr(10), 2) AS summary FROM a), q AS ({ORACLE['summary_quality_reason']}) "
    "SELECT s.id, s.summary FROM s JOIN q USING (id) WHERE q.reason IS NULL AND s.id % 2 = 0"
)
def cached_summaries(spark, d):
    rows = articles(spark, d).withColumn("summary", F.split_part("body", F.lit("\n"), F.lit(2))).withColumn("url", F.concat(F.lit("https://a.example/"), "id"))
    cache = rows.where("id % 2 = 0").select(summaries.summary_key(F.col("url"), F.col("title"), F.col("description"), F.lit("openai_body")).alias("key"), "summary")
    return summaries.cached(rows.drop("summary"), cache, PACK, "openai_body")


@query("SELECT source AS category, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1")
def category_recount(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("category"), F.when(F.col("doc_id") % 3 != 0, "x").alias("title"))
    return serving.normalised(rows)


@query("WITH x AS (SELECT source, CASE WHEN lang = 'en' THEN 'domestic' ELSE 'overseas' END AS region FROM documents) SELECT 'category' AS kind, source AS value, count(*) AS n FROM x WHERE source IS NOT NULL GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM x GROUP BY 2")
def facet_filters(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("category"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("is_domestic"))
    return serving.filters(rows)


@query("SELECT (SELECT count(*) FROM documents) AS items, (SELECT count(*) FROM documents WHERE source IS NOT NULL) AS in_categories, 1000 AS total, (SELECT count(*) FROM documents) = 1000 AND (SELECT count(*) FROM documents WHERE source IS NOT NULL) = 1000 AS valid")
def document_checks(spark, d):
    rows = table(spark, d, "documents")
    return quality.document_checks(rows, rows.where("source is not null").groupBy("source").agg(F.count("*").alias("n")), 1000)


# --- sentences, summaries, events ------------------------------------------------------------------------------------


def s_sanitised(x: str) -> str:
    x = s_clean(x)
    for pattern, instead in PACK.strip:
        x = f"regexp_replace({x}, {_quoted('(?i)' + pattern)}, {_quoted(instead)}, 'g')"
    return rf"trim(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '^[▶◆■●※]\s*', ''))"


def s_dice(a: str, b: str) -> str:
    """Multiset Dice of two histograms (maps), as text."""
    total = "coalesce(list_sum(map_values({})), 0)"
    both = f"coalesce(list_sum(list_transform(list_intersect(map_keys({a}), map_keys({b})), lambda y: least({a}[y], {b}[y]))), 0)"
    return f"CASE WHEN cardinality({a}) > 0 AND cardinality({b}) > 0 THEN 2.0 * {both} / ({total.format(a)} + {total.format(b)}) ELSE 0.0 END"


def s_close(a: str, b: str) -> str:
    """Closeness of two texts by their columns p_ (fingerprint), k_ (tokens) and g_ (histogram of bigrams)."""
    return f"CASE WHEN p_{a} <> '' AND p_{a} = p_{b} THEN 1.0 ELSE greatest({s_jaccard(f'k_{a}', f'k_{b}')}, {s_dice(f'g_{a}', f'g_{b}')}) END"


def s_formed(columns: str, x: str, name: str, source: str) -> str:
    """columns and the forms of x from a source; fingerprints first, as bigrams read them again and again."""
    return f"(SELECT *, list_aggregate({s_grams(f'p_{name}')}, 'histogram') AS g_{name} FROM (SELECT {columns}, {s_print(x)} AS p_{name}, {s_tokens(x)} AS k_{name} FROM {source}))"


_LATIN = "(len(regexp_extract_all({0}, '[A-Za-z]')) >= 20 AND len(regexp_extract_all({0}, '[A-Za-z]')) > 2 * len(regexp_extract_all({0}, '[\\x{{AC00}}-\\x{{D7A3}}]')))"
_ENDED = r"""regexp_matches({0}, '[.!?]["'')\]]?$')"""
_KNOWN = [(name, n) for name, n in (("money", 9), ("subject", 5), ("action", 8), ("institution", 6), ("weak", -20), ("advert", -35), ("stock_sentence", -35), ("promotion", -25))]
_WORTH = " + ".join(
    ["CASE WHEN length(x) < 18 THEN -30 WHEN length(x) <= 120 THEN 10 WHEN length(x) <= 180 THEN 3 ELSE -25 END"]
    + [f"CASE WHEN {s_keyword('fx', k)} THEN {w} ELSE 0 END" for k, w in PACK.sentence_weights]
    + [f"5 * {s_hits('fx', PACK.category_words['english'])}"]
    + [f"CASE WHEN {s_has('x', name)} THEN {n} ELSE 0 END" for name, n in _KNOWN]
    + ["greatest(0, 4 - place)", "least(4 * len(list_intersect(k_t, k_s)), 16)"]
    + [f"CASE WHEN {_LATIN.format('x')} THEN CASE WHEN close >= 0.95 THEN -20 WHEN close >= 0.8 THEN -5 ELSE 0 END ELSE CASE WHEN close >= 0.96 THEN -50 WHEN close >= 0.8 THEN -10 ELSE 0 END END"]
)
_META = PACK.concept("sentence_metadata")
_SENTENCES = f"""{ARTICLES}, ti AS MATERIALIZED {s_formed('id', 'title', 't', 'a')},
r0 AS (SELECT id, source, list_filter(list_transform(regexp_extract_all({s_clean("regexp_replace(coalesce(body, ''), chr(13) || '?' || chr(10) || '+', '. ', 'g')")}, '[^.!?。]+[.!?。]?'), lambda x: trim(x)), lambda x: x <> '') AS s FROM a),
r1 AS (SELECT id, source, unnest(range(0, len(s))) AS place, unnest(s) AS raw FROM r0),
r2 AS (SELECT id, place, {s_sanitised('raw')} AS x, source FROM r1 WHERE NOT {s_match('raw', _META)}),
r3 AS (SELECT id, place, x FROM r2 WHERE x <> '' AND trim(regexp_replace(lower(x), '[\\s|·:.-]+$', '')) <> lower({s_clean('source')}) AND NOT {s_match('x', _META)}),
r4 AS (SELECT * FROM r3 QUALIFY row_number() OVER (PARTITION BY id, lower(regexp_replace(x, '\\s+', '', 'g')) ORDER BY place) = 1),
r5 AS MATERIALIZED {s_formed('id, place, x, ' + s_form('x') + ' AS fx', 'x', 's', 'r4')},
r6 AS (SELECT r5.*, ti.* EXCLUDE id, {s_close('t', 's')} AS close FROM r5 JOIN ti USING (id)),
sc AS MATERIALIZED (SELECT id, place, x AS sentence, {_WORTH} AS score, close, {s_has('x', 'weak')} AS weak, length(x) BETWEEN 25 AND 100 AND CASE WHEN {_LATIN.format('x')} THEN {s_has('x', 'english_event')} AND {_ENDED.format('x')} ELSE {s_has('x', 'complete_ending')} END AS complete FROM r6),
se AS MATERIALIZED (SELECT id, CAST(place AS INTEGER) AS place, sentence, CAST(score AS INTEGER) AS score, score >= 0 AND NOT weak AND close < 0.96 AND complete AS usable FROM sc)"""


@query(f"WITH {_SENTENCES} SELECT * FROM se")
def sentence_scores(spark, d):
    rows = summaries.scored_sentences(articles(spark, d).withColumn("category", F.lit("english")), PACK)
    return rows.withColumns({"place": F.col("place").cast("int"), "score": F.col("score").cast("int")})


@query(
    f"""WITH {_SENTENCES}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS n FROM se WHERE usable),
f1 AS MATERIALIZED {s_formed('id, sentence AS first', 'sentence', 't', 'o WHERE n = 1')},
f2 AS MATERIALIZED {s_formed('o.id, o.n, o.sentence, f1.* EXCLUDE id', 'o.sentence', 's', 'o JOIN f1 ON f1.id = o.id AND length(first) < 45 WHERE n > 1')},
f3 AS (SELECT id, min_by(sentence, n) AS second FROM f2 WHERE CASE WHEN p_t = p_s THEN 1.0 ELSE {s_close('t', 's')} END < 0.65 AND length(first) + 1 + length(sentence) <= 100 GROUP BY id)
SELECT f1.id, concat_ws(' ', first, second) AS summary FROM f1 LEFT JOIN f3 USING (id)"""
)
def extractive_summary(spark, d):
    return summaries.extractive(articles(spark, d).withColumn("category", F.lit("english")), PACK)


_QUIET = f"(length(t) >= 25 AND {s_has('t', 'structured_subject')} AND {s_has('t', 'fallback_strong_event')})"


@query(
    f"""WITH {ARTICLES}, f0 AS (SELECT id, title, source, {s_clean("split_part(body, chr(10), 2)")} AS t FROM a), f1 AS (SELECT *, {_LATIN.format('t')} AS english, {s_print('t')} AS own, {s_print('title')} AS whole, {s_print('source')} AS name FROM f0) SELECT id, """
    + s_case(
        [
            ("length(t) = 0", "'fallback_empty'"), ("length(t) > 100", "'fallback_too_long'"),
            (f"english AND (length(t) < 60 OR NOT {s_has('t', 'english_event')} OR NOT {_ENDED.format('t')})", "'english_description_incomplete'"),
            (f"NOT english AND (NOT {s_has('t', 'fallback_event')} OR NOT {s_has('t', 'report_ending')})", "'noun_phrase_summary'"), (f"NOT english AND length(t) < 40 AND NOT {_QUIET}", "'description_too_short'"),
            ("own <> '' AND contains(whole, own) AND length(own) < 0.8 * length(whole)", "'truncated_title_summary'"), ("name <> '' AND length(replace(own, name, '')) < 12", "'source_name_only'"),
        ]
    )
    + f" AS reason, length(t) >= 18 AND {s_has('t', 'structured_subject')} AND {s_has('t', 'structured_action')} AS structured FROM f1"
)
def fallback_quality_reason(spark, d):
    line = F.split_part("body", F.lit("\n"), F.lit(2))
    return articles(spark, d).select("id", quality.fallback_reason(PACK, F.col("title"), line, F.col("source"), F.lit("description")).alias("reason"), quality.structured(PACK, line).alias("structured"))


def _events(spark, d) -> DataFrame:
    """Articles with an amount and a round in their titles, so that events have facts in common."""
    told = F.concat("title", F.lit(" "), F.col("id") % 13 + 1, F.lit("억원 series "), F.substring(F.lit("abc"), (F.col("id") % 3 + 1).cast("int"), F.lit(1)))
    # Placed before titles are searched, as sorting reads its rows twice.
    rows, t = dedup.ranked(articles(spark, d).select("id", told.alias("title")), [F.asc("id")]), F.col("title")
    return spread(rows).select("rank", "id", "title", rules.event_type(PACK, t).alias("event"), rules.entities(PACK, t).alias("entities"), rules.event_amounts(t).alias("amounts"), rules.event_rounds(t).alias("rounds"))


_BARE = rf"regexp_replace(regexp_replace({s_form('title')}, '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '[^\p{{L}}\p{{N}}&·_-]+', ' ', 'g')"
_STOP = ", ".join(map(_quoted, PACK.stopwords))


@query(
    rf"""WITH RECURSIVE {ARTICLES}, n0 AS (SELECT id, title || ' ' || (id % 13 + 1) || '억원 series ' || substring('abc', CAST(id % 3 + 1 AS INTEGER), 1) AS title FROM a),
n1 AS MATERIALIZED (SELECT id, title, {s_case([(s_match(s_form('title'), p), _quoted(k)) for k, p in PACK.event_types])} AS event,
  list_filter(list_transform(string_split_regex({_BARE}, '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[._-]+', ''), '[._-]+$', '')), lambda w: length(w) >= 2 AND NOT list_contains([{_STOP}], w) AND NOT regexp_matches(w, '^[0-9]|^(프리)?시리즈[a-z]$')) AS entities,
  (id % 13 + 1) || '억원' AS amount, '시리즈' || substring('abc', CAST(id % 3 + 1 AS INTEGER), 1) AS round, p_t, k_t, g_t FROM {s_formed('id, title', 'title', 't', 'n0')}),
p0 AS (SELECT x.id AS a, y.id AS b, x.event, list_filter(y.entities, lambda w: list_contains(x.entities, w))[1] AS entity, x.amount = y.amount AS same_amount, x.round = y.round AS same_round, y.amount, y.round,
  CASE WHEN x.p_t = y.p_t THEN 1.0 ELSE greatest({s_jaccard('x.k_t', 'y.k_t')}, {s_dice('x.g_t', 'y.g_t')}) END AS close
  FROM n1 x JOIN n1 y ON x.event = y.event AND x.id < y.id AND list_has_any(x.entities, y.entities)),
p1 AS MATERIALIZED (SELECT a, b, 'same_event:' || event || ', entity:' || entity || CASE WHEN same_amount OR same_round THEN CASE WHEN same_amount THEN ', amount:' || amount ELSE '' END || CASE WHEN same_round THEN ', round:' || round ELSE '' END ELSE ', similar_title' END AS reason
  FROM p0 WHERE same_amount OR same_round OR close >= 0.55),
lo AS MATERIALIZED (SELECT n1.id, row_number() OVER (ORDER BY n1.id) AS n, coalesce(x.lo, []) AS lo FROM n1 LEFT JOIN (SELECT b AS id, list(a) AS lo FROM p1 GROUP BY b) x USING (id)),
st AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT st.n + 1, CASE WHEN list_has_any(lo.lo, st.kept) THEN st.kept ELSE list_append(st.kept, lo.id) END FROM st JOIN lo ON lo.n = st.n + 1),
k AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM st ORDER BY n DESC LIMIT 1)),
g AS (SELECT b AS id, min(a) AS a, min_by(reason, a) AS reason FROM p1 WHERE a IN (FROM k) AND b NOT IN (FROM k) GROUP BY b)
SELECT g.id, n1.title, m.title AS kept_title, g.reason FROM g JOIN n1 USING (id) JOIN n1 m ON m.id = g.a"""
)
def event_dedup(spark, d):
    return dedup.by_event(_events(spark, d))[1].select("id", "title", "kept_title", "reason")
