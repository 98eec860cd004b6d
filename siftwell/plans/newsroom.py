"""The parts around the batch run over the given tables: the model's answers and queue, robots memo, feeds as a source, counted writes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwell.functions import urls
from siftwell.operators import answers, dedup
from siftwell.packs.startup_news import PACK
from siftwell.plans.headlines import _CUSTOMERS, _company
from siftwell.plans.queries import _stream, query, spread, streamed, table
from siftwell.sources import feed_reader, sinks
from siftwell.streaming import model_queue, robots


def _folder(spark) -> str:
    return f"{dedup.shared_dir(spark)}/siftwell-{uuid.uuid4().hex}"


# --- answers ---------------------------------------------------------------------------------------------------------


def _stub(title: str, text: str, reason: str) -> str:
    """A model that lies first and mends it (company's key 0 modulo 4), is always vague (1), right (2), or down (3)."""
    company, amount = text.split(" ")[:2]
    key = int("".join(c for c in company if c.isdigit()))
    good = f"요약: {company} {amount} 원을 조달해 해외 판로 개척과 양산 설비 구축에 투입함"
    if key % 4 == 0:
        return good if reason.startswith("unsupported_claim") else good.replace(amount, "9,999억")
    if key % 4 == 1:
        return f"{company}의 {amount} 원 조달 소식입니다"
    if key % 4 == 3:
        raise ConnectionError("down")
    return good


@query(
    f"WITH x AS ({_CUSTOMERS}) SELECT id, CASE WHEN id % 4 IN (0, 2) THEN c || ' ' || n || '억 원을 조달해 해외 판로 개척과 양산 설비 구축에 투입함' ELSE c || ' 소식' END AS summary, CASE WHEN id % 4 IN (0, 2) THEN 'model' ELSE 'local' END AS summary_by, "
    "CAST(CASE WHEN id % 4 IN (0, 1) THEN 2 ELSE 1 END AS INTEGER) AS attempt, CASE id % 4 WHEN 1 THEN 'vague_expression' WHEN 3 THEN 'down' END AS reason FROM x"
)
def model_answers(spark, d):
    n = F.floor(F.abs("c_acctbal")).cast("long") % 900 + 10
    rows = spread(table(spark, d, "customer")).select(
        F.col("c_custkey").alias("id"), F.concat(_company(), F.lit(", 시리즈A 투자 유치")).alias("title"), F.lit("매체").alias("source"), F.lit("").alias("description"),
        F.concat(_company(), F.lit(" "), n.cast("string"), F.lit("억 원 조달, 시리즈A")).alias("text"), F.lit(False).alias("described"), F.concat(_company(), F.lit(" 소식")).alias("summary"),
    )
    return answers.answered(rows, _stub, PACK)


@query("SELECT conv_id, coalesce(min_by(text, turn) FILTER (WHERE role = 'assistant' AND text IS NOT NULL), '') AS answer FROM conversations GROUP BY conv_id")
def response_texts(spark, d):
    """Conversations as nested responses: an output per turn, whose content says by its type whether it is an answer."""
    kind = F.when(F.col("role") == "assistant", "output_text").otherwise("input_text")
    turn = F.struct("turn", F.struct(F.array(F.struct(F.lit("reasoning").alias("type"), F.lit(1).alias("text")).cast("struct<type:string,text:string>"), F.struct(kind.alias("type"), "text")).alias("content")).alias("output"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("held"))
    payload = F.to_json(F.struct(F.lit(None).cast("string").alias("output_text"), F.col("held.output").alias("output")))
    return rows.select("conv_id", answers.response_text(payload).alias("answer"))


# --- the queue -------------------------------------------------------------------------------------------------------


def _asked(text: str, retry: int) -> str:
    """A service that refuses every fifth request once."""
    if int(text) % 5 == 0 and not retry:
        raise model_queue.Limited("Rate limit reached: requests per min. Please try again in 25s")
    return f"answer {text}"


@query(
    """WITH e AS (SELECT event_id AS id, CAST(user_id % 8 AS VARCHAR) AS queue, epoch_us(ts) // 1000 AS ready, CASE WHEN event_id % 5 = 0 THEN 32000 ELSE 7000 END AS work FROM events),
s AS (SELECT *, coalesce(sum(work) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e WINDOW w AS (PARTITION BY queue ORDER BY ready, id)),
b AS (SELECT *, before + max(ready - before) OVER (PARTITION BY queue ORDER BY ready, id ROWS UNBOUNDED PRECEDING) AS begun FROM s),
t AS (SELECT *, begun + work - 7000 AS started FROM b)
SELECT queue, id, 'answer ' || id AS answer, CAST(CASE WHEN work > 7000 THEN 2 ELSE 1 END AS INTEGER) AS calls, make_timestamp(CAST(started AS BIGINT) * 1000) AS started FROM t WHERE started <= (SELECT max(epoch_us(ts) // 1000) FROM events)"""
)
def stream_model_queue(spark, d):
    """Events as requests of eight accounts; what has been served by the time of the last one."""
    from siftwell.streaming.windows import drained

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _stream(spark, d).select((F.col("user_id") % 8).cast("string").alias("queue"), F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("text"), "ts")
    done = drained(model_queue.served(rows, _asked, model_queue.Limits(budget=1 << 40)))
    return done.select("queue", "id", "answer", "calls", "started")


# --- robots ----------------------------------------------------------------------------------------------------------


def _rules(origin: str) -> str:
    """What an origin's robots.txt says here: hosts of an odd length keep crawlers from /en, but for /en/1."""
    if len(origin) % 2:
        return "User-agent: *\nDisallow: /en\nAllow: /en/1\n"
    raise TimeoutError(origin)


@query(
    "WITH p AS (SELECT page_id AS id, url, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages) "
    "SELECT id, NOT (length(origin) % 2 = 1 AND starts_with(path, '/en') AND NOT starts_with(path, '/en/1')) AS allowed FROM p"
)
def stream_robots_memo(spark, d):
    rows = streamed(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    return robots.robots_memo(rows, _rules, "siftwell").select("id", "allowed")


# --- feeds -----------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT page_id AS id, page_id % 24 AS feed, url FROM pages), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY feed ORDER BY id) - 1 AS INTEGER) AS "at" FROM p)
SELECT 'feed ' || feed AS source, CASE feed % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' ELSE 'sitemap' END AS kind, "at", url, CASE WHEN feed % 3 < 2 THEN 'Page & ' || id ELSE '' END AS title, '2024-01-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') AS published, CAST(NULL AS VARCHAR) AS error FROM r WHERE "at" < 40 AND feed % 8 <> 7
UNION ALL SELECT DISTINCT 'feed ' || feed, NULL, CAST(NULL AS INTEGER), NULL, NULL, NULL, 'no whole feed' FROM p WHERE feed % 8 = 7"""
)
def feed_source(spark, d):
    """Feeds written from the pages, read back through the data source; every eighth is broken off."""
    feed, day = F.col("page_id") % 24, F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    title = F.concat(F.lit("<title><![CDATA[Page &amp; "), "page_id", F.lit("]]></title>"))
    items = {
        0: F.concat(F.lit("<item>"), title, F.lit("<link>"), url, F.lit("</link><pubDate>"), day, F.lit("</pubDate></item>")),
        1: F.concat(F.lit("<entry>"), title, F.lit("<link rel='alternate' href='"), url, F.lit("'/><updated>"), day, F.lit("</updated></entry>")),
        2: F.concat(F.lit("<url><loc>"), url, F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url>")),
    }
    whole = {0: ("<rss><channel>", "</channel></rss>"), 1: ("<feed>", "</feed>"), 2: ("<urlset>", "</urlset>")}
    pick = lambda values: F.when(feed % 3 == 0, values[0]).when(feed % 3 == 1, values[1]).otherwise(values[2])
    rows = table(spark, d, "pages").select("page_id", feed.alias("feed"), pick(items).alias("item"), pick({k: v[0] for k, v in whole.items()}).alias("head"), pick({k: v[1] for k, v in whole.items()}).alias("tail"))
    rows = rows.groupBy("feed", "head", "tail").agg(F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("held"))
    text = F.concat("head", F.array_join("held.item", "\n"), F.when(F.col("feed") % 8 != 7, F.col("tail")).otherwise(""))
    path = _folder(spark)
    rows.select(text.alias("value"), F.concat(F.lit("feed "), "feed").alias("source")).write.partitionBy("source").text(path)
    feed_reader.register(spark)
    return spark.read.format("feeds").option("most", 40).load(path)


# --- counted writes --------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS raw_count, count_if(length(text) >= 300) AS candidate_count, count_if(length(text) >= 300 AND lang = 'en') AS final_count, count(DISTINCT source) FILTER (WHERE source IS NOT NULL) AS sources_ok FROM documents")
def run_status(spark, d):
    """A run's counts, taken while its rows are written; the sources' number comes from the table that was written."""
    long = F.length("text") >= 300
    counters = {"raw_count": F.count("*"), "candidate_count": F.count_if(long), "final_count": F.count_if(long & (F.col("lang") == "en"))}
    path = _folder(spark)
    counts = sinks.written(table(spark, d, "documents").select("doc_id", "source", "lang", "text"), path, counters)
    sources = spark.read.parquet(path).agg(F.count_distinct("source").alias("sources_ok"))
    return sources.select(*(F.lit(counts[name]).cast("long").alias(name) for name in counters), "sources_ok")


# --- the batch run's reasons -----------------------------------------------------------------------------------------

#: Title, source (an index of the pack's, or -1), category and reason of entries made of customers.
JUDGED = [
    ("코스닥 상장사 {c} 급등주 마감", 0, "hard_exclude_stock_market"), ("{c} 오늘의 날씨와 산책", 0, "broad_signal_missing"), ("삼성 유상증자 결정, 스타트업 {c} 투자", 0, "hard_exclude_public_company_rights_issue"),
    ("AI 스타트업 {c}, {n}억원 시리즈A 투자 유치", -1, "source_not_allowed_recovery_candidate"),
]


def _entries(spark, d):
    """Customers as entries of a run; one in five lies before the range."""
    from siftwell.plans.headlines import _filled

    kind = (F.col("c_custkey") % len(JUDGED)).cast("int")
    allowed = F.get(F.array(*(F.lit(k >= 0) for _, k, _ in JUDGED)), kind)
    day = F.when(F.col("c_custkey") % 5 == 4, "2023-12-01").otherwise("2024-01-02").cast("timestamp")
    return spread(table(spark, d, "customer")).select(
        F.col("c_custkey").alias("id"), _filled([t for t, _, _ in JUDGED], kind).alias("title"), F.lit("").alias("description"), F.when(allowed, PACK.sources[0]).otherwise("어느 블로그").alias("source"),
        F.concat(F.lit("https://news.example/a/"), "c_custkey").alias("url"), day.alias("published_at"), F.lit("primary").alias("feed_priority"), F.lit(5).alias("source_weight"), F.lit(True).alias("is_domestic"),
        F.array().cast("array<string>").alias("category_hints"),
    )


@query(f"SELECT c_custkey AS id, [{', '.join(repr(r) for _, _, r in JUDGED)}][CAST(c_custkey % {len(JUDGED)} + 1 AS INTEGER)] AS reason FROM customer WHERE c_custkey % 5 <> 4")
def news_candidates(spark, d):
    """The news pack's verdicts on entries in the range."""
    from siftwell.plans import curation

    rows = curation.candidates(_entries(spark, d), PACK, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-03").cast("timestamp"))
    return rows.select("id", F.col("exclude_reason").alias("reason"))


# --- sources and documents -------------------------------------------------------------------------------------------


@query(
    "SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN 'network' WHEN page_id % 7 = 1 THEN 'http_404' WHEN page_id % 7 = 2 THEN 'content_type' WHEN page_id % 7 = 3 AND strlen(html) > 3000 THEN 'too_large' END AS reason, "
    "NOT (page_id % 7 < 3 OR (page_id % 7 = 3 AND strlen(html) > 3000)) AS ok FROM pages WHERE html IS NOT NULL"
)
def fetched_pages(spark, d):
    from siftwell.sources import feeds

    kind = F.col("page_id") % 7
    rows = table(spark, d, "pages").where("html is not null").select(F.col("page_id").alias("id"), "url", "html", F.when(kind != 0, F.when(kind == 1, 404).otherwise(200)).alias("status"), F.when(kind == 2, "image/png").when(kind > 3, "text/html; charset=utf-8").alias("content_type"))
    small = rows.where("id % 7 = 3")
    return feeds.fetched(small, 3000).unionByName(feeds.fetched(rows.where("id % 7 <> 3"))).select("id", "reason", "ok")


@query(r"SELECT c_custkey AS id, 'https://news.google.com/rss/search?q=' || replace(url_encode(c_name || ' & ' || c_mktsegment || ' when:2d'), '%20', '+') || '&hl=ko&gl=KR&ceid=KR:ko' AS url FROM customer")
def discovery_urls(spark, d):
    from siftwell.sources import feeds

    rows = spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("id"), F.concat_ws(" & ", "c_name", "c_mktsegment").alias("query"))
    return feeds.discovery_feeds(rows).select("id", "url")


@query(
    "WITH n AS (SELECT count_if(doc_id % 4 = 0) AS strong, count_if(doc_id % 4 = 0 AND lang = 'en') AS domestic, CAST((SELECT count(*) FROM documents) // 4 AS BIGINT) AS quarter FROM documents) "
    "SELECT k, strong < quarter * k // 2 OR domestic < quarter // 10 * k AS needed FROM n, (VALUES (0), (1), (2), (3), (9)) v(k)"
)
def discovery_gate(spark, d):
    """Whether search feeds run, by ever larger wants."""
    from siftwell.sources import feeds

    docs = table(spark, d, "documents")
    rows = docs.select(F.when(F.col("doc_id") % 4 == 0, "A").alias("connection_type"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("is_domestic"))
    quarter = docs.count() // 4
    told = [(k, feeds.discovery_needed(rows, True, quarter * k // 2, quarter // 10 * k)) for k in (0, 1, 2, 3, 9)]
    return spark.createDataFrame(told, "k int, needed boolean")


@query(
    "WITH p AS (SELECT page_id AS id, page_id % 30 AS g, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS n FROM p) "
    "SELECT 'https://list.example/' || CASE WHEN id % 6 = 3 THEN 'private/' ELSE '' END || 'story/' || id AS url, 'The licence of story ' || id AS title, CAST('2024-02-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') AS TIMESTAMP) AS published "
    "FROM r WHERE id % 5 <> 0 AND id % 6 <> 3 AND n <= 50"
)
def list_page_links(spark, d):
    """Links of list pages whose titles pass the gate, with detail pages' dates, where robots rules allow them."""
    from siftwell.packs.corpus import PACK as corpus
    from siftwell.sources import feeds

    rows = table(spark, d, "pages").select("page_id")
    path = F.concat(F.when(F.col("page_id") % 6 == 3, "private/").otherwise(""), F.lit("story/"), "page_id")
    named = F.when(F.col("page_id") % 5 == 0, "Zzyx qwrt plgh vbnm").otherwise(F.concat(F.lit("The licence of story "), "page_id"))
    link = F.concat(F.lit("<li><a class='x headline' href='/"), path, F.lit("#top'>"), named, F.lit("</a></li>"))
    pages = rows.withColumn("link", link).groupBy((F.col("page_id") % 30).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("page_id").alias("at"), F.col("link").alias("x")))).alias("held"))
    pages = pages.select("page_id", F.lit("https://list.example/").alias("url"), F.concat(F.lit("<ul>"), F.array_join("held.x", "\n"), F.lit("</ul><a href='/story/0'>The licence of nobody</a>")).alias("html"))
    day = F.concat(F.lit("2024-02-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")).cast("timestamp")
    details = rows.select(F.concat(F.lit("https://list.example/"), path).alias("url"), day.alias("published"))
    robots_text = rows.limit(1).select(F.lit("https://list.example").alias("origin"), F.lit("User-agent: *\nDisallow: /private").alias("text"))
    source = feeds.Source("list", link_selectors=("a.headline",), max_items=50)
    return feeds.html_list(pages, corpus, source, details, robots_text, "siftwell").select("url", "title", "published")


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'sitemap' ELSE 'gopher' END AS type, CASE WHEN s_suppkey % 3 = 2 THEN 'unsupported type: gopher' END AS error, CASE WHEN s_suppkey % 3 < 2 THEN 'https://s.example/' || s_suppkey END AS url FROM supplier")
def dispatched_sources(spark, d):
    """Sources by type, each read by its own reader; those without one keep an error."""
    from siftwell.sources import feeds

    link = F.concat(F.lit("https://s.example/"), "s_suppkey")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "rss").when(F.col("s_suppkey") % 3 == 1, "sitemap").otherwise("gopher")
    text = F.when(kind == "rss", F.concat(F.lit("<rss><channel><item><title>t</title><link>"), link, F.lit("</link></item></channel></rss>"))).otherwise(F.concat(F.lit("<urlset><url><loc>"), link, F.lit("</loc><lastmod>2024-01-02</lastmod></url></urlset>")))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), kind.alias("type"), F.col("s_suppkey").cast("string").alias("source"), text.alias("text"), F.array().cast("array<string>").alias("allow"), F.lit(9).alias("max_items"))
    readers = {"rss": lambda p: feeds.rss(p).select(F.col("feed").alias("source"), F.col("link").alias("url"), F.lit("rss").alias("type")), "sitemap": lambda p: feeds.sitemap(p).select("source", "url", F.lit("sitemap").alias("type"))}
    read, failed = feeds.dispatched(rows, readers)
    good = read.select(F.col("source").cast("long").alias("id"), "type", F.lit(None).cast("string").alias("error"), "url")
    return good.unionByName(failed.select("id", "type", "error", F.lit(None).cast("string").alias("url")))


@query("SELECT strftime(ts, '%Y-%m-%d') AS latest, n FROM (SELECT max(ts) AS ts, count(DISTINCT CAST(ts AS DATE)) AS n FROM events)")
def archive_of_briefings(spark, d):
    """Briefings are written day by day; the index of what is there: its latest date and the number of dates."""
    path = _folder(spark)
    rows = table(spark, d, "events").select("event_id", F.to_date("ts").alias("briefing_date"))
    rows.write.partitionBy("briefing_date").parquet(path)
    found = sinks.index(sinks.read_briefings(spark, path))
    return found.select("latest", F.size("dates").cast("long").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS summary, max(event_id) % 2 = 0 AS even FROM events GROUP BY user_id")
def cache_document(spark, d):
    """A cache written as JSON and read back."""
    from siftwell.sources import feeds

    rows = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("summary"), F.max("event_id").alias("last"))
    path = _folder(spark)
    sinks.write_cache(rows.select(F.col("user_id").cast("string").alias("key"), "summary", (F.col("last") % 2 == 0).alias("even")), path)
    return feeds.cached(spark, path).select("key", "summary", "even")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || '가온투자유치' WHEN c_custkey % 3 = 1 THEN c_custkey || '나래펀드결성' ELSE 'lab' || c_custkey || '새앱출시' END AS bare FROM customer")
def without_particles(spark, d):
    """Titles of one event compare equal whatever their particles."""
    from siftwell.functions import text

    c = _company()
    told = F.when(F.col("c_custkey") % 3 == 0, F.concat(c, F.lit("은 투자를 유치함"))).when(F.col("c_custkey") % 3 == 1, F.concat(c, F.lit("가, 펀드를 결성했음!"))).otherwise(F.concat(c, F.lit("에서 새 앱을 출시됐음")))
    return spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("id"), text.without_particles(told, PACK).alias("bare"))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Firm' || c_custkey WHEN 1 THEN 'Zed' || c_custkey WHEN 2 THEN c_custkey || '가온' END AS company FROM customer")
def company_names(spark, d):
    """By its verb, in quotes, as a sentence's subject, or not at all."""
    from siftwell.operators import rules

    k = F.col("c_custkey")
    title = F.when(k % 4 == 0, F.concat(F.lit("Berlin-based Firm"), k, F.lit(" raises €5 million | EU-Startups"))).when(k % 4 == 1, F.concat(F.lit("오늘의 소식 ‘Zed"), k, F.lit("’ 화제"))).otherwise(F.lit("오늘의 소식."))
    summary = F.when(k % 4 == 2, F.concat(k, F.lit("가온은 30억 원 투자 유치를 마쳤다"))).otherwise("")
    return spread(table(spark, d, "customer")).select(k.alias("id"), rules.company(PACK, title, summary).alias("company"))


@query(
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'missing_title' WHEN c_custkey % 6 = 1 THEN 'missing_summary' WHEN c_custkey % 6 = 2 THEN 'google_news_url_forbidden' WHEN c_custkey % 6 = 3 THEN 'hard_exclude_stock_market' WHEN c_custkey % 6 = 4 THEN 'invalid_article_url' END AS reason FROM customer"
)
def item_reasons(spark, d):
    """What keeps an item from being published; every sixth may be, without a summary if none is to be had."""
    from siftwell.operators import quality

    k = F.col("c_custkey") % 6
    rows = spread(table(spark, d, "customer")).select(
        F.col("c_custkey").alias("id"), F.when(k == 0, " ").when(k == 3, "코스닥 급등주 마감").otherwise(F.concat(_company(), F.lit(" 소식"))).alias("title"),
        F.when(k == 2, "https://news.google.com/articles/x").when(k == 4, "ftp://a.example/x").otherwise("https://a.example/x").alias("url"), F.lit("매체").alias("source"), F.lit("VC / AC").alias("category"),
        F.when(k == 5, "unavailable").otherwise("description").alias("summary_type"), F.when((k == 1) | (k == 5), "").otherwise("가온이 앱을 출시").alias("summary"), F.lit("").alias("description"), F.lit("").alias("body"),
    )
    return rows.select("id", quality.item_reason(PACK).alias("reason"))


@query(
    "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'openai_description_same_as_title' WHEN 1 THEN 'openai_description_too_short' WHEN 2 THEN 'openai_description_missing_event' WHEN 3 THEN 'openai_description_too_long' END AS reason FROM customer"
)
def description_reasons(spark, d):
    """What is wrong with a model's summary of a description."""
    from siftwell.operators import quality

    c, k = _company(), F.col("c_custkey") % 6
    title = F.concat(c, F.lit(", 시리즈A 투자 유치"))
    good = F.concat(c, F.lit("이 물류 로봇의 해외 판로를 넓히려고 시리즈A 투자를 유치"))
    summary = F.when(k == 0, title).when(k == 1, "로봇 시장 소식").when(k == 2, F.concat(c, F.lit("이 물류 로봇의 해외 판로를 넓히려고 오늘도 길을 걷는다"))).when(k == 3, F.concat(good, F.repeat(F.lit(" 아주 길게"), 30), F.lit(" 유치"))).otherwise(good)
    return spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("id"), quality.model_description_reason(PACK, title, summary, F.lit("매체")).alias("reason"))


# --- texts of each kind that a rule tells apart ------------------------------------------------------------------------

#: English headlines with what is told of them, or None.
FUNDED = [
    ("Berlin-based Firm{k} raises €5 million Series B to build rovers | EU-Startups", "Firm{k} raised €5 million in a Series B round."), ("UK startup Firm{k} raises €5 million to build {m} rovers", "Firm{k} raised €5 million to build {m} rovers."), ("Firm{k} extends seed round to €{m} million", "Firm{k} extended its seed round to €{m} million in total funding."),
    ("Firm{k} secures $7.5 million to " + "build " * 30, "Firm{k} raised $7.5 million."), ("Firm{k} raises €5.", None), ("Firm{k} raises money", None), ("The market of {k} robots grew by €5 million", None), ("Firm{k} closed £{m} million", "Firm{k} raised £{m} million."),
]
#: Titles and bodies with the hard reason that holds, and whether the title is protected.
EXCLUDED = [
    ("코스피 {k}호 유상증자 결정", "", "hard_exclude_public_company_rights_issue", False), ("특징주 {k} 급등", "", "hard_exclude_stock_market", False), ("삼성 {k}공장 증설", "", "hard_exclude_large_corp_industrial_investment", False),
    ("{k}팀 특별 포상 받아", "", "hard_exclude_government_promotion_award", False), ("{k} 그룹 창립 기념", "과거 벤처기업으로 출발했다.", "hard_exclude_historical_venture_origin_only", False), ("스타트업 {k}, 시리즈A 투자 유치", "", None, True),
    ("팁스 {k}기 선정", "", None, True), ("팁스 {k}기 소식", "", None, False),
]


def _texts(shapes: list[str | None], key) -> object:
    out = F.get(F.array(*(F.lit(s).cast("string") for s in shapes)), (key % len(shapes)).cast("int"))
    return F.replace(F.replace(out, F.lit("{k}"), key.cast("string")), F.lit("{m}"), (key % 40 + 2).cast("string"))


def _told(values: list, key: str) -> str:
    quoted = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    listed = f"[{', '.join(map(quoted, values))}][CAST({key} % {len(values)} + 1 AS INTEGER)]"
    return listed if isinstance(values[0], bool) else f"replace(replace({listed}, '{{k}}', CAST({key} AS VARCHAR)), '{{m}}', CAST({key} % 40 + 2 AS VARCHAR))"


@query(f"SELECT o_orderkey AS id, {_told([t for _, t in FUNDED], 'o_orderkey')} AS sentence FROM orders")
def overseas_funding(spark, d):
    """Orders as English funding headlines: stages, extensions, cut and missing amounts, purposes too long."""
    from siftwell.operators import summaries

    key = F.col("o_orderkey")
    return spread(table(spark, d, "orders")).select(key.alias("id"), summaries.overseas_sentence(PACK, _texts([t for t, _ in FUNDED], key)).alias("sentence"))


@query(f"SELECT o_orderkey AS id, {_told([r for _, _, r, _ in EXCLUDED], 'o_orderkey')} AS reason, {_told([p for _, _, _, p in EXCLUDED], 'o_orderkey')} AS protected FROM orders")
def news_hard_reasons(spark, d):
    """Each hard reason of the news pack, and titles that selection protects."""
    from siftwell.operators import rules

    key = F.col("o_orderkey")
    title, body = _texts([t for t, _, _, _ in EXCLUDED], key), _texts([b for _, b, _, _ in EXCLUDED], key)
    rows = spread(table(spark, d, "orders")).select(key.alias("id"), title.alias("title"), body.alias("body"))
    return rows.select("id", rules.hard_exclusion(PACK, F.col("title"), F.lit(""), F.col("body"), F.lit("")).alias("reason"), rules.protected(PACK, F.col("title")).alias("protected"))


_LONG = "이 회사는 물류 로봇을 만드는 곳으로 알려져 있다. "


@query(f"SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'paywall' WHEN 1 THEN 'body_too_short' END AS failure, CASE WHEN page_id % 3 = 2 THEN {12 * len(_LONG)} + length(CAST(page_id AS VARCHAR)) ELSE 0 END AS n FROM pages")
def paywalled_pages(spark, d):
    """Pages behind a paywall, with too little text, and whole ones."""
    from siftwell.functions import html

    key = F.col("page_id")
    wall = F.when(key % 3 == 0, "<p>이 기사는 유료 회원만 볼 수 있습니다.</p>").otherwise("")
    story = F.concat(F.when(key % 3 == 2, _LONG * 12).otherwise(_LONG), key.cast("string"))
    page = F.concat(F.lit("<html><body><article><p>"), story, F.lit("</p></article>"), wall, F.lit("</body></html>"))
    return table(spark, d, "pages").select(key.alias("id"), html.extraction(page, PACK).alias("x")).select("id", "x.failure", F.length("x.text").cast("long").alias("n"))


_FILLER = "오늘은 비가 온다. "


@query(
    f"WITH x AS ({_CUSTOMERS}), t AS (SELECT id, c, trim(substring(repeat('{_FILLER}', 150), 1, 1500)) || chr(10) || '핵심 문장:' || chr(10) || c || '은 ' || n || '억 원 투자 유치를 마쳤다고 오늘 밝혔다.' || CASE WHEN id % 2 = 0 THEN chr(10) || '다음 달에는 새 서비스를 ' || m || '개 도시에 출시한다.' ELSE '' END AS text FROM x) "
    "SELECT id, text, CAST(ceil(length(c || ', 투자 유치 매체 VC / AC ' || replace(text, chr(10), ' ')) / 2) AS BIGINT) + 350 AS estimated_tokens FROM t"
)
def model_inputs(spark, d):
    """What a model is given of a long body: its beginning, and the key sentences beyond it, without repeats, notices and what is too short."""
    from siftwell.operators import summaries

    n, m = F.floor(F.abs("c_acctbal")).cast("long") % 900 + 10, F.col("c_custkey") % 40 + 2
    key = F.concat(_company(), F.lit("은 "), n.cast("string"), F.lit("억 원 투자 유치를 마쳤다고 오늘 밝혔다. "))
    more = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("다음 달에는 새 서비스를 "), m.cast("string"), F.lit("개 도시에 출시한다. "))).otherwise("")
    body = F.concat(F.lit(_FILLER * 150), key, F.lit("짧은 투자. "), F.replace(key, F.lit("마쳤다고"), F.lit("마쳤다고 ")), more, F.lit("재배포 금지 안내와 함께 30억 원 투자 유치 소식을 전한다. 날씨는 내일도 오늘처럼 아주 흐릴 것으로 보인다."))
    rows = spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("id"), F.concat(_company(), F.lit(", 투자 유치")).alias("title"), F.lit("매체").alias("source"), F.lit("VC / AC").alias("category"), F.lit("").alias("description"), body.alias("body"))
    return summaries.model_input(rows, PACK)
