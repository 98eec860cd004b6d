"""Queries over the driver's tables, one per group of operators, and the same in DuckDB SQL.

A document stands for an article: its first line is the title, the rest of the text the description, the text the body;
every row counts, with its whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import html, similarity, text, times, urls
from siftwell.operators import aggregates, dedup, joins, quality, rules, selection, summaries
from siftwell.packs.corpus import PACK
from siftwell.plans import curation, serving
from siftwell.streaming import windows

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to all cores: a file of one row group is one task, however much is to be done for each row."""
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"),
        F.split_part(body, F.lit("\n"), F.lit(1)).alias("title"),
        F.when(F.instr(body, "\n") > 0, F.substr(body, F.instr(body, "\n") + 1)).otherwise("").alias("description"),
        body.alias("body"),
        "source",
        (F.col("lang") == "en").alias("is_domestic"),
        F.array("lang").alias("category_hints"),
        F.timestamp_add("MINUTE", (F.col("doc_id") % 43200).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("published_at"),
        F.when(F.col("doc_id") % 3 == 0, "primary").when(F.col("doc_id") % 3 == 1, "secondary").otherwise("discovery").alias("feed_priority"),
        (F.col("doc_id") % 12).cast("int").alias("source_weight"),
        F.concat(F.lit("https://news.example.com/a/"), (F.col("doc_id") % 700).cast("string"), F.lit("?utm_source=feed&id=1")).alias("url"),
    )


# --- the same in SQL -------------------------------------------------------------------------------------------------

ARTICLES = """a AS (
  SELECT doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS title, CASE WHEN contains(coalesce(text, ''), chr(10)) THEN substring(text, strpos(text, chr(10)) + 1) ELSE '' END AS description, coalesce(text, '') AS body, source,
    lang = 'en' AS is_domestic, [lang] AS category_hints, TIMESTAMP '2024-01-01' + to_minutes(doc_id % 43200) AS published_at,
    CASE doc_id % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'discovery' END AS feed_priority, CAST(doc_id % 12 AS INTEGER) AS source_weight,
    'https://news.example.com/a/' || (doc_id % 700) || '?utm_source=feed&id=1' AS url
  FROM documents)"""


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def s_clean(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
        x = f"regexp_replace({x}, '(?i)&{name};', '{char}', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def s_form(x: str) -> str:
    return f"lower({s_clean(x)})"


def s_print(x: str) -> str:
    return rf"regexp_replace(regexp_replace({s_form(x)}, '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def s_tokens(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex({s_form(x)}, '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 1))"


def s_grams(form: str) -> str:
    return f"list_transform(range(1, greatest(length({form}), 1)), lambda i: substring({form}, i, 2))"


def s_match(x: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches(coalesce({x}, ''), {_quoted(('(?i)' if ignore_case else '') + pattern)})"


def s_keyword(form: str, word: str) -> str:
    word = word.lower()
    return rf"regexp_matches({form}, {_quoted('(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}])' + word + '($|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}])')})" if word.isascii() else f"contains({form}, {_quoted(word)})"


def s_hits(form: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST({s_keyword(form, w)} AS INTEGER)" for w in words) + ")" if words else "0"


def s_case(pairs: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in pairs) + f" ELSE {otherwise} END"


def s_jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {both} / (len({a}) + len({b}) - {both}) ELSE 0.0 END"


def s_dice(a: str, b: str) -> str:
    count = "len(list_filter({}, lambda z: z = y))"
    both = f"coalesce(list_sum(list_transform(list_distinct(list_intersect({a}, {b})), lambda y: least({count.format(a)}, {count.format(b)}))), 0)"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2.0 * {both} / (len({a}) + len({b})) ELSE 0.0 END"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- text ------------------------------------------------------------------------------------------------------------


@query(f"WITH {ARTICLES} SELECT id, {s_clean('title')} AS cleaned, {s_form('description')} AS form FROM a")
def clean_text(spark, d):
    return articles(spark, d).select("id", text.clean(F.col("title")).alias("cleaned"), text.match_form(F.col("description")).alias("form"))


@query(f"WITH {ARTICLES} SELECT id, {s_print('title')} AS fp FROM a")
def title_fingerprint(spark, d):
    return articles(spark, d).select("id", text.fingerprint(F.col("title")).alias("fp"))


@query(f"WITH {ARTICLES} SELECT id, array_to_string(list_sort({s_tokens('title')}), ' ') AS tokens FROM a")
def token_set(spark, d):
    return articles(spark, d).select("id", F.array_join(F.sort_array(text.tokens(F.col("title"))), " ").alias("tokens"))


@query(f"WITH {ARTICLES}, f AS (SELECT id, {s_print('title')} AS fp FROM a) SELECT id, array_to_string({s_grams('fp')}, ' ') AS grams FROM f")
def title_bigrams(spark, d):
    return articles(spark, d).select("id", F.array_join(text.bigrams(F.col("title")), " ").alias("grams"))


@query(f"WITH {ARTICLES} SELECT id, substring(sha256(url || '|' || {s_print('title')}), 1, 16) AS article_id, substring(sha256({s_clean('description')}), 1, 16) AS description_hash, substring(sha256(url || '|' || {s_print('title')} || '|' || substring(sha256({s_clean('description')}), 1, 16)), 1, 24) AS cache_key FROM a")
def article_keys(spark, d):
    t, u, x = F.col("title"), F.col("url"), F.col("description")
    return articles(spark, d).select("id", text.article_id(u, t).alias("article_id"), text.description_hash(x).alias("description_hash"), text.cache_key(u, t, x).alias("cache_key"))


_SEARCH_TITLE = rf"regexp_replace({s_form('title')}, '[^a-z0-9\x{{AC00}}-\x{{D7A3}}]+', '', 'g')"


@query(
    rf"WITH {ARTICLES} SELECT id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS searched, {_SEARCH_TITLE} AS search_title, len(regexp_extract_all(body, '[A-Za-z]')) >= 20 AS latin, "
    rf"CASE WHEN length({s_clean('title')}) <= 60 THEN {s_clean('title')} ELSE trim(regexp_replace(substring({s_clean('title')}, 1, 60), '\s+\S*$', '')) END AS short FROM a"
)
def text_forms(spark, d):
    t = F.col("title")
    return articles(spark, d).select("id", text.search_form(t).alias("searched"), text.search_title(t).alias("search_title"), text.mostly_latin(F.col("body")).alias("latin"), text.truncated(t, 60).alias("short"))




@query(
    "WITH c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '\\r?\\n+', '. ', 'g') AS text FROM conversations), "
    f"s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all({s_clean('text')}, '[^.!?。]+[.!?。]?'), lambda x: trim(x)), lambda x: x <> '') AS s FROM c) "
    "SELECT conv_id, turn, CAST(len(s) AS INTEGER) AS n, array_to_string(s, '|') AS sentences FROM s"
)
def sentence_split(spark, d):
    s = text.sentences(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(s).alias("n"), F.array_join(s, "|").alias("sentences"))


@query()
def nfkc_form(spark, d):
    return articles(spark, d).select("id", text.match_form(F.col("title"), full=True).alias("form"))


# --- URLs and pages --------------------------------------------------------------------------------------------------

_URL = r"^(https?)://([^/?#@]*@)?([^/?#:]*)(:\d+)?(/[^?#]*)?(\?[^#]*)?(#.*)?$"


def s_part(k: int, x: str = "url") -> str:
    return rf"coalesce(regexp_extract(trim({x}), '(?i){_URL}', {k}), '')"


_KEPT = f"list_filter(string_split(substring({s_part(6)}, 2), '&'), lambda p: p <> '' AND NOT list_contains([{', '.join(map(_quoted, urls.TRACKING))}], lower(split_part(p, '=', 1))))"
_CANONICAL = f"CASE WHEN {s_part(3)} <> '' THEN lower({s_part(1)}) || '://' || {s_part(2)} || lower({s_part(3)}) || CASE WHEN {s_part(4)} IN ('', ':80', ':443') THEN '' ELSE {s_part(4)} END || CASE WHEN {s_part(5)} = '' THEN '/' ELSE {s_part(5)} END || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END END"


@query(f"SELECT page_id, {_CANONICAL} AS canonical, lower({s_part(3)}) AS host, lower({s_part(3)}) <> '' AS safe, lower({s_part(3)}) = 'news.google.com' AS aggregator FROM pages")
def canonical_url(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.canonical(u).alias("canonical"), urls.host(u).alias("host"), urls.is_safe(u).alias("safe"), urls.is_aggregator(u).alias("aggregator"))


def s_noise(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '(?s)<!--.*?-->', ' ', 'g')"
    for tag in html.NOISE:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return x


def s_region(x: str) -> str:
    return "coalesce(" + ", ".join(rf"nullif(regexp_extract({x}, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1), '')" for t in ("article", "main", "body")) + f", {x})"


@query(f"SELECT page_id, CAST(length({s_noise('html')}) AS INTEGER) AS n, md5({s_noise('html')}) AS noise_free, md5({s_region('html')}) AS region FROM pages")
def page_regions(spark, d):
    h = F.col("html")
    clear = html.without_noise(h)
    return table(spark, d, "pages").select("page_id", F.length(clear).alias("n"), F.md5(clear).alias("noise_free"), F.md5(html.body_region(h)).alias("region"))


def s_boiler(x: str) -> str:
    one = "|".join(f"({p})" for p in PACK.boilerplate)
    by = "|".join(f"({p})" for p in PACK.bylines)
    return f"({x} = '' OR {s_match(x, by)} OR (regexp_matches({x}, '^[▶◆■●※]') AND length({x}) < 100) OR {s_match(x, one)})"


def s_stripped(x: str) -> str:
    x = s_clean(x)
    for pattern, instead in PACK.strip:
        x = f"regexp_replace({x}, {_quoted('(?i)' + pattern)}, {_quoted(instead)}, 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@query(
    rf"WITH b AS (SELECT page_id, unnest(string_split_regex(regexp_replace({s_noise(s_region('html'))}, '(?i)</(p|h[1-6]|li|blockquote|div|section|article)>', chr(10), 'g'), '\n+')) AS raw, "
    rf"generate_subscripts(string_split_regex(regexp_replace({s_noise(s_region('html'))}, '(?i)</(p|h[1-6]|li|blockquote|div|section|article)>', chr(10), 'g'), '\n+'), 1) AS place FROM pages), "
    f"s AS (SELECT page_id, place, {s_stripped('raw')} AS x FROM b), k AS (SELECT page_id, place, x, lower(replace(x, ' ', '')) AS key FROM s WHERE length(x) >= 15 AND NOT {s_boiler('x')}), "
    "u AS (SELECT page_id, x, place FROM k QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY place) = 1), "
    "j AS (SELECT page_id, string_agg(x, ' ' ORDER BY place) AS article FROM u GROUP BY page_id) SELECT p.page_id, coalesce(article, '') AS article FROM pages p LEFT JOIN j USING (page_id)"
)
def page_article(spark, d):
    return table(spark, d, "pages").select("page_id", html.article_text(html.body_region(F.col("html")), PACK).alias("article"))


@query(rf"SELECT page_id, coalesce(nullif({s_clean(r'''regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)''')}, ''), nullif({s_clean(r'''regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)''')}, '')) AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


_CLIP = "regexp_extract(substring(body, 1, 1000), '(?s)^.*[.!]', 0)"


@query(f"WITH {ARTICLES} SELECT id, CASE WHEN length(body) <= 1000 THEN body WHEN length({_CLIP}) >= 650 THEN trim(substring(substring(body, 1, 1000), 1, length({_CLIP})), ' ') ELSE trim(substring(body, 1, 1000), ' ') END AS clipped, {s_boiler(s_clean('title'))} AS boilerplate FROM a")
def clipped_text(spark, d):
    return articles(spark, d).select("id", html.clipped(F.col("body"), 1000).alias("clipped"), html.is_boilerplate(text.clean(F.col("title")), PACK).alias("boilerplate"))


# --- rules -----------------------------------------------------------------------------------------------------------


def s_signals(title: str, description: str, body: str | None = None) -> str:
    rows = []
    for s in PACK.signals:
        pairs = [(s_match(title, s.pattern), _quoted(f"{s.name}:title")), (s_match(description, s.pattern), _quoted(f"{s.name}:description"))]
        rows.append(s_case([*pairs, (s_match(body, s.pattern), _quoted(f"{s.name}:body"))] if body else pairs))
    return f"list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)"


@query(f"WITH {ARTICLES} SELECT id, array_to_string({s_signals('title', 'description', 'body')}, ',') AS signals FROM a")
def matched_signals(spark, d):
    return articles(spark, d).select("id", F.array_join(rules.signals(PACK, F.col("title"), F.col("description"), F.col("body")), ",").alias("signals"))


def s_joined(*parts: str) -> str:
    return "concat_ws(' ', " + ", ".join(parts) + ")"


def s_has(x: str, name: str, ignore_case: bool = True) -> str:
    return s_match(x, PACK.concept(name), ignore_case)


def s_hard(title: str, description: str, body: str, summary: str) -> str:
    t, event, every = s_clean(title), s_clean(s_joined(s_clean(title), body, summary)), s_clean(s_joined(s_clean(title), description, body, summary))
    listed = s_has(every, "listed", False)
    current = f"({s_has(event, 'event')} AND ({s_has(event, 'target')} OR {s_has(event, 'ecosystem')}))"
    financed = s_has(s_clean(s_joined(s_clean(title), f"substring({body}, 1, 1200)")), "direct_investment")
    return s_case(
        [
            (f"{s_has(event, 'rights_issue')} AND {listed}", "'hard_exclude_public_company_rights_issue'"),
            (f"({s_has(t, 'market_noise')} OR {s_has(t, 'market_words')}) AND NOT {current}", "'hard_exclude_stock_market'"),
            (f"{listed} AND {s_has(event, 'plant')} AND NOT {financed}", "'hard_exclude_large_corp_industrial_investment'"),
            (s_has(event, "award"), "'hard_exclude_government_promotion_award'"),
            (f"{s_has(body, 'origin')} AND NOT {s_has(t, 'event')} AND NOT {current}", "'hard_exclude_historical_venture_origin_only'"),
        ]
    )


@query(f"WITH {ARTICLES} SELECT id, {s_hard('title', 'description', 'body', chr(39) * 2)} AS reason FROM a")
def hard_exclude_reason(spark, d):
    return articles(spark, d).select("id", rules.hard_exclusion(PACK, F.col("title"), F.col("description"), F.col("body"), F.lit("")).alias("reason"))


_CONNECTION = f"""f AS (SELECT *, {s_clean('title')} AS t, {s_clean('body')} AS b FROM a),
g AS (SELECT *, {s_clean(s_joined('t', 'description', 'b'))} AS cx, {s_clean(s_joined('t', 'b'))} AS ev, substring(b, 1, 700) AS lead FROM f),
h AS (SELECT *, {', '.join(f"{s_has('ev', n)} AS h_{n}" for n in ('target', 'ecosystem', 'actor', 'financing', 'support', 'collaboration', 'event', 'market_event'))},
  {s_has('t', 'target')} OR ({s_has('lead', 'target')} AND {s_has('lead', 'event')}) AS subject, {s_has('cx', 'large_company', False)} AS large, {s_has('cx', 'investment')} AS invest, {s_has('cx', 'editorial')} AS editorial,
  {s_has('cx', 'outlook')} OR {s_has('cx', 'general_tech')} OR {s_has('cx', 'achievement')} OR ({s_has('cx', 'capex')} AND NOT {s_has('ev', 'target')} AND NOT {s_has('ev', 'ecosystem')}) AS general,
  {s_has('b', 'origin')} AND NOT {s_has('t', 'event')} AS origin FROM g),
k AS (SELECT *, CASE WHEN (NOT h_event AND NOT subject AND NOT h_market_event) OR editorial OR (origin AND NOT h_market_event) THEN NULL
  WHEN h_target AND h_collaboration AND h_actor THEN 'E' WHEN h_actor AND (h_target OR h_ecosystem) AND (h_support OR h_financing OR h_collaboration) THEN 'B'
  WHEN h_financing AND (h_target OR h_ecosystem OR invest) THEN 'C' WHEN h_support AND (h_target OR h_ecosystem) THEN 'D' WHEN (subject AND h_event) OR h_market_event THEN 'A' END AS kind FROM h)"""


@query(
    f"WITH {ARTICLES}, {_CONNECTION} SELECT id, kind, large, general, array_to_string(list_filter([CASE WHEN NOT h_target AND NOT h_ecosystem THEN 'startup_or_venture_target' END, CASE WHEN NOT h_event AND NOT h_market_event THEN 'title_or_body_ecosystem_event' END, "
    "CASE WHEN large AND kind IS NULL THEN 'startup_link_for_public_company' END, CASE WHEN general AND kind IS NULL THEN 'startup_link_for_general_industry' END], lambda x: x IS NOT NULL), ',') AS missing FROM k"
)
def connection_type(spark, d):
    c = rules.connection_of(F.col("link"))
    return articles(spark, d).withColumn("link", rules.connection_struct(PACK, F.col("title"), F.col("description"), F.col("body"))).select("id", c.kind.alias("kind"), c.large_company.alias("large"), c.general_industry.alias("general"), F.array_join(c.missing, ",").alias("missing"))


def s_score(name: str) -> str:
    words = PACK.categories[name]
    return f"(least({s_hits('tf', words)}, 3) * 7 + least({s_hits('df', words)}, 4) * 3)"


_SCORES = f"""tf AS (SELECT *, {s_form('title')} AS tf, {s_form('description')} AS df FROM a),
cs AS (SELECT *, list_sort([{', '.join(f"{{'m': -{s_score(n)}, 'k': {k}, 'c': '{n}', 'matched': {s_hits('tf', w)} + {s_hits('df', w)} > 0}}" for k, (n, w) in enumerate(PACK.categories.items()))}]) AS scores FROM tf)"""


@query(f"WITH {ARTICLES}, {_SCORES} SELECT id, scores[1].c AS best, CAST(-scores[1].m AS INTEGER) AS best_score, scores[1].matched AS matched, array_to_string(list_transform(scores, lambda x: x.c || ':' || (-x.m)), ',') AS ranked FROM cs")
def category_score(spark, d):
    s = rules.category_scores(PACK, F.col("title"), F.col("description"), F.array())
    rows = articles(spark, d).withColumn("s", s)
    best = F.get("s", F.lit(0))
    return rows.select("id", best["category"].alias("best"), best["score"].alias("best_score"), best["matched"].alias("matched"), F.array_join(F.transform("s", lambda x: F.concat(x["category"], F.lit(":"), x["score"].cast("string"))), ",").alias("ranked"))


_CASCADE = s_case(
    [
        (s_has("cx", "secondary"), _quoted(PACK.secondary_category)),
        (s_has("cx", "program"), _quoted(PACK.program_category)),
        (f"{s_has('title', 'institutional_support')} OR {s_has('title', 'partnership')}", _quoted(PACK.default_category)),
        (s_has("title", "direct_investment"), _quoted(PACK.investment_category)),
        (s_has("cx", "tech_business"), _quoted(PACK.tech_category)),
        (s_has("title", "support_category"), _quoted(PACK.default_category)),
        (s_has("cx", "investment"), _quoted(PACK.investment_category)),
        (f"scores[1].matched AND scores[1].c NOT IN ({_quoted(PACK.investment_category)}, {_quoted(PACK.overseas_category)})", "scores[1].c"),
    ],
    _quoted(PACK.default_category),
)


@query(f"WITH {ARTICLES}, {_SCORES}, x AS (SELECT *, {s_joined('title', 'description')} AS cx FROM cs) SELECT id, {_CASCADE} AS category FROM x")
def category_cascade(spark, d):
    s = rules.category_scores(PACK, F.col("title"), F.col("description"), F.array())
    rows = articles(spark, d).withColumn("s", s)
    return rows.select("id", rules.category(PACK, F.col("title"), F.col("description"), F.array().cast("array<string>"), F.get("s", F.lit(0)), F.col("is_domestic"), F.lit(None).cast("string")).alias("category"))


def _adjustment_sql() -> str:
    parts = [s_case([(s_match("title", s.pattern), str(s.title)), (s_match("description", s.pattern), str(s.description))], "0") for s in PACK.signals if s.title or s.description or s.body]
    cx = s_joined("title", "description")
    event = s_has(cx, "strong_event")
    parts += [s_case([(s_has(cx, "editorial"), "-30")], "0"), s_case([(s_has(cx, "outlook"), f"CASE WHEN {event} THEN -5 ELSE -16 END")], "0"), s_case([(s_has(cx, "large_general"), f"CASE WHEN {event} THEN -5 ELSE -18 END")], "0")]
    parts.append(s_case([(f"category = {_quoted(PACK.overseas_category)}", f"(CASE WHEN {s_has(cx, 'overseas')} THEN 8 ELSE -24 END - CASE WHEN {s_has(cx, 'advice')} THEN 30 ELSE 0 END)")], "0"))
    return " + ".join(parts)


_ALLOWED = "(" + " OR ".join(f"contains(lower(source), '{s}') OR contains('{s}', lower(source))" for s in PACK.sources) + ")"
_FRESH = "greatest(0, least(4, CAST(floor(4 * (1 - (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(published_at)) / 2592000000000.0) + 0.5) AS INTEGER)))"
_RELEVANCE = f"""least({s_hits('tf', PACK.categories['english'])}, 3) * 7 + CASE WHEN {_ALLOWED} THEN 5 ELSE 0 END + CASE feed_priority WHEN 'primary' THEN 4 WHEN 'discovery' THEN -2 ELSE 0 END + greatest(0, least(10, source_weight)) + {_FRESH}
 - CASE WHEN length(title) < 12 THEN 4 ELSE 0 END - least({s_hits('tf', PACK.advertising)} * 4, 8) + CASE WHEN category = {_quoted(PACK.tech_category)} THEN least({s_hits('tf', PACK.tech_words)} * 5 + {s_hits('df', PACK.tech_words)} * 2, 12) ELSE 0 END + {_adjustment_sql()}"""


@query(f"WITH {ARTICLES}, {_SCORES}, x AS (SELECT *, {s_joined('title', 'description')} AS cx FROM cs), y AS (SELECT *, {_CASCADE} AS category FROM x) SELECT id, category, CAST({_RELEVANCE} AS INTEGER) AS relevance FROM y")
def relevance_score(spark, d):
    t, x = F.col("title"), F.col("description")
    rows = category_cascade(spark, d).join(articles(spark, d), "id")
    keyword = F.least(text.hits(text.match_form(t), PACK.categories["english"]), F.lit(3)) * 7
    score = rules.relevance(PACK, t, x, F.col("source"), F.col("published_at"), F.col("feed_priority"), F.col("source_weight"), keyword, F.col("category"), F.lit("2024-01-01").cast("timestamp"), F.lit(NOW).cast("timestamp"))
    return rows.select("id", "category", score.cast("int").alias("relevance"))


@query()
def article_evaluation(spark, d):
    rows = rules.evaluated(articles(spark, d), PACK, F.lit("2024-01-01").cast("timestamp"), F.lit(NOW).cast("timestamp"))
    rows = rules.rescored(rows, PACK)
    return rows.select("id", "category", "score", "connection_type", "exclude_reason", F.array_join("matched_signals", ",").alias("signals"))


@query(f"WITH {ARTICLES} SELECT id, source FROM a WHERE {_ALLOWED}")
def allowlist_bidirectional(spark, d):
    names = spark.createDataFrame([(s,) for s in PACK.sources], "name string")
    return joins.either_contains(articles(spark, d), names, F.lower("source"), F.col("name")).select("id", "source")


_INFO = s_clean(s_joined("title", "description"))


@query(
    rf"WITH {ARTICLES}, i AS (SELECT id, {_INFO} AS x, title FROM a) SELECT id, nullif(trim(regexp_extract(x, '(?i){PACK.amounts[0]}', 1)), '') AS amount, nullif(trim(regexp_extract(x, '(?i){PACK.stages[0]}', 1)), '') AS stage, "
    + s_case([(s_match("x", p), _quoted(n)) for n, p in PACK.event_labels])
    + " AS event, "
    + s_case([(s_match("x", p), _quoted(n)) for n, p in PACK.industries])
    + rf" AS industry, nullif(trim(regexp_extract(title, '{PACK.companies[0]}', 1)), '') AS company FROM i"
)
def structured_facts(spark, d):
    rows = articles(spark, d).withColumn("f", rules.facts(PACK, F.col("title"), F.col("description")))
    company = rules.first_match(F.col("title"), PACK.companies[:1], 1, ignore_case=False)
    return rows.select("id", "f.amount", "f.stage", "f.event", "f.industry", company.alias("company"))


# --- similarity, dedup -----------------------------------------------------------------------------------------------

_PAIR = f"""p AS (SELECT x.id, x.title AS ta, y.title AS tb FROM a x JOIN a y ON y.id = x.id + 1),
q AS (SELECT id, {s_tokens('ta')} AS a1, {s_tokens('tb')} AS b1, {s_print('ta')} AS fa, {s_print('tb')} AS fb FROM p),
r AS (SELECT *, {s_grams('fa')} AS a2, {s_grams('fb')} AS b2 FROM q), z AS (SELECT *, {s_jaccard('a1', 'b1')} AS j, {s_dice('a2', 'b2')} AS dc FROM r)"""


@query(f"WITH {ARTICLES}, {_PAIR} SELECT id, round(j, 6) AS jaccard, round(dc, 6) AS dice, fa <> '' AND fb <> '' AND (fa = fb OR j >= 0.72 OR dc >= 0.88) AS similar, round(CASE WHEN fa <> '' AND fa = fb THEN 1.0 ELSE greatest(j, dc) END, 6) AS closeness FROM z")
def pair_similarity(spark, d):
    rows = articles(spark, d).select("id", similarity.forms(F.col("title")).alias("a"))
    pairs = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    a, b = F.col("a"), F.col("b")
    measures = pairs.select("id", similarity.jaccard(a["tokens"], b["tokens"]).alias("jaccard"), similarity.dice_of_counts(a["grams"], b["grams"]).alias("dice"), similarity.similar_forms(a, b).alias("similar"), similarity.close_forms(a, b).alias("closeness"))
    return measures.select("id", F.round("jaccard", 6).alias("jaccard"), F.round("dice", 6).alias("dice"), "similar", F.round("closeness", 6).alias("closeness"))


_TITLES = f"""t0 AS (SELECT {s_form('title')} AS form, min(id) AS id, min_by(title, id) AS title FROM a GROUP BY 1),
t AS (SELECT id, {s_tokens('title')} AS tk, {s_print('title')} AS fp FROM t0), t2 AS MATERIALIZED (SELECT *, {s_grams('fp')} AS g FROM t WHERE fp <> ''),
pr AS (SELECT x.id AS a, y.id AS b, {s_jaccard('x.tk', 'y.tk')} AS j, CASE WHEN x.fp = y.fp THEN 1.0 ELSE {s_dice('x.g', 'y.g')} END AS dc FROM t2 x JOIN t2 y ON x.id < y.id AND (least(len(x.tk), len(y.tk)) >= 0.72 * greatest(len(x.tk), len(y.tk)) OR least(len(x.g), len(y.g)) >= 0.78 * greatest(len(x.g), len(y.g)))
  AND (x.fp = y.fp OR list_has_any(x.tk, y.tk) OR len(list_intersect(x.g, y.g)) >= 0.7 * least(len(list_distinct(x.g)), len(list_distinct(y.g)))) ),
sp AS MATERIALIZED (SELECT * FROM pr WHERE j >= 0.72 OR dc >= 0.88)"""


def _titles(spark, d):
    return articles(spark, d).groupBy(text.match_form(F.col("title")).alias("form")).agg(F.min_by("title", "id").alias("title"), F.min("id").alias("id"))


@query(f"WITH {ARTICLES}, {_TITLES} SELECT a, b, round(j, 6) AS jaccard, round(dc, 6) AS dice FROM sp")
def similar_title_pairs(spark, d):
    return joins.similar_title_pairs(_titles(spark, d)).select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("dice", 6).alias("dice"))


@query(
    f"WITH {ARTICLES}, f AS (SELECT *, {s_print('title')} AS fp FROM a) SELECT id, title FROM f WHERE fp <> '' QUALIFY row_number() OVER (PARTITION BY fp ORDER BY CASE feed_priority WHEN 'primary' THEN 2 WHEN 'secondary' THEN 1 ELSE 0 END DESC, published_at DESC, id) = 1"
)
def exact_dedup_keep_best(spark, d):
    rank = F.when(F.col("feed_priority") == "primary", 2).when(F.col("feed_priority") == "secondary", 1).otherwise(0)
    return dedup.best_per_key(articles(spark, d), text.fingerprint(F.col("title")), [rank.desc(), F.desc("published_at"), F.asc("id")]).select("id", "title")


@query(
    f"""WITH RECURSIVE {ARTICLES}, {_TITLES},
g0 AS MATERIALIZED (SELECT a.id, a.url, t0.id AS g FROM a JOIN t0 ON t0.form = {s_form('a.title')}),
e AS (SELECT a, b FROM sp UNION ALL SELECT b, a FROM sp UNION ALL SELECT id, id FROM t2),
nb AS (SELECT x.id, list(DISTINCT y.id) AS lo FROM g0 x JOIN e ON e.a = x.g JOIN g0 y ON y.g = e.b AND y.id < x.id GROUP BY x.id),
un AS (SELECT x.id, list(DISTINCT y.id) AS lo FROM g0 x JOIN g0 y ON y.url = x.url AND y.id < x.id GROUP BY x.id),
o AS MATERIALIZED (SELECT g0.id, row_number() OVER (ORDER BY g0.id) AS n, list_concat(coalesce(nb.lo, []), coalesce(un.lo, [])) AS lo FROM g0 LEFT JOIN nb USING (id) LEFT JOIN un USING (id)),
st AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT st.n + 1, CASE WHEN list_has_any(o.lo, st.kept) THEN st.kept ELSE list_append(st.kept, o.id) END FROM st JOIN o ON o.n = st.n + 1)
SELECT unnest(kept) AS id FROM (SELECT kept FROM st ORDER BY n DESC LIMIT 1)"""
)
def greedy_fuzzy_dedup(spark, d):
    return dedup.articles(articles(spark, d).select("id", "title", "url"), [F.asc("id")]).select("id")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, CAST(coalesce(n, 0) AS BIGINT) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def left_lookup_default(spark, d):
    counts = aggregates.counts_of(table(spark, d, "orders"), "o_custkey").withColumnsRenamed({"o_custkey": "c_custkey", "n": "n_orders"})
    return joins.default_lookup(table(spark, d, "customer").select("c_custkey", "c_name"), counts, ["c_custkey"], {"n_orders": 0})


@query("SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1) s ON s_nationkey = n_nationkey")
def first_match_lookup(spark, d):
    dim = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_acctbal")
    return joins.first_lookup(table(spark, d, "nation"), dim, ["n_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")]).select("n_nationkey", "n_name", "s_suppkey")


@query("SELECT c_custkey, 'not_selected' AS exclude_reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_selected(spark, d):
    chosen = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.rejected(table(spark, d, "customer").select("c_custkey"), chosen, ["c_custkey"], "not_selected")


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) AS selected FROM part")
def semi_flag(spark, d):
    chosen = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return joins.flagged(table(spark, d, "part").select("p_partkey"), chosen, ["p_partkey"], "selected")


_RULES = [("/", "disallow"), ("/en", "allow"), ("/en/7", "disallow"), ("/fr/1", "allow"), ("/de/5", "disallow")]


@query(
    f"WITH u AS (SELECT page_id AS id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages), r AS (SELECT * FROM (VALUES {', '.join(f'({_quoted(p)}, {_quoted(k)})' for p, k in _RULES)}) v(prefix, kind)), "
    "m AS (SELECT id, max_by(kind, length(prefix)) AS kind FROM u JOIN r ON starts_with(path, prefix) GROUP BY id) SELECT id, coalesce(kind = 'allow', true) AS allowed FROM u LEFT JOIN m USING (id)"
)
def longest_prefix(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), urls.origin(F.col("url")).alias("origin"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1).alias("path"))
    fixed = spark.createDataFrame(_RULES, "prefix string, kind string")
    return joins.longest_prefix(rows, rows.select("origin").distinct().crossJoin(F.broadcast(fixed))).select("id", "allowed")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def upsert_best(spark, d):
    return joins.upserted(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice")


_SUFFIX = " OR ".join(f"lower({s_part(3)}) = '{h}' OR ends_with(lower({s_part(3)}), '.{h}')" for h in PACK.overseas_hosts)


@query(f"SELECT page_id, {_SUFFIX} AS overseas FROM pages")
def host_suffix(spark, d):
    rows = table(spark, d, "pages")
    return rows.select("page_id", rules.is_overseas(PACK, F.lit(""), F.lit("none"), urls.host(F.col("url"))).alias("overseas"))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(count(e.event_id) AS BIGINT) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('logout'), ('none')) v(event_type) LEFT JOIN events e USING (event_type) GROUP BY event_type")
def counts_zero_filled(spark, d):
    return aggregates.counts_over_domain(table(spark, d, "events"), "event_type", ["click", "view", "purchase", "signup", "logout", "none"])


@query("SELECT source, count_if(quality = 1) AS n_ok, count_if(quality <> 1) AS n_failed, round(100.0 * count_if(quality = 1) / count(*), 1) AS percent FROM labels JOIN documents USING (doc_id) GROUP BY source")
def source_success_rate(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return aggregates.success_rates(rows, "source", F.col("quality") == 1)


@query(f"WITH {ARTICLES}, r AS (SELECT source, {s_hard('title', 'description', 'body', chr(39) * 2)} AS reason FROM a) SELECT reason, source, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ROLLUP (reason, source)")
def exclusion_rollup(spark, d):
    rows = articles(spark, d).withColumn("reason", rules.hard_exclusion(PACK, F.col("title"), F.col("description"), F.col("body"), F.lit("")))
    return aggregates.failure_rollup(rows, "reason", "source")


@query(
    "WITH c AS (SELECT count_if(n_chars > 1000) AS long, count_if(n_chars <= 1000) AS short, count_if(lang = 'en') AS english, count_if(lang = 'xx') AS none, count_if(source = 'src1') AS first FROM documents) "
    "SELECT stage, n FROM (UNPIVOT c ON long, short, english, none, first INTO NAME stage VALUE n) WHERE n > 0 ORDER BY n DESC, stage LIMIT 4"
)
def stage_funnel(spark, d):
    stages = {"long": F.col("n_chars") > 1000, "short": F.col("n_chars") <= 1000, "english": F.col("lang") == "en", "none": F.col("lang") == "xx", "first": F.col("source") == "src1"}
    return aggregates.funnel(stages, table(spark, d, "documents"))


@query("SELECT CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS latest, count(DISTINCT CAST(ts AS DATE)) AS n_dates FROM events")
def archive_bounds(spark, d):
    return aggregates.date_bounds(table(spark, d, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd")), "date")


@query("SELECT count(*) AS total, count_if(lang = 'en') AS domestic, count_if(lang <> 'en') AS overseas, count_if(source = 'src1') AS highlighted, count(DISTINCT source) AS n_categories FROM documents")
def statistics_card(spark, d):
    return aggregates.statistics(table(spark, d, "documents"), F.col("lang") != "en", "source", "src1")


# --- order and selection ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def per_category_limit(spark, d):
    return selection.per_group(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


def _ranked(spark, d):
    return articles(spark, d).select("id", (F.length("body") % 40).cast("int").alias("score"), "source", "feed_priority", "published_at", "is_domestic", F.concat(F.lit("c"), (F.col("id") % 6).cast("string")).alias("category"), F.when(F.col("id") % 4 == 0, "A").alias("connection_type"), (F.col("id") % 7 == 0).alias("protected"))


_RANKED = f"WITH {ARTICLES}, k AS (SELECT id, CAST(length(body) % 40 AS INTEGER) AS score, feed_priority, published_at, source, is_domestic, 'c' || (id % 6) AS category, CASE WHEN id % 4 = 0 THEN 'A' END AS kind, id % 7 = 0 AS protected FROM a)"
_ORDER = "protected DESC, kind IS NOT NULL DESC, score DESC, feed_priority = 'primary' DESC, published_at DESC, id"


@query(f"{_RANKED}, w AS (SELECT *, row_number() OVER (PARTITION BY category, protected ORDER BY {_ORDER}) AS n FROM k) SELECT id, category, score, protected FROM w WHERE n <= CASE WHEN protected THEN 14 ELSE 10 END ORDER BY {_ORDER} LIMIT 30")
def protected_quota(spark, d):
    return selection.preselected(_ranked(spark, d)).select("id", "category", "score", "protected")


_SELECT = f"""{_RANKED.replace('WITH', 'WITH RECURSIVE', 1)},
c AS (SELECT id, score, category, source, is_domestic, id % 5 <> 0 AS allowed, CASE WHEN source IS NULL OR trim(source) = '' THEN 'i' || id ELSE 's' || lower(trim(source)) END AS own,
  strftime(published_at + INTERVAL 9 HOURS, '%Y-%m-%d') AS published FROM k WHERE kind IS NOT NULL),
v AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY pass, is_domestic DESC, score DESC, published DESC, id) AS n
  FROM c, (VALUES (1), (2), (3), (4)) p(pass)
  WHERE (pass > 2 OR allowed) AND (pass % 2 = 0 OR is_domestic) AND score >= CASE WHEN pass <= 2 THEN CASE WHEN is_domestic THEN 12 ELSE 16 END ELSE CASE WHEN is_domestic THEN 7 ELSE 12 END END),
st AS (
  SELECT CAST(0 AS BIGINT) AS n, list_filter([{{'id': CAST(0 AS BIGINT), 'category': '', 'own': '', 'd': true}}], lambda x: false) AS s
  UNION ALL
  SELECT v.n, CASE WHEN len(s) < CASE WHEN pass = 4 THEN 10 ELSE 15 END AND (pass % 2 = 0 OR len(list_filter(s, lambda x: x.d)) < 8) AND len(list_filter(s, lambda x: x.id = v.id)) = 0
    AND len(list_filter(s, lambda x: x.category = v.category)) < 5 AND (v.is_domestic OR len(list_filter(s, lambda x: NOT x.d)) < 3) AND len(list_filter(s, lambda x: x.own = v.own)) < 2
    THEN list_append(s, {{'id': v.id, 'category': v.category, 'own': v.own, 'd': v.is_domestic}}) ELSE s END
  FROM st JOIN v ON v.n = st.n + 1)
SELECT id, score, category, source, is_domestic FROM c WHERE id IN (SELECT unnest(list_transform(s, lambda x: x.id)) FROM (SELECT s FROM st ORDER BY n DESC LIMIT 1))"""


@query(_SELECT)
def constrained_selection(spark, d):
    rows = _ranked(spark, d).withColumns({"published": times.local_date(F.col("published_at")), "source_allowed": F.col("id") % 5 != 0})
    return selection.constrained(rows).select("id", "score", "category", "source", "is_domestic")


@query(
    f"""{_RANKED}, x AS (SELECT id, score AS importance, category, 'e' || (id % 50) AS event_key FROM k),
p1 AS (SELECT id, category, event_key, importance FROM x ORDER BY importance + 7 DESC, id LIMIT 1),
p2 AS (SELECT x.id, x.category, x.event_key, x.importance FROM x, p1 WHERE x.event_key <> p1.event_key ORDER BY x.importance + CASE WHEN x.category = p1.category THEN 0 ELSE 7 END DESC, x.id LIMIT 1),
p3 AS (SELECT x.id, x.category, x.event_key, x.importance FROM x, p1, p2 WHERE x.event_key NOT IN (p1.event_key, p2.event_key) ORDER BY x.importance + CASE WHEN x.category IN (p1.category, p2.category) THEN 0 ELSE 7 END DESC, x.id LIMIT 1)
SELECT 1 AS place, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3"""
)
def diversified_top3(spark, d):
    rows = _ranked(spark, d).select("id", F.col("score").alias("importance"), "category", F.concat(F.lit("e"), (F.col("id") % 50).cast("string")).alias("event_key"))
    return selection.diversified(rows).select("place", "id", "category", "event_key", "importance")


@query(f"WITH {ARTICLES}, f AS (SELECT id, title, source, is_domestic, published_at FROM a WHERE contains(lower(title || ' ' || source), 'src1') AND is_domestic) SELECT id, title, source FROM f ORDER BY published_at DESC, id LIMIT 20")
def facet_search(spark, d):
    items = articles(spark, d).withColumns({"summary": F.lit(""), "company": F.lit(""), "category": F.lit("c"), "published": F.col("published_at"), "score": F.lit(0)})
    return serving.listed(items, category="c", region="domestic", search="SRC1", sort="latest").select("id", "title", "source").limit(20)


# --- summaries and quality -------------------------------------------------------------------------------------------


_FUND = rf"""f0 AS (SELECT id, {s_clean('title')} AS t FROM a),
f1 AS (SELECT id, t, nullif(regexp_extract(t, {_quoted(PACK.concept('funding_verb'))}, 1), '') AS company, nullif(regexp_extract(t, {_quoted('(?i)' + PACK.concept('funding_amount'))}, 0), '') AS amount FROM f0),
f2 AS (SELECT *, nullif(trim(regexp_replace(regexp_extract(regexp_replace(substring(t, strpos(t, amount) + length(amount)), '^[\s,;:–—-]+', ''), '(?i)^to\s+(.+)$', 1), '[.;|]+$', '')), '') AS purpose FROM f1),
f3 AS (SELECT id, company || ' raised ' || amount AS base, purpose FROM f2)"""


@query(f"WITH {ARTICLES}, {_FUND} SELECT id, CASE WHEN length(base) > 99 THEN NULL WHEN length(base || coalesce(' to ' || purpose, '') || '.') <= 100 THEN base || coalesce(' to ' || purpose, '') || '.' ELSE base || '.' END AS sentence FROM f3")
def overseas_summary(spark, d):
    return articles(spark, d).select("id", summaries.overseas_sentence(PACK, F.col("title")).alias("sentence"))


_SUMMARY = f"""s0 AS (SELECT id, title, split_part(body, chr(10), 2) AS summary FROM a),
s1 AS (SELECT *, {s_tokens('title')} AS a1, {s_tokens('summary')} AS b1, {s_print('title')} AS fa, {s_print('summary')} AS fb FROM s0),
s2 AS (SELECT *, {s_grams('fa')} AS a2, {s_grams('fb')} AS b2 FROM s1), s3 AS (SELECT *, CASE WHEN fa <> '' AND fa = fb THEN 1.0 ELSE greatest({s_jaccard('a1', 'b1')}, {s_dice('a2', 'b2')}) END AS close FROM s2)"""


@query(
    f"WITH {ARTICLES}, {_SUMMARY} SELECT id, "
    + s_case([(f"length({s_clean('summary')}) = 0", "'empty_summary'"), (f"length({s_clean('summary')}) > 100", "'summary_too_long'"), (s_has(s_clean("summary"), "summary_metadata"), "'summary_contains_metadata'"), ("close >= 0.8", "'title_summary_too_similar'")])
    + " AS reason, CAST(len(regexp_extract_all(summary, '\\d[\\d,.]*\\d|\\d')) AS INTEGER) AS numbers FROM s3"
)
def summary_quality_reason(spark, d):
    rows = articles(spark, d).withColumn("summary", F.split_part("body", F.lit("\n"), F.lit(2)))
    return rows.select("id", quality.summary_reason(PACK, F.col("title"), F.col("summary")).alias("reason"), F.regexp_count("summary", F.lit(r"\d[\d,.]*\d|\d")).alias("numbers"))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'body' || doc_id END, CASE WHEN toxic = 1 THEN 'description' || doc_id END) AS summary, CASE WHEN quality = 1 THEN 'local_extractive' WHEN toxic = 1 THEN 'description' ELSE 'unavailable' END AS summary_source FROM labels")
def fallback_ladder(spark, d):
    none = F.lit(None).cast("string")
    step = summaries.ladder(F.when(F.col("quality") == 1, F.concat(F.lit("body"), "doc_id")), F.when(F.col("toxic") == 1, F.concat(F.lit("description"), "doc_id")), none, none)
    return table(spark, d, "labels").withColumn("s", step).select("doc_id", "s.summary", "s.summary_source")


# --- windows, caches, streams ----------------------------------------------------------------------------------------

_WINDOWS = "SELECT w AS window_start, w + INTERVAL 48 HOURS AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY ALL"


@query(_WINDOWS)
def briefing_window_48h(spark, d):
    return windows.briefing_windows(table(spark, d, "events"), by=("event_type",))


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's rows as a stream, whether it is one file or a folder of files."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")  # a pattern may name a file, a plain path may not


def _stream(spark, d) -> DataFrame:
    return streamed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


#: What a watermark of a day has closed once all events have been seen.
_CLOSED = "window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@query(f"SELECT * FROM ({_WINDOWS}) WHERE {_CLOSED}")
def stream_briefing_windows(spark, d):
    return windows.drained(windows.briefing_windows(_stream(spark, d), by=("event_type",), late="1 day"))


@query(f"SELECT window_start, event_type, n, total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) WHERE {_CLOSED}")
def stream_hourly(spark, d):
    return windows.drained(windows.tumbling(_stream(spark, d), "ts", "1 hour", ("event_type",), "value", late="1 day")).withColumn("total", F.round("total", 4))


@query("SELECT DISTINCT user_id % 40 AS page FROM events")
def stream_distinct_urls(spark, d):
    """A month's window, so that each page counts once over all events."""
    rows = _stream(spark, d).select("ts", (F.col("user_id") % 40).alias("page"))
    return windows.drained(windows.distinct_urls(rows, "page", "ts", "60 days")).select("page")


@query("SELECT CAST(user_id AS VARCHAR) AS key, max(ts) AS created_at FROM events GROUP BY user_id")
def stream_keyed_cache(spark, d):
    rows = _stream(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("summary"), F.col("ts").alias("created_at"))
    return windows.upserted(windows.newest_per_key(rows), ["key"], "created_at").select("key", "created_at")


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM s GROUP BY user_id, s"
)
def user_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")


@query(
    "SELECT event_id, date_trunc('day', ts) AS range_to, date_trunc('day', ts) - INTERVAL 48 HOURS AS range_from, strftime(ts + INTERVAL 9 HOURS, '%Y-%m-%d') AS local_date, "
    "greatest(0, least(4, CAST(floor(4 * (1 - (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 2592000000000.0) + 0.5) AS INTEGER))) AS freshness, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) BETWEEN 0 AND 36 * 3600000000 AS healthy FROM events"
)
def event_times(spark, d):
    ts, now = F.col("ts"), F.lit(NOW).cast("timestamp")
    to = times.anchored(ts)
    return table(spark, d, "events").select("event_id", to.alias("range_to"), (to - F.expr("INTERVAL 48 HOURS")).alias("range_from"), times.local_date(ts).alias("local_date"), times.freshness(ts, F.lit("2024-01-01").cast("timestamp"), now).alias("freshness"), times.healthy(F.lit(True), ts, now).alias("healthy"))


@query("WITH v AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS summary, ts AS created_at FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS) SELECT * FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, summary) = 1) ORDER BY created_at DESC, key LIMIT 100")
def cache_ttl_cap(spark, d):
    from siftwell.sources.feeds import cache_entries

    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("summary"), F.col("ts").alias("created_at"))
    return cache_entries(rows, F.lit(NOW).cast("timestamp"), days=10, most=100)


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def latest_nonempty(spark, d):
    from siftwell.sources import sinks

    return sinks.latest_nonempty(table(spark, d, "events").withColumn("briefing_date", F.to_date("ts"))).select("event_id", "event_type")


# --- whole chains ----------------------------------------------------------------------------------------------------

_BRIEF = f"""f AS (SELECT *, {s_print('title')} AS fp FROM tf), u AS (SELECT * FROM f WHERE fp <> '' QUALIFY row_number() OVER (PARTITION BY fp ORDER BY published_at DESC, id) = 1),
s AS (SELECT id, title, source, published_at, CAST({s_score('english')} + {s_score('licence')} AS INTEGER) AS score FROM u),
q AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, published_at DESC, id) <= 2)"""


@query(f"WITH {ARTICLES}, tf AS (SELECT *, {s_form('title')} AS tf, {s_form('description')} AS df FROM a), {_BRIEF} SELECT id, title, source, score FROM q ORDER BY score DESC, published_at DESC, id LIMIT 15")
def daily_briefing(spark, d):
    rows = dedup.best_per_key(articles(spark, d), text.fingerprint(F.col("title")), [F.desc("published_at"), F.asc("id")])
    none = F.array().cast("array<string>")
    score = sum((rules.category_score(PACK, c, F.col("title"), F.col("description"), none) for c in ("english", "licence")), F.lit(0))
    order = [F.desc("score"), F.desc("published_at"), F.asc("id")]
    rows = selection.per_group(rows.withColumn("score", score.cast("int")), ["source"], order, 2)
    return rows.orderBy(*order).limit(15).select("id", "title", "source", "score")


@query()
def curated_briefing(spark, d):
    """The whole batch run: every row's reason, and what was selected."""
    rows = articles(spark, d)
    run = curation.briefing(rows.drop("body"), rows.select("id", "body"), PACK, F.lit("2024-01-01").cast("timestamp"), F.lit(NOW).cast("timestamp"))
    return run.audit.select("id", "title", "category", "score", "connection_type", "exclude_reason", "final_selected")


