"""Functions, rules, joins, dedup, selection, sources and streams on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwell.functions import html, similarity, text, times, urls
from siftwell.operators import dedup, joins, quality, rules, selection, summaries
from siftwell.packs.startup_news import PACK
from siftwell.sources import feeds, sinks


def one(spark, *columns, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    row = df.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_text(spark):
    assert one(spark, text.clean(F.col("t")), t=" <b>a</b>&amp;&lt;b&gt;  x​ ") == "a &<b> x"
    assert one(spark, text.clean(F.col("t"), text.decode_references), t="&#65;&#x42;&bogus;") == "AB&bogus;"
    assert one(spark, text.fingerprint(F.col("t")), t="[단독] A사, (종합) 투자 유치!") == "a사투자유치"
    assert one(spark, text.match_form(F.col("t"), True), t="ＡＢｃ") == "abc"
    assert one(spark, text.contains_keyword(F.col("t"), "VC"), text.contains_keyword(F.col("t"), "투자"), t="the vc는 투자유치") == (False, True)
    assert one(spark, text.matches(F.col("t"), r"\bAC\b"), t="AC는 좋다")
    assert one(spark, text.sentences(F.col("t")), text.sentences_with_decimals(F.col("t")), t="It is 8.5 now. Next!\nLast") == (["It is 8.", "5 now.", "Next!", "Last"], ["It is 8.5 now.", "Next!", "Last"])
    assert one(spark, text.subject_particle(F.col("a")), text.object_particle(F.col("b")), a="기업", b="회사") == ("이", "를")
    assert one(spark, text.top_comma(F.col("t")), t="“a, b” 1,000, c") == 12


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.canonical(u), u="HTTP://Ex.COM:80?utm_source=a&b=1&GCLID=2#x") == "http://ex.com/?b=1"
    assert one(spark, urls.canonical(u), urls.is_safe(u), u="ftp://x/y") == (None, False)
    assert not one(spark, urls.is_safe(u), u="http://192.168.1.2/a")
    assert one(spark, urls.unwrapped(u), u="https://g.com/url?q=https%3A%2F%2Fx.org%2Fa&b=1") == "https://x.org/a"
    assert one(spark, urls.collected(u, F.lit("http://h.example/a/b")), u="../c?x=1&amp;amp;y=2#f") == "http://h.example/c?x=1&y=2"
    once = one(spark, urls.canonical(u), u="https://a.b/c d?x=1")
    assert once == one(spark, urls.canonical(u), u=once)


def test_times(spark):
    for now, to in (((2026, 1, 2, 8, 59, 59), (2026, 1, 1)), ((2026, 1, 2, 9, 0, 0), (2026, 1, 2)), ((2026, 1, 1, 9, 15, 0), (2026, 1, 1))):
        start, end = times.collection_range(dt.datetime(*now, tzinfo=dt.timezone(dt.timedelta(hours=9))))
        assert end == dt.datetime(*to, tzinfo=dt.UTC) and end - start == dt.timedelta(hours=48)
    with pytest.raises(ValueError):
        times.collection_range(dt.datetime(2026, 1, 1))
    p = lambda t: one(spark, times.parsed(F.col("t")), t=t)
    assert p("Tue, 06 Jan 2026 10:00:00 GMT") == p("2026-01-06T19:00:00+09:00") == dt.datetime(2026, 1, 6, 10) and p("soon") is None
    assert one(spark, times.retry_seconds(F.col("t")), t="1h2m3.5s") == 3723.5 and one(spark, times.retry_seconds(F.col("t")), t="250ms") == 0.25


def test_html(spark):
    page = '<nav>menu</nav><article><p>This is the first long paragraph.</p><p>This is the first long  paragraph.</p><p>copyright notice of this page</p><p>short</p><div class="x body">Second block of real text</div></article>'
    assert one(spark, html.article_text(html.body_region(F.col("h")), PACK), h=page) == "This is the first long paragraph. Second block of real text"
    assert html.selector("div .a b#c") == ("id", "c") and html.selector("a[href]") is None
    assert one(spark, html.selected(F.col("h"), [".body"]), h=page) == '<div class="x body">Second block of real text</div>'
    assert one(spark, html.extraction(F.col("h"), PACK)["failure"], h=page) == "body_too_short"
    assert one(spark, html.meta(F.col("h"), "og:title"), h="<meta content='A &amp; B' property='og:title'>") == "A & B"
    found = html.links(spark.createDataFrame([(1, "http://h.example/", "<a href='/a'>Long enough</a><a href='/a'>Long enough</a><a href='b'>tiny</a>")], "page_id long, url string, html string"), "page_id").collect()
    assert [(r["url"], r["title"]) for r in found] == [("http://h.example/a", "Long enough")]


def test_similarity(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, similarity.multiset_dice(text.bigrams(a), text.bigrams(b)), a="aaaa", b="aa") == 0.5
    assert one(spark, similarity.similar_titles(a, b), a="[A] 같은 제목", b="같은 제목 (B)") and not one(spark, similarity.similar_titles(a, b), a="", b="")
    assert one(spark, similarity.search_similarity(a, b), a="abcd", b="abcdefgh") == 0.5


def article(**given):
    row = {"id": 1, "title": "", "description": "", "source": "플래텀", "is_domestic": True, "category_hints": [], "published_at": dt.datetime(2026, 1, 2), "feed_priority": "primary", "source_weight": 6, "url": "https://x.example/1"}
    return row | given


SCHEMA = "id long, title string, description string, source string, is_domestic boolean, category_hints array<string>, published_at timestamp, feed_priority string, source_weight int, url string"


def judged(spark, rows):
    df = spark.createDataFrame([tuple(article(**r)[c.split()[0]] for c in SCHEMA.replace("array<string>", "x").split(", ")) for r in rows], SCHEMA)
    out = rules.evaluated(df, PACK, F.lit("2025-12-31").cast("timestamp"), F.lit("2026-01-02").cast("timestamp"))
    return {r["id"]: r for r in out.collect()}


def test_rules(spark):
    got = judged(
        spark,
        [
            {"id": 1, "title": "AI 스타트업 가나다, 30억원 시리즈A 투자 유치"},
            {"id": 2, "title": "코스닥 상장사 급등주 마감"},
            {"id": 3, "title": "오늘의 날씨와 산책"},
            {"id": 4, "title": "중기부, 창업기업 글로벌 진출 지원 참여기업 모집"},
            {"id": 5, "title": "삼성 유상증자 결정, 스타트업 투자"},
        ],
    )
    assert got[1]["connection_type"] == "C" and got[1]["category"] == "VC / AC" and got[1]["exclude_reason"] is None and got[1]["score"] > 30
    assert got[2]["exclude_reason"] == "hard_exclude_stock_market" and got[3]["exclude_reason"] == "broad_signal_missing"
    assert got[4]["connection_type"] in ("B", "E") and got[4]["category"] == "스타트업 / 벤처기업 / 초기창업"
    assert got[5]["exclude_reason"] == "hard_exclude_public_company_rights_issue"
    found = one(spark, rules.facts(PACK, F.col("t"), F.lit("")), t="AI 스타트업 ‘가나다’, 30억 원 시리즈 A 투자 유치")
    assert (found["company"], found["amount"], found["stage"], found["event"], found["industry"]) == ("가나다", "30억 원", "시리즈 A", "투자유치", "AI")


def chain(spark, rows):
    df = spark.createDataFrame(rows, "id long, url string, title string")
    return sorted(r["id"] for r in dedup.articles(df, [F.asc("id")]).collect())


def test_greedy_dedup_is_ordered(spark):
    a, b, c = "one two three four five six seven eight", "two three four five six seven eight nine", "three four five six seven eight nine ten"
    rows = [(1, "http://x/1", a), (2, "http://x/2", b), (3, "http://x/3", c), (4, None, a), (5, "http://x/3#f", "quite another title here"), (6, "http://x/6", "!!"), (7, "http://x/7", "!!"), (8, "http://x/2", "fresh words only")]
    pairs = {(r["a"], r["b"]) for r in joins.similar_title_pairs(spark.createDataFrame([(1, a), (2, b), (3, c)], "id long, title string")).collect()}
    assert pairs == {(1, 2), (2, 3)}
    assert chain(spark, rows) == [1, 3, 6, 7, 8]


def test_longest_prefix_and_robots(spark):
    robots = spark.createDataFrame([("http://x.example", "User-agent: *\nDisallow: /a # no\nDisallow:\nAllow: /a/b\n\nUser-agent: other\nDisallow: /")], "origin string, text string")
    rows = spark.createDataFrame([(1, "http://x.example/a/c"), (2, "http://x.example/a/b/d"), (3, "http://y.example/a"), (4, "http://x.example")], "id long, url string")
    assert {r["id"]: r["allowed"] for r in feeds.robots_allowed(rows, robots, "bot").collect()} == {1: False, 2: True, 3: True, 4: True}


def brute_selection(rows, lim):
    """Domestic rows first; rows without a connection out; no source is a source of its own."""
    chosen = []
    own = lambda r: ("s", r[3].strip().lower()) if r[3] and r[3].strip() else ("i", r[0])
    ordered = sorted((r for r in rows if r[7]), key=lambda r: (not r[4], -r[1], [-ord(x) for x in r[6]], r[0]))
    for strict, domestic_only, target in ((True, True, lim.min_domestic), (True, False, lim.max_final), (False, True, lim.min_domestic), (False, False, lim.min_final)):
        for r in ordered:
            low = (lim.strict_domestic if r[4] else lim.strict_overseas) if strict else (lim.relaxed_domestic if r[4] else lim.relaxed_overseas)
            now = sum(x[4] for x in chosen) if domestic_only else len(chosen)
            if now >= target or r in chosen or r[1] < low or (strict and not r[5]) or (domestic_only and not r[4]) or len(chosen) >= lim.max_final:
                continue
            if sum(x[2] == r[2] for x in chosen) >= lim.per_category or sum(own(x) == own(r) for x in chosen) >= lim.per_source or (not r[4] and sum(not x[4] for x in chosen) >= lim.max_overseas):
                continue
            chosen.append(r)
    return {r[0] for r in chosen}


SELECTION = "id long, score int, category string, source string, is_domestic boolean, source_allowed boolean, published string, connection_type string"


def test_constrained_selection(spark):
    import random

    rng = random.Random(1)
    for n in (8, 40, 200):
        rows = [(k, rng.randint(0, 30), f"c{rng.randint(0, 4)}", rng.choice(["", None, "S1", "s1 "]) if k % 9 == 0 else f"s{rng.randint(0, 12)}", rng.random() < 0.6, rng.random() < 0.7, f"2026-01-0{rng.randint(1, 3)}", None if k % 7 == 0 else "A") for k in range(n)]
        assert {r["id"] for r in selection.constrained(spark.createDataFrame(rows, SELECTION)).collect()} == brute_selection(rows, selection.Limits())


def test_domestic_rows_come_first(spark):
    rows = [(k, 30 - k, f"c{k % 4}", f"s{k}", True, True, "2026-01-01", "A") for k in range(16)]
    rows += [(20 + k, 40 - k, "c9", f"o{k}", False, True, "2026-01-01", "B") for k in range(3)]
    assert {r["id"] for r in selection.constrained(spark.createDataFrame(rows, SELECTION)).collect()} == set(range(15))
    unnamed = spark.createDataFrame([(k, 20, f"c{k % 3}", None, True, True, "2026-01-01", "A") for k in range(10)], SELECTION)
    assert selection.constrained(unnamed).count() == 10 and selection.constrained(unnamed.limit(0)).count() == 0


def test_overseas_sentences(spark):
    told = {
        "Acme raises €5 million to build farm robots": "Acme raised €5 million to build farm robots.",
        "Funding > Acme secured $3.5m in Series B | EU-Startups": "Acme raised $3.5m in a Series B round.",
        "Acme extends seed round to €9 million": "Acme extended its seed round to €9 million in total funding.",
        "Acme raises €5 million to " + "build " * 30: "Acme raised €5 million.",
        "Acme raises money": None, "The market for robots grew by €5 million": None, "Acme raises €5.": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in told], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", summaries.overseas_sentence(PACK, F.col("t")).alias("s")).collect()} == told


def test_quality_and_summaries(spark):
    assert one(spark, quality.summary_reason(PACK, F.col("t"), F.col("s")), t="가나다 투자 유치", s="") == "empty_summary"
    assert one(spark, quality.summary_reason(PACK, F.col("t"), F.col("s")), t="가나다 투자 유치", s="가나다 투자 유치") == "title_summary_too_similar"
    assert one(spark, quality.unsupported_numbers(F.col("s"), F.col("b")), s="30억 원과 7곳", b="30억 원") == ["7"]
    body = "가나다는 30억 원 규모의 시리즈A 투자를 유치했다고 2일 밝혔다. 무단 전재 및 재배포 금지. 회사는 투자금을 활용해 해외 진출을 추진한다. " * 2
    df = spark.createDataFrame([(1, "가나다 시리즈A 투자 유치", "VC / AC", "플래텀", body)], "id long, title string, category string, source string, body string")
    assert summaries.extractive(df, PACK).first()["summary"].startswith("가나다는 30억 원")


def test_feeds(spark):
    rss = "<rss><channel><item><title>A</title><link>http://x/1</link><pubDate>d</pubDate></item><item><title>B</title></item></channel></rss>"
    pages = spark.createDataFrame([("f", rss, 1), ("g", "<broken", 5)], "source string, text string, max_items int")
    assert [(r["feed"], r["title"], r["link"]) for r in feeds.rss(pages).collect()] == [("f", "A", "http://x/1")]
    assert {r["source"]: r["succeeded"] for r in feeds.feed_status(pages).collect()} == {"f": True, "g": False}
    maps = spark.createDataFrame([("s", "<urlset><url><loc>http://x/n/1</loc><lastmod>2026-01-02</lastmod></url><url><loc>http://x/n/2</loc></url></urlset>", ["/n/"], 9)], "source string, text string, allow array<string>, max_items int")
    assert [r["url"] for r in feeds.sitemap(maps).collect()] == ["http://x/n/1"]
    assert feeds.settings(["MAX_FINAL_ARTICLES='7'"], {}).max_final_articles == 7 and feeds.positive("-1", 3) == 3


def test_briefing_sink_keeps_previous_on_empty(spark, tmp_path):
    path = str(tmp_path / "b")
    items = spark.createDataFrame([(1, "t")], "id long, title string")
    assert sinks.write_briefing(items, path, "2026-01-02") == "written" == sinks.write_briefing(items, path, "2026-01-03")
    assert sinks.write_briefing(items.limit(0), path, "2026-01-03") == "empty_result_preserved"
    held = sinks.read_briefings(spark, path)
    assert held.count() == 2 and sinks.index(held).first()["latest"] == "2026-01-03" and sinks.latest_nonempty(held).count() == 1


def test_entry_without_the_corpus_part():
    import __spark_entry__ as entry

    assert "daily_briefing" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
