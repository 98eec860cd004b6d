"""The gates in their order, and the batch run with cache and model, on small literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from siftwell.operators import summaries
from siftwell.packs.startup_news import PACK
from siftwell.plans import curation

GOOD = "가온이 물류 로봇의 해외 판로를 넓히려고 8개국 창고에서 실증을 마치고 자금 80억 원을 조달해 양산 설비 구축에 투입"
TITLE = "가온, 신제품 출시 계획 공개와 투자 유치"
GATED = "id long, title string, source string, summary string, summary_source string, title_summary string, score int, url string, category string, description string, body string"


def gated(spark, rows, n):
    full = [(k, r.get("title", TITLE), r.get("source", "매체"), r["summary"], r["by"], r.get("told"), 30, r.get("url", "https://a.example/x"), "VC / AC", "", "") for k, r in enumerate(rows)]
    out = curation.gated(spark.createDataFrame(full, GATED), PACK, [F.asc("id")], n)
    return {r["id"]: (r["exclude_reason"], r["summary_source"], r["score"]) for r in out.collect()}


def test_gates_in_order(spark):
    told, partner = "가온이 신규 투자 자금을 80억 원 확보", "가온, 스타트업 글로벌 진출 지원 MOU 체결"
    rows = [
        {"summary": GOOD, "by": "local_extractive"}, {"summary": "", "by": "unavailable"}, {"summary": GOOD + " 확대" * 30, "by": "local_extractive"}, {"summary": "짧음", "by": "description"},
        {"summary": told, "by": "titleFallback"}, {"summary": told, "by": "titleFallback"}, {"summary": "가온이 스타트업 글로벌 진출 지원 협력 체계를 구축", "by": "titleFallback", "title": partner},
        {"summary": GOOD, "by": "local_extractive", "title": "코스닥 급등주 마감"}, {"summary": GOOD, "by": "local_extractive", "url": "https://news.google.com/articles/x"}, {"summary": GOOD, "by": "openai_description", "title": GOOD},
        {"summary": GOOD, "by": "local_extractive", "source": ""},
    ]
    got = gated(spark, rows, 0)
    reasons = [got[k][0] for k in range(len(rows))]
    assert reasons[:6] == [None, None, "summary_summary_too_long", "summary_noun_phrase_summary", "title_fallback_limit", "title_fallback_limit"]
    assert reasons[6:] == [None, "hard_exclude_stock_market", "google_news_url_forbidden", "summary_openai_description_same_as_title", "missing_source"]
    assert got[0][2] == 30 and got[1][2] == 10 and got[6][2] == 25
    one = gated(spark, rows, 1)
    assert [one[k][0] for k in (4, 5, 6)] == [None, "title_fallback_limit", None]
    # A description too like its title takes the title's sentence while there is room.
    alike = {"summary": "가온, 신제품 출시 계획 공개와 투자 유치 확대와 함께 판로 모집", "by": "description", "title": "가온, 신제품 출시 계획 공개와 투자 유치 확대와 함께 판로 모집함", "told": told}
    both = gated(spark, [alike, alike], 1)
    assert both[0] == (None, "titleFallback", 25) and both[1][0] == "summary_description_too_short" and both[1][1] == "description"
    assert gated(spark, [], 1) == {}


def entry(k, title, source="플래텀", **given):
    row = {"id": k, "title": title, "description": "", "source": source, "url": f"https://a.example/{k}", "published_at": dt.datetime(2026, 1, 2), "feed_priority": "primary", "source_weight": 6, "is_domestic": True, "category_hints": []} | given
    return tuple(row.values())


ENTRIES = "id long, title string, description string, source string, url string, published_at timestamp, feed_priority string, source_weight int, is_domestic boolean, category_hints array<string>"


def test_briefing_with_cache_and_model(spark):
    body = "가온테크는 물류 로봇으로 80억 원 규모 시리즈A 투자를 유치했다고 밝혔다. 투자에는 벤처캐피탈 세 곳이 참여했다. 회사는 투자금을 생산시설 구축과 해외 진출에 활용할 계획이다. " * 4
    titles = {
        1: "AI 스타트업 가온테크, 80억 원 규모 시리즈A 투자 유치", 2: "바이오 벤처 나래팜, 시드 투자 유치", 3: "코스닥 상장사 급등주 마감", 4: "오늘의 날씨와 산책", 5: "AI 스타트업 가온테크, 80억 원 규모 시리즈A 투자 유치!",
        6: "중기부, 창업기업 글로벌 진출 지원 참여기업 모집", 7: "로봇 스타트업 한빛, 12억 원 프리A 투자 유치", 8: "농식품 창업기업 새싹팜, 30억 원 시리즈B 투자 유치",
    }
    sources = {2: "매일경제", 7: "머니투데이", 8: "한국경제"}
    rows = [entry(k, t, sources.get(k, "플래텀")) for k, t in titles.items()] + [entry(9, "딥테크 스타트업 오름, 50억 원 시리즈C 투자 유치", source="어느 블로그"), entry(10, "스타트업 지난해 투자 유치", published_at=dt.datetime(2025, 1, 1)), entry(11, None)]
    bodies = spark.createDataFrame([(1, body), (2, body.replace("가온테크", "나래팜").replace("80억", "7억").replace("시리즈A", "시드")), (7, body.replace("가온테크", "한빛").replace("80억", "12억"))], "id long, body string")
    cached = "가온테크가 물류 로봇의 해외 판로 개척과 생산시설 구축에 쓸 자금 80억 원을 벤처캐피탈에서 유치"
    entries = spark.createDataFrame(rows, ENTRIES)
    key = summaries.summary_key(F.col("url"), F.col("title"), F.col("description"), F.lit("openai_body"))
    cache = entries.where("id = 1").select(key.alias("key"), F.lit(cached).alias("summary"))

    def model(title, text, reason):
        return "나래팜이 바이오 소재의 해외 진출과 생산시설 구축에 쓸 자금 7억 원을 시드 라운드에서 유치" if "나래팜" in title else "999억 원 유치"

    start, end = (F.lit(x).cast("timestamp") for x in ("2025-12-31", "2026-01-03"))
    run = curation.briefing(entries, bodies, PACK, start, end, cache=cache, model=model, titles_at_most=1)
    audit = {r["id"]: (r["exclude_reason"], r["final_selected"]) for r in run.audit.collect()}
    items = {r["id"]: (r["summary"], r["summary_source"]) for r in run.items.collect()}
    assert set(audit) == set(range(1, 10)) and audit[3][0] == "hard_exclude_stock_market" and audit[4][0] == "broad_signal_missing" and audit[5][0] == "duplicate"
    assert items[1] == (cached, "openai_body") and items[2][1] == "openai_body" and "7억" in items[2][0] and items[7][1] == "local_extractive"
    assert all(selected == (k in items) and (reason is None) == selected for k, (reason, selected) in audit.items())
    assert items[8][1] == "titleFallback" and audit[9][0] == "title_fallback_limit" and audit[6][0].startswith("summary_") and set(items) == {1, 2, 7, 8}
