"""Headlines taken apart, endings, facts, sentences of descriptions and the templates, on stated cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from siftwell.operators import titles
from siftwell.packs.startup_news import PACK


@pytest.mark.parametrize(
    ("title", "description", "want"),
    [
        ("가온테크, 80억 원 유치", "", ("가온테크", "80억 원 유치", "")),
        ("“빛, 물” 가온, 새 앱 공개", "", ("가온", "새 앱 공개", "빛, 물")),
        ("가온 “내년, 흑자”", "", ("가온", "“내년, 흑자”", "")),
        ("가온이 만든 “내년, 흑자", "", ("", "가온이 만든 “내년, 흑자", "")),
        ("혁신의 집… 나래벤처스 모집 공고, 3월 시작", "", ("나래벤처스", "3월 시작", "")),
        ("AI 기업 ‘메디봇’, 상장", "", ("메디봇", "상장", "")),
        ("AI 기업 ‘투자 유치’, 상장", "", ("AI 기업 투자 유치", "상장", "")),
        ("스타트업, 투자 늘어", "한빛은 오늘 말했다.", ("한빛", "투자 늘어", "")),
        ("로보랩 신제품 출시", "", ("로보랩 신제품", "출시", "")),
        ("한빛 소식", "어제 일이다. 한빛은 쉰다.", ("한빛", "소식", "")),
        ("이름이 서른다섯 글자를 넘는 아주 길고 긴 기관의 긴 이름이 여기에 있다면, 끝", "", ("", "끝", "")),
        ("", "", ("", "", "")),
    ],
)
def test_headline_parts(title, description, want):
    assert titles.Headline(PACK)(title, description) == want


def told(spark, *columns, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_endings_reach_a_fixpoint(spark):
    stems = [s for x, _ in PACK.report_stems for s in x.split("|")]
    ends = ["", "했다", "한다", "됐다", "된다", "할 계획이다", "할 예정이다", "할 방침", "에 나선다", "에 성공했다", "했다.", "예정이다", "했다한다", "할 것이다."]
    rows = [(f"새 로봇을 {s}{e}",) for s, e in itertools.product(stems, ends)] + [("“가” 나…다 1,000 억원外",), ("",), (None,), (", 가 , 나,",)]
    once = spark.createDataFrame(rows, "t string").select("t", titles.report_ending(PACK, F.col("t")).alias("once"))
    got = once.withColumn("twice", titles.report_ending(PACK, F.col("once"))).collect()
    assert all(r["once"] == r["twice"] for r in got)
    by = {r["t"]: r["once"] for r in got}
    assert by["새 로봇을 출시했다."] == "새 로봇을 출시" and by["새 로봇을 구축할 계획이다"] == "새 로봇을 구축" and by["새 로봇을 수상할 예정이다"] == "새 로봇을 수상추진"
    assert by["“가” 나…다 1,000 억원外"] == "가 나, 다 1,000억 원外" and by[", 가 , 나,"] == "가, 나" and by[None] == ""


def test_cut_keeps_the_ending(spark):
    long = "가나다라 마바사 " * 12
    cut, plain, short = told(spark, *(titles.report_cut(PACK, F.col(c)) for c in "abc"), a=long + "투자 유치", b=long + "끝", c="짧다.")
    assert len(cut) <= 100 and cut.endswith(" 투자 유치") and len(plain) <= 100 and plain.endswith(" 함") and short == "짧다"


def test_facts_are_added_where_they_lack(spark):
    facts = lambda t, d="": told(spark, titles.headline_facts(PACK, F.col("t"), F.col("d")), t=t, d=d)
    got = facts("가온, Series B 유치", "약 30 억  원을 3개 기업에")
    assert (got["amount"], got["stage"], got["count"]) == ("약 30억 원", "시리즈B", "3개 기업")
    put = lambda clause, names, t, d="": told(spark, titles.with_facts(PACK, F.col("c"), titles.headline_facts(PACK, F.col("t"), F.col("d")), names), c=clause, t=t, d=d)
    assert put("펀드 결성", ("amount", "stage"), "30억 원 시드") == "30억 원 규모 시드 펀드 결성"
    assert put("30억원 펀드 결성", ("amount",), "30억 원") == "30억 원 펀드 결성"
    assert put("기업 선정", ("count",), "12개사") == "기업 12개사 선정" and put("기업 지원", ("count",), "12개사") == "12개사 대상으로 기업 지원" and put("행사", ("count",), "12개사") == "12개사 행사"


def test_sentences_of_descriptions(spark):
    d = "공식 누리집에서 모집을 확인한다. 한빛은 물류 로봇 솔루션을 출시했다. 지원도 확대한다. 어제 한빛이 관제 플랫폼과 서비스를 공개했다 - 뉴스"
    assert told(spark, titles.action_clause(PACK, F.col("d"), F.col("s")), d=d, s="한빛") == "관제 플랫폼과 서비스를 공개"
    assert told(spark, titles.action_clause(PACK, F.col("d"), F.col("s")), d="아무 일도 없다.", s="") == ""
    more = "가온은 80억 원 시리즈A 투자를 유치했다. 회사는 조달한 자금을 해외 고객 확보와 양산 설비 구축에 투입할 계획이다. 임직원은 서른 명이며 본사는 서울에 있다."
    assert told(spark, titles.supporting_clause(PACK, F.col("d"), F.col("t"), F.col("s")), d=more, t="가온, 80억 원 시리즈A 투자 유치", s="가온") == "해외 고객 확보와 양산 설비 구축에 투입"
    assert told(spark, titles.supporting_clause(PACK, F.col("d"), F.col("t"), F.col("s")), d="짧은 말.", t="가온", s="") == ""


def test_templates(spark):
    rows = [
        (1, "벤처블릭, 헬스케어 스타트업 글로벌 진출 지원 3자 MOU 체결", ""), (2, "서울창업허브, 맞손 … 총 12개사 지원사업 모집", ""), (3, None, None), (4, "가온, 리뉴얼", "가온은 새 결제 서비스와 정산 플랫폼을 공개했다."),
        (5, "가온, 투자 참여", "5억 원을 후속 투자로 받았다."), (6, "가온 개발", ""),
    ]
    df = spark.createDataFrame(rows, "id int, title string, description string").withColumn("kind", F.lit("x"))
    local = {r["id"]: (r["kind"], r["summary"]) for r in titles.local_summaries(df, PACK).collect()}
    alone = {r["id"]: (r["kind"], r["summary"]) for r in titles.title_summaries(df, PACK).collect()}
    assert alone[1] == ("partners", "벤처블릭이 헬스케어 스타트업 글로벌 진출 지원 3자 협력 체계를 구축")
    assert local[3] == ("other", PACK.no_summary) and alone[3] == ("plain other", PACK.no_summary)
    assert local[2][0] == "support" and "협력해" in local[2][1] and local[4] == ("technology", "가온이 새 결제 서비스와 정산 플랫폼을 공개")
    assert local[5] == ("investment", "가온이 5억 원 규모 후속 투자 투자 참여") and len(local) == len(alone) == 6
    assert titles.local_summaries(df.limit(0), PACK).count() == 0
