"""Headlines made of the given tables' rows, through the news pack's title analysis, endings and templates.

A customer stands for a company: its key is part of the name, the account's balance gives amounts, and the key decides what
kind of event its headline tells. The SQL states what the sentence has to be, from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import titles
from siftwell.packs.startup_news import PACK
from siftwell.plans.queries import ARTICLES, _quoted, articles, query, s_clean, spread, table

#: Title, description, kind and sentence by the kind of event; {c}: the company, {p}: its particle, {n}, {m}: numbers.
TOLD = [
    ("{c}, {n}억원 규모 벤처펀드 결성", "", "fund", "{c}{p} {n}억 원 규모 벤처펀드 결성"),
    ("{c}, 지역 투자 조합 출범", "신규 펀드 결성.", "fund", "{c}{p} 신규 펀드 결성"),
    ("[단독] {c}, 팁스 선정", "총 {m}개사 참여.", "program", "{c}{p} 팁스 총 {m}개사 선정"),
    ("{c}, 세컨더리 거래 {n}억 원 확보", "회사는 확보한 자금을 해외 고객 확보와 연구개발에 투입할 계획이다. 문의는 공식 누리집에서 확인하고 제출 서류를 갖춘다.", "secondary", "{c}{p} 세컨더리 거래 {n}억 원 확보해 확보한 자금을 해외 고객 확보와 연구개발에 투입"),
    ("{c}, 참가사 모집", "행사는 다음 달이다. {c}은 초기 창업기업의 해외 진출을 돕는 사업화 지원 프로그램 참가사를 모집한다. 참가사 모집 끝.", "support", "{c}{p} 초기 창업기업의 해외 진출을 돕는 사업화 지원 프로그램 참가사를 모집"),
    ("{c}, ‘올해의 제품’ 대상", "", "award", "{c}{p} 올해의 제품 대상 수상"),
    ("“{m}개 도시 진출” {c}, 안전 대상", "", "award", "{c}{p} {m}개 도시 진출로 안전 대상 수상"),
    ("{c}, 시리즈A 투자 유치", "{n}억 원을 투자받았다.", "investment", "{c}{p} {n}억 원 규모 시리즈A 투자 유치"),
    ("{c}, 새 앱 공개", "{c}은 물류 현장의 재고를 세는 로봇 솔루션과 관제 플랫폼을 출시했다.", "technology", "{c}{p} 물류 현장의 재고를 세는 로봇 솔루션과 관제 플랫폼을 출시"),
    ("{c}, 사옥 이전", "", "other", "{c}{p} 사옥 이전"),
    ("{c} “다음 분기 흑자 전망”", "", "other", "{c}{p} 다음 분기 흑자 전망"),
    ("{c} 로봇 부품 개발했다", "", "other", "{c} 로봇 부품이 개발"),
    ("", "", "other", PACK.no_summary),
]
#: The same for titles alone.
TITLED = [
    ("{c}, {n}억 원 시리즈B 투자 유치", "investment", "{c}{p} 시리즈B 단계에서 {n}억 원의 신규 투자 자금을 확보"),
    ("{c}, {n}억원 규모 성장펀드 결성", "fund", "{c}{p} {n}억 원 규모의 성장펀드를 새로 조성"),
    ("{c}센터, 입주기업 {m}개사 선정", "selecting", "{c}센터가 입주기업 {m}개사 명단을 최종 확정"),
    ("{c}, 아기유니콘 선정", "selected", "{c}{p} 아기유니콘 대상 명단에 포함"),
    ("{c}, 실증 참여 기업 모집", "recruiting", "{c}{p} 실증 참가 기업 신청을 접수"),
    ("{c}, 배송 로봇 출시", "launch", "{c}{p} 배송 로봇을 시장에 선보임"),
    ("{c}, 밋업데이 개최", "held", "{c}{p} 밋업 행사 일정을 진행"),
    ("{c}, 보안 인증 획득", "certified", "{c}{p} 보안 인증을 받음"),
    ("{c}, 대학과 업무협약", "partners", "{c}{p} 대학과 협력 체계를 구축"),
    ("{c}, 창업경진대회 대상", "award", "{c}{p} 창업경진대회 평가의 수상자 명단에 포함"),
    ("{c}, 사옥 이전", "plain other", "{c}{p} 사옥 이전"),
]
#: Stems of events and an ending that reports leave out.
ENDED = [(stem, end) for stems, ends in PACK.report_stems for stem in stems.split("|") for end in [*(e for e in ends if "\\" not in e), *(["할 계획이다", "할 방침"] if "|" in stems else [])]]

_COMPANY = "CASE c_custkey % 3 WHEN 0 THEN c_custkey || '가온' WHEN 1 THEN c_custkey || '나래' ELSE 'Lab' || c_custkey END"
_NUMBERS = "CAST(floor(abs(c_acctbal)) AS BIGINT) % 900 + 10 AS n, CAST(c_custkey % 40 + 2 AS BIGINT) AS m"
_CUSTOMERS = f"SELECT c_custkey AS id, {_COMPANY} AS c, CASE c_custkey % 3 WHEN 0 THEN '이' ELSE '가' END AS p, {_NUMBERS} FROM customer"


def _company() -> Column:
    key = F.col("c_custkey").cast("string")
    return F.when(F.col("c_custkey") % 3 == 0, F.concat(key, F.lit("가온"))).when(F.col("c_custkey") % 3 == 1, F.concat(key, F.lit("나래"))).otherwise(F.concat(F.lit("Lab"), key))


def _filled(shapes: list[str], kind: Column) -> Column:
    """The shape of a row's kind with its company and numbers; null for an empty shape."""
    out = F.get(F.array(*map(F.lit, shapes)), kind)
    n, m = F.floor(F.abs("c_acctbal")) % 900 + 10, F.col("c_custkey") % 40 + 2
    for slot, value in (("{c}", _company()), ("{n}", n.cast("long").cast("string")), ("{m}", m.cast("string"))):
        out = F.replace(out, F.lit(slot), value)
    return F.nullif(out, F.lit(""))


def _sql(rows: list[tuple[str, str]]) -> str:
    """id, kind, summary of the customers by (kind, sentence) of their kinds."""
    listed = lambda k: "[" + ", ".join(_quoted(r[k]) for r in rows) + "]"
    pick = lambda k: f"{listed(k)}[CAST(id % {len(rows)} + 1 AS INTEGER)]"
    return f"WITH x AS ({_CUSTOMERS}) SELECT id, {pick(0)} AS kind, replace(replace(replace(replace({pick(1)}, '{{c}}', c), '{{p}}', p), '{{n}}', CAST(n AS VARCHAR)), '{{m}}', CAST(m AS VARCHAR)) AS summary FROM x"


def headlines(spark: SparkSession, d: str) -> DataFrame:
    """Customers as articles: id, title, description."""
    kind = (F.col("c_custkey") % len(TOLD)).cast("int")
    return spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("id"), _filled([t[0] for t in TOLD], kind).alias("title"), _filled([t[1] for t in TOLD], kind).alias("description"))


@query(_sql([(kind, told) for _, _, kind, told in TOLD]))
def local_summaries(spark, d):
    return titles.local_summaries(headlines(spark, d), PACK)


@query(_sql([(kind, told) for _, kind, told in TITLED]))
def title_summaries(spark, d):
    kind = (F.col("c_custkey") % len(TITLED)).cast("int")
    return titles.title_summaries(spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("id"), _filled([t[0] for t in TITLED], kind).alias("title")), PACK)


@query(f"WITH x AS ({_CUSTOMERS}) SELECT id, c || ' ' || [{', '.join(_quoted(stem) for stem, _ in ENDED)}][CAST(id % {len(ENDED)} + 1 AS INTEGER)] AS clause FROM x")
def report_endings(spark, d):
    kind = (F.col("c_custkey") % len(ENDED)).cast("int")
    told = F.concat(_company(), F.lit(" "), F.get(F.array(*(F.lit(stem + end) for stem, end in ENDED)), kind), F.when(F.col("c_custkey") % 2 == 0, ".").otherwise(""))
    once = titles.report_ending(PACK, told)
    return spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("id"), once.alias("clause"))


_PREPARED = rf"trim(regexp_replace(regexp_replace(regexp_replace({s_clean('title')}, '^\[[^\]]+\]\s*', ''), '\s+(?:外|등)$', ''), '\s+', ' ', 'g'))"
_UNQUOTED = "(?:[^,\"''“‘]|\"[^\"]*(?:\"|$)|''[^'']*(?:''|$)|“[^”]*(?:”|$)|‘[^’]*(?:’|$))"
_HEAD = "regexp_replace(regexp_replace(head, '^[\"“''‘][^\"”''’]{2,45}[\"”''’]\\s*', ''), '^(?s:.*)(?:…|\\.{3,})\\s*', '')"


@query(
    rf"""WITH {ARTICLES}, t AS (SELECT id, {_PREPARED} AS t FROM a), h AS (SELECT id, t, regexp_extract(t, '^({_UNQUOTED}*),', 1) AS head, regexp_matches(t, '^{_UNQUOTED}*,') AS has FROM t),
s AS (SELECT *, trim(regexp_replace({_HEAD}, '[“”‘’"'']', '', 'g')) AS own, trim(substring(t, length(head) + 2)) AS rest, regexp_extract(t, '^[A-Za-z0-9가-힣][A-Za-z0-9가-힣&·._-]{{1,29}}') AS word FROM h),
q AS (SELECT *, NOT has AND regexp_matches(t, '^[A-Za-z0-9가-힣][A-Za-z0-9가-힣&·._-]{{1,29}}\s+["“''‘]') AS speaks FROM s)
SELECT id, CASE WHEN speaks THEN word WHEN has AND length(own) <= 35 THEN own ELSE '' END AS subject,
  CASE WHEN speaks THEN trim(substring(t, length(word) + 1)) WHEN has AND rest <> '' THEN rest ELSE t END AS clause FROM q"""
)
def title_parts(spark, d):
    title = titles.prepared(F.col("title"))
    found = articles(spark, d).select("id", titles.analysed(PACK, title, F.lit("")).alias("x"))
    return found.select("id", "x.subject", "x.clause")
