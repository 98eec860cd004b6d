"""Answers with their checks, the queue on a virtual clock, robots memo, feeds as a source, counted writes."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from siftwell.operators import answers
from siftwell.packs.startup_news import PACK
from siftwell.sources import feed_reader, sinks
from siftwell.streaming import model_queue, robots
from siftwell.streaming.windows import drained


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ({"output_text": "a"}, "a"), ({"output_text": "", "output": []}, ""), ({"output_text": 5, "output": [{"content": [{"type": "output_text", "text": "b"}]}]}, "b"),
        ({"output": [{}, {"content": [{"type": "x", "text": "n"}, {"type": "output_text", "text": 7}, {"type": "output_text", "text": "c"}]}, {"content": [{"type": "output_text", "text": "d"}]}]}, "c"),
        ({"output": [1, {"content": "no"}, {"content": [None, {"type": "output_text", "text": "e"}]}]}, "e"), ({"output": 3}, ""), ([], ""), ("broken", ""), (None, ""),
    ],
)
def test_response_text(spark, payload, want):
    text = None if payload is None else "{broken" if payload == "broken" else json.dumps(payload)
    assert spark.createDataFrame([(text,)], "p string").select(answers.response_text(F.col("p"))).first()[0] == want


def test_claims_need_support(spark):
    rows = [("가온이 30억 원 유치", "가온 30억원", None), ("가온이 40억 원과 7곳", "30억 원", "40억 원"), ("가온 Series A", "가온 시리즈 A", None), ("가온 시리즈B", "가온 Series B", None), ("가온 12개사", "12 개사 모집", None), ("가온", "", None), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, c string, want string").withColumn("got", answers.unsupported_claim(PACK, F.col("s"), F.col("c")))
    assert [r["got"] for r in df.collect()] == [r[2] for r in rows]


def test_second_try_gets_the_reason(spark):
    def model(title, text, reason):
        if title == "down":
            raise ValueError("no service")
        if title == "liar":
            return f"가온이 {'99' if not reason else '30'}억 원을 조달해 해외 판로 개척에 투입함"
        return {"empty": "", "copy": "copy", "stuck": "가온이 99억 원을 조달해 해외 판로 개척에 투입함"}.get(title, "요약: 가온이 해외 판로 개척을 추진함")

    names = ["fine", "liar", "stuck", "down", "empty", "copy", None]
    rows = [(k, t, "매체", None, "가온 30억 원", False, f"local {k}") for k, t in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, title string, source string, description string, text string, described boolean, summary string")
    got = {r["id"]: tuple(r)[1:] for r in answers.answered(df.withColumn("answer", F.lit("x")), model, PACK).collect()}
    assert got[0] == ("가온이 해외 판로 개척을 추진함", "model", 1, None) and got[1] == ("가온이 30억 원을 조달해 해외 판로 개척에 투입함", "model", 2, None)
    assert got[2] == ("local 2", "local", 2, "unsupported_claim:99억 원") and got[3] == ("local 3", "local", 1, "no service")
    assert got[4] == ("local 4", "local", 2, "empty_summary") and got[5] == ("local 5", "local", 2, "title_summary_too_similar") and got[6][1] == "model"
    assert answers.answered(df.limit(0), model, PACK).count() == 0


def test_refusals():
    limits = model_queue.Limits()
    told = {
        "requests per day (RPD)": ("stop", None), "tokens per min": ("stop", None), "tokens per min, please try again in 2m1s": ("stop", None), "tokens per min, please try again in 90s": ("wait", 90.0),
        "requests per min": ("wait", 20.0), "requests per min, try again in 3m": ("fail", None), "429": ("fail", None), "requests per min, try again in 250ms": ("wait", 20.0),
    }
    assert {m: model_queue.verdict(m, 0, limits) for m in told} == told
    assert model_queue.verdict("requests per min", 1, limits) == ("wait", 40.0) and model_queue.verdict("requests per min", 2, limits) == ("fail", None)


def test_queue_on_a_virtual_clock(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = dt.datetime(2026, 1, 1)

    def ask(text, retry):
        if text == "slow" and not retry:
            raise model_queue.Limited("requests per min, try again in 30s")
        if text == "never":
            raise model_queue.Limited("requests per min")
        if text == "day":
            raise model_queue.Limited("requests per day")
        if text == "bad":
            raise ValueError("bad")
        return text.upper()

    batches = [
        [("a", 1, "one", 0), ("a", 2, "two", 0), ("b", 10, "bad", 1), ("b", 11, "slow", 2), ("c", 20, "never", 0), ("d", 30, "x", 0), ("d", 31, "day", 1), ("d", 32, "y", 2), ("e", 40, "p", 0)],
        [("a", 3, "three", 10), ("z", 99, "tick", 60)], [("d", 33, "late", 61), ("z", 98, "tick", 400)], [("z", 97, "tick", 900)],
    ]
    os.makedirs(tmp_path / "in")
    for k, rows in enumerate(batches):
        name = tmp_path / "in" / f"{k}.json"
        name.write_text("\n".join(json.dumps({"queue": q, "id": i, "text": t, "ts": str(start + dt.timedelta(seconds=s))}) for q, i, t, s in rows))
        os.utime(name, (1000 + k, 1000 + k))
    stream = spark.readStream.schema("queue string, id long, text string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    done = drained(model_queue.served(stream, ask, model_queue.Limits(budget=4)))
    got = {r["id"]: (r["answer"], r["error"], r["calls"], None if r["started"] is None else (r["started"] - start).total_seconds()) for r in done.collect()}
    assert got[1] == ("ONE", None, 1, 0) and got[2] == ("TWO", None, 1, 7) and got[3] == ("THREE", None, 1, 14)
    assert got[10] == (None, "bad", 1, 1) and got[11] == ("SLOW", None, 2, 38)
    assert got[20] == (None, "requests per min", 3, 60)  # waits of 20 and 40 seconds
    assert got[30] == ("X", None, 1, 0) and got[31] == (None, "requests per day", 1, 7) and got[32] == (None, "daily", 0, None) and got[33] == (None, "daily", 0, None)
    assert got[40][0] == "P" and len(got) == done.count()


def test_budget_ends_a_queue(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"queue": "a", "id": k, "text": "t", "ts": f"2026-01-01 00:0{k}:00"}) for k in range(6)))
    stream = spark.readStream.schema("queue string, id long, text string, ts timestamp").json(str(tmp_path / "in"))
    got = {r["id"]: r["error"] for r in drained(model_queue.served(stream, lambda t, n: t, model_queue.Limits(budget=3))).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "budget", 4: "budget", 5: "budget"}


def test_robots_memo_fetches_once_and_anew_when_old(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def fetch(origin):
        with open(asked / "log", "a") as f:
            f.write(origin + "\n")
        if "down" in origin:
            raise OSError
        return "User-agent: *\nDisallow: /private"

    rows = [[(1, "http://a.example/private/x", 0), (2, "http://a.example/y", 0), (3, "http://down.example/private", 0), (4, None, 0)], [(5, "http://a.example/private", 1), (6, "http://b.example/private", 1)], [(7, "http://a.example/z", 48)]]
    (tmp_path / "in").mkdir()
    for k, part in enumerate(rows):
        name = tmp_path / "in" / f"{k}.json"
        name.write_text("\n".join(json.dumps({"id": i, "url": u, "ts": f"2026-01-0{1 + h // 24} 0{h % 24}:00:00"}) for i, u, h in part))
        os.utime(name, (1000 + k, 1000 + k))
    stream = spark.readStream.schema("id long, url string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {r["id"]: r["allowed"] for r in robots.robots_memo(stream, fetch, "siftwell", str(tmp_path / "memo"), now=F.col("ts")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 7: True}
    assert sorted((asked / "log").read_text().split()) == ["http://a.example", "http://a.example", "http://b.example", "http://down.example"]


def test_feed_source(spark, tmp_path):
    docs = {
        "A/1": "<rss><item><title>T &amp; 1</title><link>http://x/1?a=1&amp;b=2</link><pubDate>d</pubDate></item><item><title>no link</title></item></rss>",
        "B": '<feed><entry><title type="html">&lt;b&gt;x&lt;/b&gt;</title><link href="http://x/2"/><published>p</published><updated>u</updated></entry></feed>',
        "C": "<urlset><url><loc><![CDATA[http://x/3]]></loc></url></urlset>", "D": "<rss><item>", "E": "<rss></rss>",
    }
    for name, text in docs.items():
        os.makedirs(feed_reader.folder_of(str(tmp_path), name))
        with open(f"{feed_reader.folder_of(str(tmp_path), name)}/part-0.txt", "w") as f:
            f.write(text)
    feed_reader.register(spark)
    df = spark.read.format("feeds").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == [
        ("A/1", "rss", 0, "http://x/1?a=1&b=2", "T & 1", "d", None), ("A/1", "rss", 1, "", "no link", "", None), ("B", "atom", 0, "http://x/2", "<b>x</b>", "p", None),
        ("C", "sitemap", 0, "http://x/3", "", "", None), ("D", None, None, None, None, None, "no whole feed"),
    ]
    one = df.where("source in ('A/1', 'C') and source = 'A/1' and at = 0")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1 and spark.read.format("feeds").option("most", 1).load(str(tmp_path)).where("source = 'A/1'").count() == 1


def test_counts_are_taken_while_writing(spark, tmp_path):
    rows = spark.range(100).withColumn("ok", F.col("id") % 4 == 0)
    seen = spark.sparkContext.accumulator(0)

    def counting(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    counts = sinks.written(rows.mapInPandas(counting, rows.schema), str(tmp_path / "out"), {"n": F.count("*"), "good": F.count_if("ok")})
    assert counts == {"n": 100, "good": 25} and seen.value == 100 and spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_keyed_cache_forgets(spark, tmp_path):
    from siftwell.streaming.windows import newest_per_key, upserted

    (tmp_path / "in").mkdir()
    parts = [[("a", "one", "2026-01-01"), ("b", "x", "2026-01-01")], [("a", "two", "2026-01-05"), ("b", "older", "2025-12-31")], [("c", "tick", "2026-03-01")], [("d", "tick", "2026-03-02")]]
    for k, part in enumerate(parts):
        name = tmp_path / "in" / f"{k}.json"
        name.write_text("\n".join(json.dumps({"key": i, "summary": v, "created_at": f"{t} 00:00:00"}) for i, v, t in part))
        os.utime(name, (1000 + k, 1000 + k))
    stream = spark.readStream.schema("key string, summary string, created_at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {r["key"]: r["summary"] for r in upserted(newest_per_key(stream), ["key"], "created_at", str(tmp_path / "out")).collect()}
    assert got == {"a": "two", "b": "x", "c": "tick", "d": "tick"}
