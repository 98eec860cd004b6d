"""Tables of several files and more rows than the smallest ones hold."""

import pytest
from pyspark.sql import functions as F

from siftwell.plans import newsroom, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """pages and events as folders of several files, as larger tables are."""
    path = str(tmp_path_factory.mktemp("tables"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % 3 + 9, F.lit(".example/en/"), "id").alias("url"), F.lit("").alias("html"))
    pages.repartition(3).write.parquet(f"{path}/pages.parquet")
    spark.range(50).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value")).repartition(2).write.parquet(f"{path}/events.parquet")
    return path


def test_streams_read_tables_of_several_files(spark, folder):
    got = newsroom.stream_robots_memo(spark, folder)
    assert got.count() == 2000
    # https://h10.example and https://h11.example have an odd length and rules of their own
    assert got.where("not allowed").count() == sum(len(f"https://h{k % 3 + 9}.example") % 2 == 1 and not str(k).startswith("1") for k in range(2000))
    assert queries.stream_distinct_urls(spark, folder).count() == 40


def test_a_robots_stream_without_rows_gives_none(spark, tmp_path):
    from siftwell.streaming import robots

    spark.createDataFrame([], "id long, url string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, url string").parquet(f"{tmp_path}/in")
    assert robots.robots_memo(stream, str, "siftwell").collect() == []


def test_list_pages_keep_their_first_links_by_id(spark, folder):
    got = {r["url"] for r in newsroom.list_page_links(spark, folder).collect()}
    want = {f"https://list.example/story/{k}" for k in range(2000) if k // 30 < 50 and k % 5 and k % 6 != 3}
    assert got == want


def test_rows_of_one_file_go_to_all_cores(spark, tmp_path):
    row = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("A title\nA text.").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    row.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(64).select(F.col("id").alias("c_custkey"), F.lit(5.0).alias("c_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for rows in (queries.connection_type(spark, str(tmp_path)), newsroom.description_reasons(spark, str(tmp_path))):
        assert rows.select(F.spark_partition_id()).distinct().count() >= 4


def test_cleaning_is_the_same_with_and_without_its_guard(spark):
    from siftwell.functions.text import SPACES, clean, decode_named

    texts = ["plain text", " ends ", "two  spaces", "a\tb", "a b", "a​b", "x &amp;lt; y", "<b>bold</b> & <", "&LT;p&gt;", "﻿x", "", None, " ", "a\n", "a  ", "가온 투자"]
    plain = F.regexp_replace(decode_named(F.regexp_replace(F.coalesce("t", F.lit("")), "<[^>]*>", " ")), r"[\x{200B}-\x{200D}\x{2060}]", "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(clean(F.col("t")).alias("got"), F.trim(F.regexp_replace(plain, SPACES, " ")).alias("want"))
    assert all(r["got"] == r["want"] for r in rows.collect())


def test_a_summarys_sentences_are_scored_once(spark):
    from siftwell.operators import summaries
    from siftwell.packs.corpus import PACK

    rows = spark.createDataFrame([(1, "t", "c", "s", "The fund closed a deal. " * 3)], "id long, title string, category string, source string, body string")
    plan = summaries.extractive(rows, PACK)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "RLIKE" in line and "LIKE(sentence" in line.replace(" ", "")]
    assert not any("Filter" in line and line.count("RLIKE") > 5 for line in plan.splitlines())


def test_a_rollup_computes_its_reason_once(spark):
    from siftwell.operators import aggregates

    rows = spark.createDataFrame([("a", "s"), ("a", None), ("b", "s"), (None, "s")], "t string, source string").withColumn("reason", F.when(F.col("t").rlike("a+"), "x").when(F.col("t").rlike("b+"), "y"))
    found = aggregates.failure_rollup(rows, "reason", "source")
    got = sorted(((r["reason"], r["source"], r["n"]) for r in found.collect()), key=str)
    assert got == sorted([("x", "s", 1), ("x", None, 1), ("y", "s", 1), ("x", None, 2), ("y", None, 1), (None, None, 3)], key=str)
    assert not any("Filter" in line and "RLIKE" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_prose_of_like_bigrams_loses_no_similar_pair(spark, monkeypatch):
    """Titles that share most bigrams, in several blocks, against brute force."""
    import random
    from collections import Counter

    from siftwell.operators import joins

    monkeypatch.setattr(joins, "BLOCK_ROWS", 40)
    monkeypatch.setattr(joins, "STEP", 16)
    rng, words = random.Random(5), ["thein", "there", "nthe", "anth", "hean", "inre"]
    titles = ["".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    titles = sorted({*titles, *(t[:-1] + "x" for t in titles[:30])})
    grams = [Counter(t[k : k + 2] for k in range(len(t) - 1)) for t in titles]
    dice = lambda a, b: 2 * (a & b).total() / (a.total() + b.total())
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if dice(grams[i], grams[j]) >= 0.88}
    got = joins.similar_title_pairs(spark.createDataFrame(list(enumerate(titles)), "id long, title string")).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(want) > 30


def test_rows_of_an_event_meet_those_that_stay_only(spark, monkeypatch):
    """Greedy removal in blocks against brute force; copies of one event make rows, not pairs of all of them."""
    import random
    from collections import Counter

    from siftwell.operators import dedup

    made, pairs_of = [], dedup.event_pairs

    def counted(earlier, later):
        found = pairs_of(earlier, later)
        made.append(found.count())
        return found

    monkeypatch.setattr(dedup, "event_pairs", counted)
    monkeypatch.setattr(dedup, "BLOCK", 4)
    monkeypatch.setattr(dedup, "MOST_BLOCK", 8)
    monkeypatch.setattr(dedup, "BLOCK_ITEMS", 400)
    rng, words = random.Random(7), ["gaon", "narae", "robot", "fund", "north", "harbour", "lamp", "stone", "field", "glass"]
    items = []
    for k in range(120):
        named = rng.sample(words, 3)
        items.append((k, 1000 + k, " ".join(named) + f" {k % 7}", rng.choice(["deal", "fund", None]), named[: rng.randint(0, 3)], [f"{k % 5}억"] if k % 3 == 0 else [], ["시리즈a"] if k % 11 == 0 else []))
    items += [(k, 1000 + k, "gaon series", "launch", ["gaon", "series"], ["9억"], []) for k in range(120, 420)]

    def reason(x, y):
        both = lambda c: [v for v in y[c] if v in x[c]]
        if x[3] is None or x[3] != y[3] or not both(4):
            return None
        out = f"same_event:{y[3]}, entity:{both(4)[0]}"
        if both(5) or both(6):
            return out + "".join(f", {name}:{both(c)[0]}" for name, c in (("amount", 5), ("round", 6)) if both(c))
        prints = [r[2].replace(" ", "") for r in (x, y)]
        a, b = (Counter(p[i : i + 2] for i in range(len(p) - 1)) for p in prints)
        s, t = ({w for w in r[2].split() if len(w) > 1} for r in (x, y))
        close = 1.0 if prints[0] == prints[1] else max(len(s & t) / len(s | t), 2 * (a & b).total() / (a.total() + b.total()))
        return f"{out}, similar_title" if close >= 0.55 else None

    kept, want = [], set()
    for y in items:
        first = next(((x, reason(x, y)) for x in kept if reason(x, y)), None)
        if first:
            want.add((y[1], y[2], first[0][2], first[1]))
        else:
            kept.append(y)
    rows = spark.createDataFrame(items, "rank long, id long, title string, event string, entities array<string>, amounts array<string>, rounds array<string>")
    stay, gone = dedup.by_event(rows)
    assert {tuple(r) for r in gone.collect()} == want and {r["id"] for r in stay.collect()} == {x[1] for x in kept}
    assert len(want) > 320 and sum(made) < 2000


def test_long_titles_without_a_likeness_are_no_candidates(spark, monkeypatch):
    """More bigrams than slots: unlike titles of 6,000 letters aren't compared in full, a near copy is."""
    import random

    from siftwell.operators import joins

    made, pairs_of = [], joins._dice_pairs

    def seen(rows, least):
        found = pairs_of(rows, least)
        made.extend((r["a"], r["b"]) for r in found.collect())
        return found

    monkeypatch.setattr(joins, "_dice_pairs", seen)
    rng = random.Random(3)
    titles = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz가나다라마바사아") for _ in range(6000)) for _ in range(6)]
    titles.append(titles[2][:5900] + "z" * 50)
    got = joins.similar_title_pairs(spark.createDataFrame(list(enumerate(titles)), "id long, title string")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(2, 6)] and made == [(2, 6)]


def test_a_keyed_cache_costs_no_python_per_key(spark, tmp_path):
    """Rows of one batch in any order, over several periods; equal times go to the larger value."""
    from siftwell.streaming.windows import newest_per_key, upserted

    rows = spark.range(4000).select((F.col("id") % 500).cast("string").alias("key"), F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("summary"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7919 % 4000 * 3000 - F.col("id") * 7919 % 4000 * 3000 % 6000).alias("created_at"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = newest_per_key(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    assert "Pandas" not in stream._jdf.queryExecution().logical().toString()
    got = {(r["key"], r["created_at"], r["summary"]) for r in upserted(stream, ["key"], "created_at", f"{tmp_path}/out").collect()}
    want = {}
    for r in rows.collect():
        want[r["key"]] = max(want.get(r["key"], (r["created_at"], r["summary"])), (r["created_at"], r["summary"]))
    assert got == {(k, *v) for k, v in want.items()}


def test_a_queues_requests_wait_in_blocks():
    """A batch of several runs, over a state kept in dicts: served in order, and never more at once than a block."""
    import json
    from types import SimpleNamespace

    import pandas as pd

    from siftwell.streaming.model_queue import Limits, ModelQueue

    class Value:
        def __init__(self):
            self.held = None

        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, held):
            self.held = held

    class Map(dict):
        getValue, removeKey = dict.__getitem__, dict.__delitem__

        def updateValue(self, key, value):
            assert len(json.loads(value[0])) <= 3
            self[key] = value

    timers = []
    handle = SimpleNamespace(getValueState=lambda *_: Value(), getMapState=lambda *_: Map(), listTimers=lambda: list(timers), deleteTimer=timers.remove, registerTimer=timers.append)
    queue = ModelQueue(lambda text, retry: text.upper(), Limits(budget=100), block=3, run=5)
    queue.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms, getCurrentProcessingTimeInMs=lambda: ms)
    order = [7, 3, 11, 0, 9, 14, 2, 5, 13, 1, 8, 4, 12, 6, 10]
    frames = [pd.DataFrame({"id": order[k : k + 2], "text": [f"t{i}" for i in order[k : k + 2]], "ts": pd.to_datetime([i // 4 for i in order[k : k + 2]], unit="s")}) for k in range(0, 15, 2)]
    first = list(queue.handleInputRows(("q",), iter(frames), at(30_000)))
    assert [i for f in first for i in f["id"]] == [0, 1, 2, 3, 4] and max(map(len, first)) <= 3
    assert timers == [35_000] and len(queue.waiting) == 4 and not queue.sorting
    rest = list(queue.handleExpiredTimer(("q",), at(200_000), None))
    assert [(i, a) for f in rest for i, a in zip(f["id"], f["answer"], strict=True)] == [(i, f"T{i}") for i in range(5, 15)]
    assert not timers and not queue.waiting


def test_titles_of_common_words_meet_by_signatures(spark, monkeypatch):
    """All pairs by words and by bigrams against brute force, in small blocks; words that many titles share make no rows of pairs."""
    import random
    from collections import Counter

    from siftwell.operators import joins

    joined, prefix_pairs = [], joins._prefix_pairs

    def seen(rows, items, least):
        joined.append(items)
        return prefix_pairs(rows, items, least)

    monkeypatch.setattr(joins, "_prefix_pairs", seen)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 30)
    monkeypatch.setattr(joins, "STEP", 16)
    rng, words = random.Random(11), [f"w{a}{b}" for a in "aeiou" for b in "lmnrst"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(160)]
    titles = sorted({*titles, *(" ".join(reversed(t.split())) for t in titles[:30]), *(t + " wal" for t in titles[30:60]), "x", "y", "[a] x"})
    prints = [t.replace("[a]", "").replace(" ", "") for t in titles]
    sets = [{w for w in t.strip("[").replace("]", "").split() if len(w) > 1} for t in titles]
    grams = [Counter(p[k : k + 2] for k in range(len(p) - 1)) for p in prints]
    want = {}
    for i in range(len(titles)):
        for j in range(i + 1, len(titles)):
            share = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] and sets[j] else 0.0
            both = grams[i].total() + grams[j].total()
            close = 1.0 if prints[i] == prints[j] else 2 * (grams[i] & grams[j]).total() / both if grams[i] and grams[j] else 0.0
            if share >= 0.72 or close >= 0.88:
                want[i, j] = (share, close)
    got = joins.similar_title_pairs(spark.createDataFrame(list(enumerate(titles)), "id long, title string")).collect()
    assert {(r["a"], r["b"]): (r["jaccard"], r["dice"]) for r in got} == want and len(want) > 60
    assert joined == ["fps"]


def test_titles_meet_those_that_stay_not_all_others(spark, monkeypatch):
    """Greedy removal by URL and title in rounds against brute force; few URLs leave few titles to be compared."""
    import random

    from siftwell.operators import dedup

    made, pairs_of = [], dedup.similar_title_pairs

    def counted(titles):
        made.append(titles.count())
        return pairs_of(titles)

    monkeypatch.setattr(dedup, "similar_title_pairs", counted)
    monkeypatch.setattr(dedup, "FIRST_ROWS", 40, raising=False)
    rng, words = random.Random(2), [f"{a}{b}{a}" for a in "bcdfg" for b in "aeiou"]
    items = []
    for k in range(600):
        title = "" if k % 40 == 7 else items[-rng.randint(1, 50)][2] if k > 50 and rng.random() < 0.3 else " ".join(rng.sample(words, 6))
        items.append((k, f"https://a.example/{rng.choice(['', k % 3, k % 3]) if k % 50 else k}x{k % 40}", title))
    word_set = lambda t: {w for w in t.split() if len(w) > 1}
    urls, kept = set(), []
    for k, url, title in items:
        own = word_set(title)
        if url not in urls and not any(own and len(own & s) / len(own | s) >= 0.72 for s in (word_set(items[i][2]) for i in kept)):
            kept.append(k)
            urls.add(url)
    got = dedup.articles(spark.createDataFrame(items, "id long, url string, title string"), [F.asc("id")]).collect()
    assert sorted(r["id"] for r in got) == kept and len(made) > 1
    assert sum(made) < len({t for _, _, t in items})


def test_texts_are_searched_for_addresses_and_spaces_where_there_are_some(spark):
    """The short ways give what the whole patterns give, on texts with white space, signs and addresses of all kinds."""
    import random

    from siftwell.functions import text
    from siftwell.operators import rules
    from siftwell.packs.corpus import PACK

    rng = random.Random(4)
    signs = [*"ab @.<>&;| \t\n\x0b\f\r", "\u00a0", "\u200b", "\u2003", "\u3000", "\ufeff", "\x85", "é", "&amp;", "&nbsp;", "<b>", "a.b@c.de", "rights", "!!", "licensed", "the"]
    rows = spark.createDataFrame([("".join(rng.choice(signs) for _ in range(rng.randint(0, 14))),) for _ in range(1500)], "t string")
    t, address = F.col("t"), r"copyright|[a-z0-9._]+@[a-z0-9.]+"
    assert text.addresses_only("[a-z]+@[a-z]+") and not text.addresses_only(address) and not text.addresses_only("a@?b") and not text.addresses_only("(a@b|c)")
    found = rows.select(text.matches(t, address).alias("own"), t.rlike(text.regex(address)).alias("whole"), text.single_spaces(t).alias("spaced"), F.regexp_replace(t, text.SPACES, " ").alias("plain"))
    assert "contains(" in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not found.where("own <> whole or spaced <> plain").count() and found.where("own").count() > 50
    assert not rows.where(text.matches(t, PACK.concept("none"))).count()
    null = F.lit("")
    reasons = rows.select(rules.hard_exclusion(PACK, t, t, t, null).alias("a"), rules.hard_exclusion(PACK, t, text.single_spaces(t), t, null).alias("b"))
    assert not reasons.where("not a <=> b").count()
