"""The pipeline's stages one after the other, against brute force, and with the defined edge cases."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_classes, brute_hits, brute_lines

from siftwell.llm import merge_dropout

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    words = ["v" + "".join("abcdefghij"[int(c)] for c in f"{k:03d}") for k in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(15)
    texts = [f"{prose(30)}\nread more at our site\n{prose(10)}" for _ in range(60)]
    texts += [texts[0], texts[0] + " tail"]
    texts += [prose(20) + " " + item + " " + prose(20)]
    texts += [prose(25) + " vilegrunt vilegrunt" for _ in range(40)]
    labels = [(k, 1, int("vilegrunt" in t)) for k, t in enumerate(texts)]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/s{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/s{k}.parquet")
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] == set(range(63)) and kept[1] == kept[0]
    assert spark.read.parquet(f"{tmp_path}/s1.parquet").where(F.col("text").contains("read more")).count() == 0
    assert kept[2] == set(range(60)) | {62} and kept[3] == set(range(60)) == kept[4]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, docs.select("doc_id", "n_tokens").collect()))


def written(spark, where, rows, items):
    """The tables that the pipeline reads; texts with `vilegrunt` are the toxic ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], schema).write.parquet(f"{where}/documents.parquet")
    labels = [(k, 1, int("vilegrunt" in (t or ""))) for k, t in rows if k is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")


def brute_pipeline(rows, items):
    """What is left of (doc_id, text): the doc_ids with their texts."""
    left = [(k, t) for k, t in rows if "vilegrunt" not in (t or "")]
    left = [(k, t) for (k, _), t in zip(left, brute_lines([t for _, t in left]))]
    texts = [t for _, t in left]
    kept = [x for x, (place, n, first) in zip(left, brute_classes(texts)) if not n or first == place]
    return [x for x, hit in zip(kept, brute_hits([t for _, t in kept], [(str(k), t) for k, t in items], 10)) if not hit[4]]


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(31)
    words = ["v" + "".join("abcdefghij"[int(c)] for c in f"{k:03d}") for k in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, prose(14)), (2, prose(6))]
    texts = [f"{prose(28)}\nvisit us on day {k} for more of it\n{prose(9)}" for k in range(40)]
    texts += [texts[3], texts[4].upper(), texts[5] + " end", f"{prose(9)} {items[0][1]} {prose(9)}", f"{prose(9)} {items[1][1]}", None, "", "  ", "two words", "two words", prose(4000)]
    texts += [prose(25) + " vilegrunt vilegrunt" for _ in range(30)]
    rows = list(enumerate(texts))
    written(spark, tmp_path, rows, items)
    found = merge_dropout.decoded(corpus_pipeline.run(spark, str(tmp_path))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == brute_pipeline(rows, items)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, one id with several texts, clashing names, an empty table."""
    rng = random.Random(32)
    words = ["v" + "".join("abcdefghij"[int(c)] for c in f"{k:03d}") for k in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    body, other, third = prose(30), prose(30), prose(30)
    written(spark, tmp_path, [(k, prose(20) + (" vilegrunt vilegrunt" if k % 3 == 0 else "")) for k in range(60)], [(1, prose(12)), (None, None)])
    rows = [(1, body), (1, body), (1, other), (2, body + " end"), (None, third), (None, third), (None, third + " end"), (3, None), (3, None), (4, ""), (None, None), (5, prose(20000))]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = {"__id": 7, "key": "x", "n": 1, "h1": 2, "h2": 3, "leaf": "y", "text_key": 4, "class_key": 5, "score": 0.5, "spans": "z", "terms": 6, "n_hit": 8}
    for table in (docs.withColumns({k: F.lit(v) for k, v in names.items()}), docs.limit(0)):
        held = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, held, str(tmp_path))
            assert out.columns == table.columns
            held = spark.createDataFrame(out.collect(), out.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path))
        if table.limit(1).count():
            left = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in held.collect())
            assert [x for x in left if x[:2] == (False, 1)] == sorted([(False, 1, body), (False, 1, other)])
            assert [x[2] for x in left if x[0]] == sorted(["", min((third, third + " end"), key=lambda t: kept_first(spark, t))])
            assert sum(x[1] == 3 for x in left) == 2 and sum(x[1] in (4, 5) for x in left) == 2 and not any(x[1] == 2 for x in left)
        assert last.count() == held.count()


def kept_first(spark, text):
    return spark.range(1).select(F.xxhash64(F.lit(text)).alias("x")).first()["x"]
