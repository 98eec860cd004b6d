"""Operators 11 to 13 against brute force and round trips, with the defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import decision_list, fill_middle, token_alignment

ODD = [None, "", " ", "\n\t ", "one", " one", "one ", "a  b\n\nc\x0b", "ünï 中文　x y 𝒳", "is <P> in it", "x<S>", "the <|endoftext|> mark", "lone ▁ mark", "\x00\x01\x1c x", "é" * 700, "ab" * 900, " " * 900 + "z"]


def texts_of(seed=1, n=60):
    rng = random.Random(seed)
    some = ["the", "of", "Tokens", "ränder", "don't", "42", "x_y", "...", "中文", "aaaa", "🙂", "<P", "S>"]
    return [(" " if rng.random() < 0.2 else "") + "".join(rng.choice(some) + rng.choice([" ", " ", "  ", "\n", "\t", ""]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def docs_of(spark, texts):
    rows = [(k, t, "a", "b", 1, True) for k, t in enumerate(texts)] + [(None, "no id here at all", "a", "b", 1, False)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, form string, rule string, n long, kept boolean")


# 11


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    often = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(often)


def test_statistics_match_brute_force():
    rng = random.Random(3)
    made = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for t in ODD + texts_of() + made + ["a b\na b\n \n\n c |#<>&*%$ \r\na b"]:
        assert decision_list.statistics(t.encode() if t else None)[:5] == brute_statistics(t), t


def test_best_condition_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 7, size=(80, len(decision_list.TERMS))).astype(float)
    y = (x[:, 2] + rng.normal(size=80) > 4)
    gain, found = decision_list.best_condition(x, y)
    info = lambda m: np.log2(y[m].mean()) if y[m].any() else 0.0
    every = [(y[m].sum() * (info(m) - np.log2(y.mean())), j, above) for j in range(x.shape[1]) for c in range(7) for above in (True, False) if (m := (x[:, j] > c) if above else (x[:, j] <= c)).any()]
    assert abs(gain - max(every)[0]) < 1e-9 and found.term == decision_list.TERMS[max(every)[1]] and found.above == max(every)[2]


def test_pruning_cuts_from_the_end():
    x = np.zeros((30, len(decision_list.TERMS)))
    x[:, 0], x[:, 1] = np.arange(30), np.arange(30) % 2
    a, b = decision_list.Condition(decision_list.TERMS[0], True, 9.5), decision_list.Condition(decision_list.TERMS[1], True, 0.5)
    assert decision_list.pruned((a, b), x, x[:, 0] > 9.5) == (a,)
    assert decision_list.pruned((a, b), x, (x[:, 0] > 9.5) & (x[:, 1] > 0.5)) == (a, b)


@pytest.fixture(scope="module")
def rated(spark):
    """Documents of two kinds to be dropped: shouted ones, and long lists of one word with digits."""
    rng, docs, labels = random.Random(5), [], []
    words = ["w" + "".join("abcdefghij"[int(c)] for c in f"{k:03d}") for k in range(400)]
    for k in range(900):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(60, 90)))
        if k % 6 == 0:
            text = text.upper()
        elif k % 6 == 1:
            text = re.sub(" ", lambda m: rng.choice([" 77 ", " "]), text)
        docs.append((k, text, "extra"))
        labels.append((k, int(k % 6 > 1)))
    docs += [(5000, None, "e"), (5001, "", "e"), (None, docs[2][1], "e"), (0, docs[0][1], "e"), (5002, "short text", "e"), (5003, "again and " * 400, "e"), (5004, docs[2][1] * 300, "e")]
    return spark.createDataFrame(docs, "doc_id long, text string, n_words string").cache(), spark.createDataFrame(labels + [(0, 0), (None, 0), (7000, 1)], "doc_id long, quality int").cache()


def test_decisions(rated):
    docs, labels = rated
    rules = decision_list.learned(docs, labels)
    assert 2 <= len(rules) <= 6
    rows = decision_list.decisions(docs, labels).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    right = 0
    for r in rows:
        stats = brute_statistics(texts[r["doc_id"]])
        assert tuple(r[k] for k in decision_list.STATISTICS[:5]) == stats
        assert r["base_failed"] == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
        # The emitted conditions against the rules themselves.
        full = dict(zip(decision_list.STATISTICS, decision_list.statistics((texts[r["doc_id"]] or "").encode())))
        x = np.array([[full["n_words"] if t == "words" else full[decision_list._PER[t][0]] / max(full[decision_list._PER[t][1]], 1) for t in decision_list.TERMS]], dtype=float)
        met = [rule for rule in rules if decision_list.covered(rule, x)[0]]
        assert r["kept"] == (not r["base_failed"] and not met)
        assert r["rule"] == (" and ".join(map(str, met[0])) if met and not r["base_failed"] else None)
        held = r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        right += held and r["kept"] == (r["doc_id"] % 6 > 1)
    n_held = sum(zlib.crc32(str(k).encode()) % 3 == 1 for k in range(900))
    assert right >= 0.97 * n_held
    kept = decision_list.filtered(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_decisions_without_anything_to_learn(spark, rated):
    docs, labels = rated
    for none in (labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        rows = decision_list.decisions(docs.limit(60), none).collect()
        assert all(r["kept"] != r["base_failed"] and r["rule"] is None for r in rows)
    assert decision_list.decisions(docs.limit(0), labels).count() == 0
    hot = labels.where("doc_id = 3").crossJoin(spark.range(500)).drop("id").unionByName(labels)
    assert decision_list.learned(docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(50)).drop("id")), hot) == decision_list.learned(docs, labels)


# 12


@pytest.fixture(scope="module")
def sides():
    a, b = (open(f, "rb").read() for f in (token_alignment.A_FILE, token_alignment.B_FILE))
    return token_alignment.Aligner(a, b)


def brute_alignment(texts, sides):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups by plain loops and the libraries' own encoders."""
    rows, links = [], []
    for t in texts:
        a = sides.a.slow.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sides.b.model.encode(t) if t else []
        spans = []
        for ids, side in ((a, sides.a), (b, sides.b)):
            at, own = 0, []
            for k in ids:
                own.append((at, at + len(side.spelling[k]), k))
                at += len(side.spelling[k])
            spans.append(own)
        if not t or any(b"".join(s.spelling[k] for _, _, k in own) != (" " + t).encode() for s, own in zip((sides.a, sides.b), spans)):
            spans = [[], []]
        cuts = sorted({y for _, y, _ in spans[0]} & {y for _, y, _ in spans[1]})
        groups, begin = [], 0
        for end in cuts:
            groups.append("|".join(",".join(str(k) for x, _, k in own if begin <= x < end) for own in spans))
            begin = end
        links.append([(p, q) for x, y, p in spans[0] for u, v, q in spans[1] if x < v and u < y])
        rows.append((len(spans[0]), len(spans[1]), len(cuts), len(links[-1]), ";".join(groups)))
    count = Counter(pair for own in links for pair in set(own))
    best = {}
    for (p, _), n in count.items():
        best[p] = max(best.get(p, 0), n)
    return [(*r[:4], sum(count[x] == best[x[0]] for x in own), sum(count[x] for x in own), hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "") for r, own in zip(rows, links)]


@pytest.mark.parametrize("common", [token_alignment.COMMON, 40, 0])
def test_alignment_matches_brute_force(spark, sides, common):
    texts = ODD + texts_of(6) + texts_of(6)[:3]
    got = token_alignment.alignment(docs_of(spark, texts).repartition(3), common=common)
    rows = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got.collect()]
    want = brute_alignment(texts + ["no id here at all"] * 2, sides)
    assert sorted(rows, key=repr) == sorted([(k, *w) for k, w in zip([*range(len(texts)), None, None], want)], key=repr)
    assert want[texts.index("lone ▁ mark")][:4] == (0, 0, 0, 0) and want[texts.index("the <|endoftext|> mark")][0] > 3


def test_alignment_outputs(spark, sides):
    own = token_alignment.Alignment(docs_of(spark, texts_of(7, 20)))
    rows = own.rows.withColumn("each", token_alignment.groups_of(F.col("groups"))).collect()
    for r in rows:
        a, b = (b"".join(side.spelling[k] for g in r["each"] for k in g[c]) for c, side in (("a", sides.a), ("b", sides.b)))
        assert a == b and len(r["each"]) == r["n_groups"] and sum(len(g["a"]) for g in r["each"]) == r["n_a"]
        for g in r["each"]:  # no group could be cut again
            x, y = (np.cumsum([len(side.spelling[k]) for k in g[c]]).tolist() for c, side in (("a", sides.a), ("b", sides.b)))
            assert set(x) & set(y) == {x[-1]}
    counts = own.counts(own.rows).collect()
    assert all(r["n_docs"] >= 1 for r in counts) and {r["a"] for r in counts} == {r["a"] for r in counts if r["best"]}
    assert token_alignment.alignment(docs_of(spark, []).limit(0)).count() == 0


def test_both_byte_level_encoders_agree(sides):
    rng = random.Random(8)
    good = [s.decode() for s in sides.a.spelling if s and s.decode("utf-8", "ignore").encode() == s]
    texts = ["".join(rng.choice(good) for _ in range(rng.randint(1, 4))) for _ in range(20000)] + [c * n for c in "ae -=\n.é" for n in range(1, 80)] + [t for t in ODD if t]
    assert sides.a.fast is not None
    want = [x.ids for x in sides.a.slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [sides.a(t).tolist() for t in texts] == want


# 13


def brute_middle(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_matches_brute_force_and_is_restored(spark):
    texts = ODD * 6 + texts_of(9, 120) + ["word " * 60000]
    docs = docs_of(spark, texts)
    made = fill_middle.transformed(docs)
    assert set(docs.columns) <= set(made.columns) and len(made.columns) == len(set(made.columns))
    rows = made.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert tuple(r[c] for c in fill_middle.RESULTS) == brute_middle(r["doc_id"], r["text"])
        assert r["again"] == (r["text"] or "")
    assert {r["form"] for r in rows} == {"plain", "spm", "psm"}


def test_fill_middle_parameters(spark):
    docs = docs_of(spark, texts_of(10, 80))
    every = fill_middle.transformed(docs, seed=1, rate=100, suffix_first=0)
    assert {r["form"] for r in every.collect()} <= {"psm", "plain"} and every.where("form = 'psm'").count() > 60
    assert {r["form"] for r in fill_middle.transformed(docs, rate=0).collect()} == {"plain"}
    assert fill_middle.transformed(docs.limit(0)).count() == 0
