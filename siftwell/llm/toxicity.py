"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and beginnings of words (4 to 6 letters) that stand out, by documents, in toxic rows.
Features per text: densities and counts of lexicon words and beginnings, how near they stand to second-person words,
capitals, punctuation, repeated marks, obfuscation (digits or marks inside words, spaced letters), lengths. Trees are
grown on histograms of quantile bins with second-order steps. The labelled rows are dealt into `FOLDS` folds: a row's
features for learning come from the lexicon of the other folds, and the isotonic calibration is fitted on scores that
neither the lexicon nor the trees learned from.

Only labelled rows that are not held out teach, `SAMPLE_ROWS` at most by hash of the id; that bound is the one
limit, every text is scored whole. doc_id, source and lang are never features.

Defined cases: null and empty texts have features of zero and are scored like others; rows with a null doc_id are
scored (held_out false) and never learned from; an id that labels or documents repeat teaches once (its least label and
text); with no labels or one class only, the score is that class's share (0 without labels); texts of another type are cast
to strings; extra columns are ignored, in `without_toxic` kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, in_thirds, returned, slices, tidy

SAMPLE_ROWS = 8000
LEXICON = 1500
THRESHOLD = 0.7
FOLDS = 3
SLICE_BYTES = 2 << 20
CACHED_WORDS = 150_000

#: Second-person words of the languages met.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tú tus usted ustedes vosotros".split())
NAMES = [
    "log_words", "word_density", "start_density", "any_density", "log_hits", "log_distinct", "best_weight", "mean_weight", "near_second", "second_density",
    "capital_share", "shouted_words", "punctuation", "exclamations", "questions", "repeated_marks", "obfuscated", "spaced_letters", "letter_share",
    "mean_word", "distinct_share",
]
_TOKEN = re.compile(r"[^\W_]+")
_REPEATED = re.compile(r"([!?.*#$%&])\1")
_OBFUSCATED = re.compile(r"[^\W\d_][@$!*#+0-9]+[^\W\d_]")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-_]){3,}[^\W\d_]\b")


def beginnings(word: str) -> list[str]:
    """The word, and its first 4 to 6 letters marked with an asterisk."""
    return [word] + [word[:k] + "*" for k in (4, 5, 6) if len(word) > k]


class Features:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[float, float]] = {}

    def weights(self, word: str) -> tuple[float, float]:
        whole, *starts = beginnings(word)
        return self.lexicon.get(whole, 0.0), max((self.lexicon.get(s, 0.0) for s in starts), default=0.0)

    def __call__(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(NAMES)
        words = _TOKEN.findall(text)
        lowered = [w.lower() for w in words]
        n = max(1, len(words))
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        known = self.known
        distinct = set(lowered)
        hits: dict[str, tuple[float, float]] = {}
        for w in distinct:
            if (own := known.get(w)) is None:
                own = known[w] = self.weights(w)
            if own[0] or own[1]:
                hits[w] = own
        places = [k for k, w in enumerate(lowered) if w in hits] if hits else []
        second = [k for k, w in enumerate(lowered) if w in SECOND_PERSON] if distinct & SECOND_PERSON else []
        near = 0.0
        if places and second:
            at = np.searchsorted(second, places)
            marks = np.array([-(10**9), *second, 10**9])
            near = float(np.exp(-np.minimum(np.abs(marks[at] - places), np.abs(marks[at + 1] - places)) / 5.0).sum()) / n
        best = [max(hits[lowered[k]]) for k in places]
        size = len(text)
        letters = sum(map(len, words))
        capitals = sum(w.isupper() for w in words if len(w) > 1)
        upper = sum(1 for w, low in zip(words, lowered, strict=True) if w != low)
        return [
            math.log1p(len(words)), sum(hits[lowered[k]][0] > 0 for k in places) / n, sum(hits[lowered[k]][1] > 0 for k in places) / n, len(places) / n,
            math.log1p(len(places)), math.log1p(len(hits)), max(best, default=0.0), sum(best) / n, near, len(second) / n,
            upper / n, capitals / n, (size - letters - text.count(" ")) / size, text.count("!") / size, text.count("?") / size,
            len(_REPEATED.findall(text)) / size, len(_OBFUSCATED.findall(text)) / n, len(_SPACED.findall(text)) / n, letters / size,
            letters / n, len(distinct) / n,
        ]


def lexicons_of(rows: DataFrame, folds: int = FOLDS, most: int = LEXICON) -> list[dict[str, float]]:
    """Words and beginnings that stand out in toxic rows, with their log odds: of all rows, then without each fold.

    rows: text, toxic, fold.
    """
    kinds = [("clean", 0), ("toxic", 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], Counter] = {}
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                found.setdefault((fold, toxic), Counter()).update({b for w in {w.lower() for w in _TOKEN.findall(text or "")} for b in beginnings(w)})
            flat = [(f, fold, toxic, n) for (fold, toxic), own in found.items() for f, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["feature", "fold", "toxic", "n"])

    size = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    of = lambda name, value, without: F.coalesce(F.sum(F.when((F.col("toxic") == value) & (F.col("fold") != without), F.col("n"))), F.lit(0)).alias(f"{name}_{without}")
    every = range(-1, folds)
    counts = rows.mapInArrow(tidy(count), "feature string, fold int, toxic int, n bigint").groupBy("feature").agg(*(of(name, value, k) for name, value in kinds for k in every))
    counts = counts.where(F.col("toxic_-1") >= 4).persist()
    out = []
    for k in every:
        clean, toxic = (sum(n for (fold, value), n in size.items() if value == wanted and fold != k) for wanted in (0, 1))
        if not clean or not toxic:
            out.append({})
            continue
        odds = F.log((F.col(f"toxic_{k}") + 0.25) / (toxic + 0.5)) - F.log((F.col(f"clean_{k}") + 0.25) / (clean + 0.5))
        chosen = counts.where(F.col(f"toxic_{k}") >= 4).withColumn("odds", odds).where("odds > 2").withColumn("rank", F.col("odds") * F.sqrt(f"toxic_{k}"))
        out.append({r["feature"]: round(r["odds"], 6) for r in chosen.orderBy(F.desc("rank"), "feature").limit(most).collect()})
    counts.unpersist()
    return out


class Trees:
    """Binary boosted trees: logistic loss, second-order gain, histograms over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = math.log(share / (1 - share))
        margin = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            margin += tree[2][leaf]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(g), dtype=np.int64)
        for node in range(nodes):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            total_g, total_h = g[own].sum(), h[own].sum()
            value[node] = -self.rate * total_g / (total_h + self.ridge)
            if node >= 2**self.depth - 1:
                continue
            best = (1e-6, -1, 0)
            for j, e in enumerate(self.edges):
                if not len(e):
                    continue
                left_g = np.bincount(binned[own, j], weights=g[own], minlength=len(e) + 1).cumsum()[:-1]
                left_h = np.bincount(binned[own, j], weights=h[own], minlength=len(e) + 1).cumsum()[:-1]
                gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
                gain[(left_h < self.least) | (total_h - left_h < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], self.edges[best[1]][best[2]]
                at[own] = 2 * node + 1 + (binned[own, best[1]] > best[2])
        return (feature, cut, value), at

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]), at)
            total += value[at]
        return total


class Isotonic:
    """Pooled adjacent violators, read off by linear interpolation."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([b, 1.0, a, a])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m2, n2, _, last = blocks.pop()
                m1, n1, first, _ = blocks.pop()
                blocks.append([(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, first, last])
        self.x = np.array([v for b in blocks for v in (b[2], b[3])])
        self.y = np.array([b[0] for b in blocks for _ in (0, 1)])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


class Model:
    """Lexicon, trees and calibration; constant where there was nothing to learn.

    x has a row's features by the lexicon without each fold, along the first axis; fold tells the fold of each row.
    """

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.lexicon, self.constant = lexicon, float(y.mean()) if len(y) else 0.0
        self.trees = None
        if len(y) >= 20 and 0 < y.mean() < 1:
            unseen = x[fold, np.arange(len(y))]
            self.trees = Trees().fit(unseen, y)
            out = np.zeros(len(y))
            for k in range(len(x)):
                own = fold == k
                if own.any() and not own.all():
                    out[own] = Trees().fit(unseen[~own], y[~own]).margin(x[k][own])
            self.calibration = Isotonic().fit(out, y)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        # Calibration has steps; a little of the trees' own chance keeps an order within a step.
        margin = self.trees.margin(x)
        return np.clip(0.99 * self.calibration(margin) + 0.01 / (1 + np.exp(-margin)), 0.0, 1.0)


def learned(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.col("toxic").cast("int")).alias("toxic"))
    labels = labels.where(~in_thirds(F.col("__id")))
    n = labels.count()
    drawn = labels.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < min(1.0, sample_rows / max(n, 1)) * (1 << 20))
    fold = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic", fold)
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"), F.min("fold").alias("fold"))
    lexicons = lexicons_of(rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = [Features(lexicon) for lexicon in lexicons[1:]]
        for batch in batches:
            x = [[v for of in features for v in of(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "fold")), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    table = rows.mapInArrow(tidy(describe), f"doc_id {dict(rows.dtypes)['doc_id']}, toxic int, fold int, x array<double>").orderBy(F.xxhash64("doc_id"), "toxic", "x").toArrow()
    x = np.array(table.column("x").to_pylist(), dtype=float).reshape(-1, FOLDS, len(NAMES)).swapaxes(0, 1)
    return Model(lexicons[0], x, table.column("toxic").to_numpy().astype(float), table.column("fold").to_numpy())


def score(text: Column, model: Model, spark) -> Column:
    """The likelihood that each text is toxic; of a row only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def likelihood(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        features = Features(model.lexicon)
        for texts in batches:
            found = [np.empty(0)]
            for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE_BYTES):
                found.append(model(np.array([features(t) for t in part.column("text").to_pylist()], dtype=float).reshape(-1, len(NAMES))))
            yield pa.array(np.concatenate(found))
        del features
        returned()

    return likelihood(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels' rows of docs that aren't held out."""
    frugal(docs.sparkSession)
    found = docs.select("doc_id", score(F.col("text"), learned(docs, labels), docs.sparkSession).alias("score"))
    return found.select("doc_id", F.coalesce(in_thirds(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    frugal(docs.sparkSession)
    return docs.where(score(F.col("text"), learned(docs, labels), docs.sparkSession) < threshold)
