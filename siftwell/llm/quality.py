"""Quality classifier by co-training.

Two views of a document: its text's content (how kinds of characters follow each other, words' lengths, repetition)
and its metadata (source, language, stated length; hashed). Each view has a logistic classifier. Over `ROUNDS`
rounds each labels its most confident rows of an unlabelled pool, in the labelled rows' proportion of classes, and
hands them to the other view. A part of the labelled rows is kept from both; on it each view is calibrated and a
logistic combination of the calibrated views is fitted, which then scores all documents.

Labelled rows that aren't held out teach, `LABELLED_ROWS` at most by hash of the id, and the pool has `POOL_ROWS` at
most; these bounds are for fitting only, every text is scored whole.

Defined cases: null or empty text has content features of zero, null metadata a bucket of its own; rows with a null
doc_id are scored (held_out false), never learned from; repeated rows get a row each, and an id that documents or labels
repeat teaches once (its least features, its least label); labels of one class only (or
none) give that class's share (0.5) as every score; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import byte_texts, frugal, in_thirds, slices, tidy

LABELLED_ROWS = 6000
POOL_ROWS = 6000
ROUNDS = 5
SLICE_BYTES = 4 << 20
SOURCES, LANGS = 64, 16


def _kind(b: int) -> int:
    c = chr(b)
    return 7 if b >= 0x80 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t" else 4 if c in "\n\r" else 5 if c in ".,;:'\"()-" else 6


KINDS = bytes(map(_kind, range(256)))
N_CONTENT = 64 + 6
N_META = SOURCES + LANGS + 3


def content(text: bytes | None) -> np.ndarray:
    x = np.zeros(N_CONTENT)
    if not text:
        return x
    kinds = np.frombuffer(text.translate(KINDS), dtype=np.uint8)
    if len(kinds) > 1:
        x[:64] = np.bincount(kinds[:-1] * 8 + kinds[1:], minlength=64) / (len(kinds) - 1)
    words = text.split()
    n = max(1, len(words))
    lines = text.split(b"\n")
    x[64:] = math.log1p(len(words)), len(set(words)) / n, sum(map(len, words)) / n / 10, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(lines)) / len(lines), math.log1p(len(lines))
    return x


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(N_META)
    x[zlib.crc32(b"" if source is None else b"s" + source.encode()) % SOURCES] = 1
    x[SOURCES + zlib.crc32(b"" if lang is None else b"l" + lang.encode()) % LANGS] = 1
    if n_chars is None:
        x[-3] = 1
    else:
        x[-2] = math.log1p(max(0, n_chars)) / 10
        x[-1] = x[-2] ** 2
    return x


def _views(rows: DataFrame) -> DataFrame:
    """The rows' other columns, content and metadata features."""
    keep = [c for c in rows.columns if c not in ("text", "source", "lang", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in slices(b, "text", SLICE_BYTES)):
            a = [content(t) for t in byte_texts(part.column("text"))]
            b = [metadata(*m) for m in zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(a, pa.list_(pa.float64())), pa.array(b, pa.list_(pa.float64()))], names=[*keep, "content", "metadata"])

    return rows.mapInArrow(tidy(run), ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keep) + ", content array<double>, metadata array<double>")


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        self.scale[x.std(axis=0) < 1e-9] = 1e9  # constant features say nothing
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
            size = np.abs(step).max()
            w -= step * min(1.0, 4.0 / max(size, 1e-12))
            if size < 1e-6:
                break
        self.w = w
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -12, 12)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


class CoTrained:
    """Two views that teach each other; views: content and metadata matrices of the labelled rows and the pool."""

    def __init__(self, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS):
        self.constant = float(y.mean()) if len(y) else 0.5
        self.views = None
        kept = np.arange(len(y)) % 3 == 2
        if len(y) < 30 or any(len(set(y[k].tolist())) < 2 for k in (kept, ~kept)):
            return
        share = y[~kept].mean()
        x, targets = [[v[~kept]] for v in labelled], [[y[~kept]], [y[~kept]]]
        free = [np.ones(len(pool[0]), dtype=bool) for _ in (0, 1)]
        each = max(1, len(pool[0]) // (4 * max(1, rounds)))
        for _ in range(rounds):
            views = [Logistic().fit(np.vstack(x[v]), np.concatenate(targets[v])) for v in (0, 1)]
            for v in (0, 1):
                p, other = views[v](pool[v]), 1 - v
                for target, n in ((1, round(each * share)), (0, round(each * (1 - share)))):
                    sure = np.flatnonzero(free[other] & ((p >= 0.9) if target else (p <= 0.1)))
                    pick = sure[np.argsort(-p[sure] if target else p[sure], kind="stable")][:n]
                    free[other][pick] = False
                    x[other].append(pool[other][pick])
                    targets[other].append(np.full(len(pick), float(target)))
        self.views = [Logistic().fit(np.vstack(x[v]), np.concatenate(targets[v])) for v in (0, 1)]
        self.taught = [int(sum(map(len, t[1:]))) for t in targets]
        self.calibrated = [Logistic().fit(self.views[v].margin(labelled[v][kept])[:, None], y[kept]) for v in (0, 1)]
        self.combined = Logistic().fit(np.stack([self.calibrated[v].margin(self.views[v].margin(labelled[v][kept])[:, None]) for v in (0, 1)], axis=1), y[kept])

    def __call__(self, x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of content and metadata, and the combined score."""
        if self.views is None:
            return (np.full(len(x[0]), self.constant),) * 3
        margins = [self.calibrated[v].margin(self.views[v].margin(x[v])[:, None]) for v in (0, 1)]
        return *(1 / (1 + np.exp(-m)) for m in margins), self.combined(np.stack(margins, axis=1))


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *(F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))))


def learned(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS) -> CoTrained:
    labels = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    labels = labels.where(~in_thirds(F.col("__id")))
    part = lambda most, n: min(1.0, most / max(n, 1)) * (1 << 20)
    drawn = labels.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < part(labelled_rows, labels.count()))
    rows = _typed(docs)
    known = _views(rows.join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).drop("__id"))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.struct("content", "metadata")).alias("views"))
    known = known.select("doc_id", "quality", "views.*").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < part(pool_rows, docs.count()))
    pool = _views(some.where("doc_id is not null")).groupBy("doc_id").agg(F.min(F.struct("content", "metadata")).alias("views"))
    pool = pool.select("doc_id", "views.*").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    matrix = lambda table, c, n: np.array(table.column(c).to_pylist(), dtype=float).reshape(-1, n)
    views = lambda table: (matrix(table, "content", N_CONTENT), matrix(table, "metadata", N_META))
    return CoTrained(views(known), known.column("quality").to_numpy().astype(float), views(pool), rounds)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, content_score, metadata_score, score (likelihood of label 1), predicted."""
    frugal(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in (x for b in batches for x in slices(b, "text", SLICE_BYTES)):
            a = np.array([content(t) for t in byte_texts(part.column("text"))])
            b = np.array([metadata(*m) for m in zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, model((a, b)))], names=["doc_id", "content_score", "metadata_score", "score"])

    found = _typed(docs).mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, content_score double, metadata_score double, score double")
    return found.select("doc_id", F.coalesce(in_thirds(F.col("doc_id")), F.lit(False)).alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
