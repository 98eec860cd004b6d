"""Language identification with spans: script ranges, per-word scores, Viterbi with a switching penalty.

Learning counts, per language, words' letter trigrams (with word ends), whole words and the scripts used, on a
bounded sample of labelled rows (`SAMPLE_ROWS` per language, chosen by hash of the id). A word's script leaves the
languages that use it as candidates; each scores the log likelihood of the word's trigrams and of the word itself.
Over the words of a text, Viterbi finds the labelling with the highest sum of scores less a penalty per switch, so
texts of several languages split into spans. The language with the most letters is the prediction; the share of
letters in its spans, times how clearly its words speak for it, is the score.

A letter is a character of a Unicode category L; digits, fractions and numerals of other scripts are none.

Defined cases: null, empty or letterless texts give `und`, score 0 and no spans; so do all texts if nothing could be
learned; rows with a null doc_id are scored but not learned from (held_out false); rows with null lang teach nothing;
ties go to the language first in order of name; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, gathered, in_thirds, tidy

#: Rows of a language that are learned from, about; their trigrams and words that occur twice at least.
SAMPLE_ROWS = 600
SWITCH = 12.0
#: Texts that go through Viterbi in step: the more, the fewer steps in all.
SLICE_BYTES = 4 << 20
CACHED_WORDS = 400_000
NO = -1e6

#: First and last code points of the scripts told apart; letters elsewhere count as "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
_NAMES = [*SCRIPTS, "other"]
_STARTS, _ENDS, _OF = (np.array(x) for x in zip(*sorted((a, b, k) for k, name in enumerate(SCRIPTS) for a, b in SCRIPTS[name]), strict=True))
#: What counts as alphanumeric but is no letter, within and beyond the basic plane; the latter is rare and taken out first.
_ODD = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L"]
_WORD = re.compile(rf"[^\W\d_{''.join(c for c in _ODD if c <= '\uffff')}]+")
_FAR = dict.fromkeys((ord(c) for c in _ODD if c > "\uffff"), " ")


def script_of(word: str) -> int:
    """The script of a word's first letter."""
    code = ord(word[0])
    k = int(np.searchsorted(_STARTS, code, side="right")) - 1
    return int(_OF[k]) if k >= 0 and code <= _ENDS[k] else len(SCRIPTS)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    if not text.isascii() and max(text) > "\uffff":
        text = text.translate(_FAR)
    return _WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """Letter trigrams with word ends, and the word itself behind a space."""
    ends = f"<{word}>"
    return [ends[k : k + 3] for k in range(len(ends) - 2)] + [" " + word]


def counts(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang, feature, n over the sample; features "#script" count words by script."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~in_thirds(F.col("doc_id"))).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for lang, n in size.items() for x in (lang, min(1.0, sample_rows / n))]) if size else F.create_map(F.lit(""), F.lit(1.0))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = found.setdefault(lang, Counter())
                for word, n in Counter(words_of(text)).items():
                    for f in features(word):
                        own[f] += n
                    own[f"#{script_of(word)}"] += n
            flat = [(lang, f, n) for lang, own in found.items() for f, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "feature", "n"])

    return drawn.mapInArrow(tidy(count), "lang string, feature string, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, rows: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        at = {lang: k for k, lang in enumerate(self.langs)}
        self.scripts = np.zeros((len(_NAMES), len(self.langs)))
        held: dict[str, np.ndarray] = {}
        for lang, feature, n in rows:
            if feature[0] == "#":
                self.scripts[int(feature[1:]), at[lang]] += n
            else:
                held.setdefault(feature, np.zeros(len(self.langs)))[at[lang]] += n
        # A language uses a script in which one of 200 of its words is written; scripts that none uses leave all.
        uses = self.scripts >= 0.005 * self.scripts.sum(axis=0, keepdims=True)
        uses[~uses.any(axis=1)] = True
        self.barred = np.where(uses, 0.0, NO)
        self.logs: dict[str, np.ndarray] = {}
        for kind in (True, False):
            names = [f for f in held if (f[0] == " ") == kind]
            if names:
                table = np.array([held[f] for f in names])
                smooth = 0.5
                logs = np.log(table + smooth) - np.log(table.sum(axis=0) + smooth * len(names))
                self.logs |= {f: row * (0.7 if kind else 0.5) for f, row in zip(names, logs, strict=True)}
                if not kind:
                    self.unseen = 0.5 * (np.log(smooth) - np.log(table.sum(axis=0) + smooth * len(names)))

    def score(self, word: str) -> np.ndarray:
        total = self.barred[script_of(word)].copy()
        known = self.logs.get
        *grams, whole = features(word)
        for g in grams:
            total += known(g, self.unseen)
        if (own := known(whole)) is not None:
            total += own
        return total - total.max()


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of the words (rows of scores) of texts that begin at starts, all texts in step."""
    n_words, n_langs = scores.shape
    sizes = np.diff(np.append(starts, n_words))
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[order], sizes[order]
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")
    best = np.zeros(n_words, dtype=np.int32)  # before each word
    moved = np.zeros((n_words, n_langs), dtype=bool)
    value = np.zeros((len(order), n_langs))
    for t, n in enumerate(active.tolist()):
        at = begin[:n] + t
        now = value[:n]
        if t:
            top = now.argmax(axis=1)
            fresh = (now[np.arange(n), top] - switch)[:, None]
            best[at] = top
            moved[at] = now < fresh
            np.maximum(now, fresh, out=now)
        now += scores[at]
    labels = np.zeros(n_words, dtype=np.int32)
    last = value.argmax(axis=1).astype(np.int32)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = begin[:n] + t
        labels[at] = last[:n]
        if t:
            last[:n] = np.where(moved[at, last[:n]], best[at], last[:n])
    return labels


class Labeller:
    """Labels texts with a model; keeps the scores of words it has met."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.known: dict[str, int] = {}
        self.rows = np.empty((1024, len(model.langs)))

    def __call__(self, texts: list[str | None], spans: bool) -> list[tuple[str, float, list[dict]]]:
        und = ("und", 0.0, [])
        if not self.model.langs:
            return [und for _ in texts]
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        held, words = [], []
        for text in texts:
            own = words_of(text) if text else []
            held.append(len(words))
            words += own
        if not words:
            return [und for _ in texts]
        known = self.known
        for w in set(words).difference(known):
            if len(known) == len(self.rows):
                self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
            self.rows[len(known)] = self.model.score(w)
            known[w] = len(known)
        codes = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        scores = self.rows[codes]
        letters = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.array(held)
        full = np.flatnonzero(np.diff(np.append(starts, len(words))) > 0)
        labels = viterbi(scores, starts[full], self.switch)
        n_langs = len(self.model.langs)
        doc = np.repeat(np.arange(len(full)), np.diff(np.append(starts[full], len(words))))
        share = np.bincount(doc * n_langs + labels, weights=letters, minlength=len(full) * n_langs).reshape(-1, n_langs)
        # How clearly the words speak: the chance, by their mean score, against each other language.
        mean = np.stack([np.bincount(doc, weights=np.maximum(scores[:, k], -30.0), minlength=len(full)) for k in range(n_langs)], axis=1)
        mean = np.exp(mean - mean.max(axis=1, keepdims=True))
        mean /= mean.sum(axis=1, keepdims=True)
        pick = share.argmax(axis=1)
        sure = share[np.arange(len(full)), pick] / share.sum(axis=1)
        sure *= np.maximum(mean[np.arange(len(full)), pick], 0.5)
        out = [und for _ in texts]
        ends = np.append(starts[full][1:], len(words))
        for k, at in enumerate(full.tolist()):
            found = []
            if spans:
                own = labels[starts[at] : ends[k]]
                cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                found = [{"lang": self.model.langs[own[a]], "first": a, "last": b - 1} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            out[at] = (self.model.langs[pick[k]], float(sure[k]), found)
        return out


def learned(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    rows = counts(docs, sample_rows).where(F.col("feature").startswith("#") | (F.col("n") >= 2)).toArrow()
    return Model(list(zip(*(rows.column(c).to_pylist() for c in ("lang", "feature", "n")), strict=True)))


def identified(docs: DataFrame, model: Model, spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """Per document row: doc_id, lang_pred, score, spans (lang, and the first and last word of each, from 0)."""
    frugal(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(shared.value, switch)
        for part in gathered(batches, "text", SLICE_BYTES):
            found = label(part.column("text").to_pylist(), spans)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], kind)], names=["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, spans array<struct<lang:string,first:bigint,last:bigint>>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(in_thirds(doc_id), F.lit(False))


def language_of(docs: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans, learned from and applied to docs."""
    found = identified(docs, learned(docs), spans)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
