"""Quality rules: decision lists learned by sequential covering, written as ordered Spark conditions.

Per text some statistics are counted (words, repetition, symbols, kinds of characters); their ratios are the terms of
rules. A rule is a conjunction of thresholds. It grows on two thirds of the rows not yet covered, one condition at a
time, each the one of all terms and thresholds with the most gain of information for the rows to be dropped, until no
other row is left in it; on the last third, conditions are cut off from its end as long as that makes it no worse. Rules are
added until the next one isn't reliable there; what they cover is taken out in between. The list, in its order, is a
`CASE WHEN` over the statistics' columns: rows that meet a rule's conditions are dropped, the rest is kept. Before the
list stands a fixed base check (`base_failed`), and rows that fail it don't teach.

Only labelled rows that aren't held out teach, `SAMPLE_ROWS` ids at most by hash of the id; that is the one bound, and
statistics are counted over every whole text.

Defined cases: a null or empty text has statistics of zero and fails the base check; a null doc_id gets its row like
others and never teaches; repeated rows get a row each, and an id that documents or labels repeat teaches once (its least
statistics, its least label); without labels, or with one class only, no rule is learned and the base check decides alone;
extra columns are ignored, and in `filtered` kept; statistics that clash with columns of documents don't touch them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import byte_texts, frugal, in_thirds, returned

SAMPLE_ROWS = 8000
#: A rule's share of rows to be dropped on the rows that prune it, at least, and the rows it must cover there.
RELIABLE, LEAST_ROWS = 0.9, 3
MOST_RULES, MOST_CONDITIONS = 24, 6
#: The base check's numbers.
FEWEST_WORDS, MOST_REPEATED = 50, 50

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_digits", "n_marks", "n_most_common", "n_short_lines"]
_PER = {
    "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "duplicate_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"), "capitals": ("n_capitals", "word_chars"), "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"),
    "most_common_word": ("n_most_common", "n_words"), "short_lines": ("n_short_lines", "n_lines"), "words_per_line": ("n_words", "n_lines"),
}
TERMS = [*_PER, "words"]
_SYMBOLS, _CAPITALS, _DIGITS, _MARKS, _BLANK = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?.,;:-\"'()", b" \t\n\r\x0b\x0c"
_AFTER = bytes(range(0x80, 0xC0))  # bytes within a code point


def _count(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def repeated(codes: np.ndarray, n: int = 3) -> int:
    """Words in windows of n words that occur twice or more; codes: a number below its length for each word."""
    if len(codes) <= n:
        return 0
    window = codes[: len(codes) - n + 1]
    for k in range(1, n):
        window = np.unique(window * (len(codes) + 1) + codes[k : len(codes) - n + 1 + k], return_inverse=True)[1]
    often = np.flatnonzero(np.bincount(window)[window] > 1)
    inside = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(inside, often, 1)
    np.add.at(inside, often + n, -1)
    return int((np.cumsum(inside) > 0).sum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The `STATISTICS` of a text in UTF-8."""
    words = text.split() if text else []
    if not words:
        return (0,) * len(STATISTICS)
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return (
        len(words), len(text.translate(None, _BLANK + _AFTER)), _count(text, _SYMBOLS), len(lines) - len(set(lines)), repeated(codes), len(lines), len(known),
        _count(text, _CAPITALS), _count(text, _DIGITS), _count(text, _MARKS), int(np.bincount(codes).max()), sum(len(x) < 30 for x in lines),
    )


def counted(text: Column) -> Column:
    """A struct of the `STATISTICS` of each text."""

    @F.arrow_udf(", ".join(f"{name} bigint" for name in STATISTICS))
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([statistics(t) for t in byte_texts(texts)], dtype=np.int64).reshape(-1, len(STATISTICS))
            yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATISTICS))], names=STATISTICS)
        returned()

    return stats(text.cast("string"))


def term(name: str, of: str) -> Column:
    """A term's value from the struct of statistics in column `of`."""
    if name == "words":
        return F.col(f"{of}.n_words").cast("double")
    over, under = _PER[name]
    return F.col(f"{of}.{over}") / F.greatest(F.col(f"{of}.{under}"), F.lit(1))


def failed(of: str) -> Column:
    """The base check: too few words, or too many of them in repeated windows."""
    n = F.col(f"{of}.n_words")
    return (n < FEWEST_WORDS) | (100 * F.col(f"{of}.n_repeat_words") > MOST_REPEATED * n)


@dataclass(frozen=True)
class Condition:
    term: str
    above: bool
    bound: float

    def __str__(self) -> str:
        return f"{self.term} {'>' if self.above else '<='} {self.bound:.6g}"

    def column(self, of: str) -> Column:
        value = term(self.term, of)
        return value > self.bound if self.above else value <= self.bound

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, TERMS.index(self.term)]
        return value > self.bound if self.above else value <= self.bound


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def best_condition(x: np.ndarray, y: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold on one term with the most gain for the rows y, p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0)))."""
    p0, before = y.sum(), np.log2(max(y.mean(), 1e-12))
    best: tuple[float, Condition | None] = (1e-9, None)
    for j, name in enumerate(TERMS):
        order = np.argsort(x[:, j], kind="stable")
        value, positive = x[order, j], np.cumsum(y[order])
        cut = np.flatnonzero(value[1:] > value[:-1])  # the last row at or below the bound
        if not len(cut):
            continue
        bound = (value[cut] + value[cut + 1]) / 2
        for above in (False, True):
            p = p0 - positive[cut] if above else positive[cut]
            total = len(y) - cut - 1 if above else cut + 1
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / total) - before), -1.0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), Condition(name, above, float(bound[k])))
    return best


def grown(x: np.ndarray, y: np.ndarray) -> Rule:
    rule: Rule = ()
    while len(y) and not y.all() and len(rule) < MOST_CONDITIONS:
        _, condition = best_condition(x, y)
        if condition is None:
            break
        rule += (condition,)
        inside = condition.holds(x)
        x, y = x[inside], y[inside]
    return rule


def pruned(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The rule without the conditions at its end that (p - n) / (p + n) doesn't need."""
    worth = []
    for k in range(1, len(rule) + 1):
        inside = covered(rule[:k], x)
        worth.append(2 * y[inside].mean() - 1 if inside.any() else -1.0)
    return rule[: int(np.argmax(worth)) + 1] if worth else rule


def learned_rules(x: np.ndarray, y: np.ndarray, reliable: float = RELIABLE, least_rows: int = LEAST_ROWS) -> list[Rule]:
    """The ordered rules for the rows where y is true; x has the `TERMS` in columns. Rows are dealt by their order."""
    rules: list[Rule] = []
    prunes = np.arange(len(y)) % 3 == 2
    while len(rules) < MOST_RULES and y[~prunes].any() and not y.all():
        rule = pruned(grown(x[~prunes], y[~prunes]), x[prunes], y[prunes])
        inside = covered(rule, x[prunes])
        if not rule or inside.sum() < least_rows or y[prunes][inside].mean() < reliable:
            break
        rules.append(rule)
        left = ~covered(rule, x)
        x, y, prunes = x[left], y[left], prunes[left]
    return rules


def learned(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, reliable: float = RELIABLE) -> list[Rule]:
    """Rules for documents of quality 0, from labels' rows that aren't held out."""
    labels = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    labels = labels.where(~in_thirds(F.col("__id")))
    drawn = labels.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < min(1.0, sample_rows / max(labels.count(), 1)) * (1 << 20))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))
    rows = rows.select("doc_id", "quality", counted(F.col("text")).alias("s")).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("s").alias("s"))
    rows = rows.where(~failed("s")).orderBy(F.xxhash64("doc_id"), "doc_id").select("quality", *(term(t, "s").alias(t) for t in TERMS)).toArrow()
    x = np.array([rows.column(t).to_numpy() for t in TERMS], dtype=float).reshape(len(TERMS), -1).T
    return learned_rules(x, rows.column("quality").to_numpy() == 0, reliable)


def verdict(rules: list[Rule], of: str) -> Column:
    """The number (from 1) of the first rule that a row's statistics meet, or null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        met = F.lit(True)
        for c in rules[k - 1]:
            met = met & c.column(of)
        out = F.when(met, F.lit(k)).otherwise(out)
    return out


def rated(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with __s (statistics), __failed and __rule."""
    frugal(docs.sparkSession)
    return docs.withColumn("__s", counted(F.col("text"))).withColumns({"__failed": failed("__s"), "__rule": verdict(rules, "__s")})


def decisions(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and rule (its text, where one dropped the row)."""
    frugal(docs.sparkSession)
    rules = learned(docs, labels, sample_rows)
    texts = F.array(*(F.lit(" and ".join(map(str, r))) for r in rules)) if rules else F.array().cast("array<string>")
    found = rated(docs.select("doc_id", "text"), rules)
    rule = F.when(~F.col("__failed"), F.get(texts, F.col("__rule") - 1))
    return found.select("doc_id", *(f"__s.{s}" for s in STATISTICS[:5]), F.col("__failed").alias("base_failed"), (~F.col("__failed") & F.col("__rule").isNull()).alias("kept"), rule.alias("rule"))


def filtered(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, all columns, that pass the base check and meet no rule."""
    return rated(docs, learned(docs, labels, sample_rows)).where(~F.col("__failed") & F.col("__rule").isNull()).drop("__s", "__failed", "__rule")
