"""Benchmark decontamination over a distributed positional inverted index.

`positional_index` cuts documents into shards of a bounded size and stores, per shard, every term with its positions
(its postings). It doesn't depend on a test set, so one index serves many. `phrase_hits` intersects offset-adjusted
postings, from the test term that is rarest in the shard on, and so finds the exact phrases; `near_hits` finds all
terms of a phrase within a span of words. Shards follow the documents, so no posting is shuffled and a common term,
source or copied text spreads over all shards.

A test set is taken in passes of `ITEM_BYTES` of text over the index, one or many by the same plan: a pass returns
the spans of documents with hits only, and the passes' spans are joined per document before words are counted.

Defined cases: a null or empty text has no words and no hits; null doc_id rows keep a row each; repeated rows
give repeated rows; an empty test set gives no hits; columns besides those named are ignored, in
`without_contaminated` kept. Items without words have no window. A repeated item_id counts once; a null one counts
as the id ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import ALNUM, byte_texts, discard, frugal, slices, stored, tidy

WINDOW = 10
#: Bytes of item text that one pass over the index handles (its windows take about 20 times that on the driver and in a worker).
ITEM_BYTES = 2 << 20
#: Bytes of text in a shard, one document at least.
SHARD_BYTES = 4 << 20

INDEX = pa.schema([("shard", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("text_key", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("sizes", pa.binary()), ("postings", pa.binary())])
HITS = "shard bigint, row_no int, starts array<int>, ends array<int>, item_ids array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of digits, letters and what is not ASCII, A-Z in lower case."""
    return text.translate(ALNUM).split() if text else []


class Phrases:
    """Windows of a test set by length: rows of term ids, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name or "" for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        held: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], dtype=np.int32)
            if len(ids):
                rows = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                held.setdefault(rows.shape[1], []).append((rows, number[name or ""]))
        self.by_length = []
        for length in sorted(held):
            rows, which = np.unique(np.concatenate([r for r, _ in held[length]]), axis=0, return_inverse=True)
            owner = np.repeat([k for _, k in held[length]], [len(r) for r, _ in held[length]])
            pairs = np.unique(np.stack([which.reshape(-1), owner]), axis=1)
            self.by_length.append((rows, np.split(pairs[1], np.flatnonzero(np.diff(pairs[0])) + 1)))


def positional_index(docs: DataFrame) -> DataFrame:
    """A stored table with a row per shard: its documents; its terms, their sizes and their postings, packed."""
    frugal(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for part in (x for batch in batches for x in slices(batch, "text", SHARD_BYTES)):
            vocabulary: dict[bytes, int] = {}
            lengths, codes = [], []
            for text in byte_texts(part.column("text")):
                words = words_of(text)
                lengths.append(len(words))
                codes += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                codes.append(-1)  # no phrase runs from one document into the next
            codes = np.array(codes, dtype=np.int32)
            order = np.argsort(codes, kind="stable").astype(np.int32)[len(lengths) :]
            sizes = np.bincount(codes[codes >= 0], minlength=len(vocabulary)).astype(np.int32)
            columns = [[shard], [part.column("doc_id").to_pylist()], [part.column("text_key").to_pylist()], [lengths], [b" ".join(vocabulary)], [sizes.tobytes()], [order.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, INDEX.types, strict=True)], schema=INDEX)
            shard += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    return stored(rows.mapInArrow(tidy(build), "shard bigint, doc_id array<bigint>, text_key array<bigint>, n_words array<int>, terms binary, sizes binary, postings binary"))


class Shard:
    """One shard opened for a test set: sizes and postings by the test set's term ids."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int]):
        self.lengths = np.array(row["n_words"], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)))
        sizes = np.frombuffer(row["sizes"], dtype=np.int32)
        begins = np.cumsum(sizes) - sizes
        self.size, self.begin = (np.zeros(len(vocabulary), dtype=np.int64) for _ in (0, 1))
        if row["terms"]:
            ids = [vocabulary.get(w, -1) for w in row["terms"].split(b" ")]
            ids = np.array(ids)
            met = ids >= 0
            self.size[ids[met]], self.begin[ids[met]] = sizes[met], begins[met]
        self.places = np.frombuffer(row["postings"], dtype=np.int32)

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.begin[term] : self.begin[term] + self.size[term]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase: offset-adjusted postings, intersected from the rarest term on."""
        order = np.argsort(self.size[terms], kind="stable")
        starts = self.postings(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            other = self.postings(terms[k])
            at = np.searchsorted(other, starts + k)
            at[at == len(other)] = 0
            starts = starts[other[at] == starts + k]
        return starts

    def near(self, terms: np.ndarray, span: int) -> list[tuple[int, int]]:
        """First and last places of the smallest stretches of at most `span` words with all the terms."""
        distinct = np.unique(terms)
        rare = distinct[np.argmin(self.size[distinct])]
        found = set()
        for place in self.postings(rare).tolist():
            doc = np.searchsorted(self.starts, place, side="right") - 1
            low, high = max(place - span + 1, int(self.starts[doc])), min(place + span, int(self.starts[doc + 1]) - 1)
            hits = []
            for term in distinct:
                own = self.postings(term)
                hits += [(int(x), int(term)) for x in own[np.searchsorted(own, low) : np.searchsorted(own, high)]]
            hits.sort()
            seen: dict[int, int] = {}
            for at, term in hits:
                seen[term] = at
                if len(seen) == len(distinct) and at - (first := min(seen.values())) < span and first <= place <= at:
                    found.add((first, at))
        return sorted(found)


def _probe(index: DataFrame, phrases: Phrases, schema: str, match) -> DataFrame:
    """match(row, shard, phrases) over the index's shards, as rows of the schema."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("shard", "doc_id", "n_words", "terms", "sizes", "postings")}
                yield match(row, Shard(row, shared.value.vocabulary), shared.value)

    return index.mapInArrow(tidy(probe), schema)


def _spans_in(row: dict, shard: Shard, phrases: Phrases) -> pa.RecordBatch:
    """Of the documents with hits: their place in the shard, the spans of words that are hit, and items."""
    rows, starts, ends, names = [], [], [], []
    found: list[tuple[np.ndarray, int]] = []
    held: dict[int, set[int]] = {}
    for windows, holders in phrases.by_length:
        for w in np.flatnonzero(shard.size[windows].min(axis=1) > 0):
            if len(at := shard.phrase(windows[w])):
                found.append((at, windows.shape[1]))
                for doc in np.unique(np.searchsorted(shard.starts, at, side="right") - 1).tolist():
                    held.setdefault(doc, set()).update(holders[w].tolist())
    if found:
        begin = np.concatenate([at for at, _ in found])
        end = begin + np.repeat([n for _, n in found], [len(at) for at, _ in found])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        # Spans that overlap or touch are one; between documents there is always a gap.
        first = np.flatnonzero(np.concatenate(([True], begin[1:] > np.maximum.accumulate(end)[:-1])))
        begin, end = begin[first], np.maximum.reduceat(end, first)
        doc = np.searchsorted(shard.starts, begin, side="right") - 1
        rows, cuts = np.unique(doc, return_index=True)
        rows = rows.tolist()
        starts, ends = np.split(begin - shard.starts[doc], cuts[1:]), np.split(end - shard.starts[doc], cuts[1:])
        names = [[phrases.names[x] for x in sorted(held[d])] for d in rows]
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(rows), pa.int64()), pa.array(rows, pa.int32()), pa.array(starts, ints), pa.array(ends, ints), pa.array(names, pa.list_(pa.string()))], names=["shard", "row_no", "starts", "ends", "item_ids"])


def near_hits(index: DataFrame, items: list[tuple[str, str]], span: int) -> DataFrame:
    """Documents with all words of an item (any order) within `span` words: doc_id, item_id, first, last.

    For a stated, short list of items; first and last count the document's words from 0.
    """
    held = [(name, text.encode()) for name, text in items]
    phrases = Phrases(held, max([1, *(len(words_of(t)) for _, t in held)]))

    def match(row: dict, shard: Shard, phrases: Phrases) -> pa.RecordBatch:
        rows = []
        for windows, holders in phrases.by_length:
            for w in np.flatnonzero(shard.size[windows].min(axis=1) > 0):
                for first, last in shard.near(windows[w], span):
                    doc = int(np.searchsorted(shard.starts, first, side="right") - 1)
                    rows += [(row["doc_id"][doc], phrases.names[x], first - int(shard.starts[doc]), last - int(shard.starts[doc])) for x in holders[w]]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "first", "last"])

    return _probe(index, phrases, "doc_id bigint, item_id string, first bigint, last bigint", match)


def _passes(index: DataFrame, items: DataFrame, window: int, item_bytes: int) -> DataFrame:
    """Per document with hits: shard, row_no, spans (sorted), item_ids."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(size // item_bytes) + 1
    chunk = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    union = None
    for k in range(passes):
        phrases = Phrases([(r.item_id, r.text and r.text.encode()) for r in items.where(chunk == k).collect()], window)
        one = _probe(index, phrases, HITS, _spans_in)
        union = one if union is None else union.unionByName(one)
    spans = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    return union.groupBy("shard", "row_no").agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))


def _documents(index: DataFrame) -> DataFrame:
    """shard, row_no, doc_id, text_key, n_words of the index's documents."""
    return index.select("shard", F.posexplode(F.arrays_zip("doc_id", "text_key", "n_words")).alias("row_no", "d")).select("shard", "row_no", "d.*")


def phrase_hits(index: DataFrame, items: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Per document row of the index: doc_id, text_key (hash of its text), n_words, n_hit, item_ids of the items found."""
    found = _documents(index).join(_passes(index, items, window, item_bytes), ["shard", "row_no"], "left")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["ends"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["ends"] - F.greatest(s["starts"], a["upto"]))).alias("n")),
        lambda a: a["n"],
    )
    names = F.coalesce(F.sort_array("item_ids"), F.array().cast("array<string>"))
    return found.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"), names.alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    hits = phrase_hits(positional_index(docs), items, window)
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without those that hold a window of an item."""
    index = positional_index(docs)
    hit = _documents(index).join(_passes(index, items, window, ITEM_BYTES), ["shard", "row_no"])
    hit = stored(hit.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    discard(index)
    same = F.col("doc_id").cast("long").eqNullSafe(hit["__id"]) & (F.xxhash64(F.col("text").cast("string")) == hit["__key"])
    return docs.join(hit, same, "left_anti")
