"""Alignment of two tokenizers' tokens over the bytes they share.

A text is encoded by a byte-level BPE (A; a leading space added) and a SentencePiece model (B, which adds that space
itself), so both token sequences spell the same bytes. The tokens of a whole batch are put end to end, each document
behind the last: one bincount of the byte offsets where A's tokens end, one of B's, and where both occur a group ends.
Running sums of these counts, read at the documents' bounds, give each document's numbers, and read at any token's end
the token of the other side that lies there. Every stretch between neighbouring ends belongs to one A and one B token,
so the stretches are the links, without a search.

How many documents hold an id pair is counted over the whole corpus. A document's links need their pairs' counts: the
`COMMON` most frequent pairs (8 bytes and two flags' worth each, whatever the corpus) are sent to all tasks, links of
rarer pairs are joined on the pair. No pair of these is frequent, and counts per A id are as few as A's vocabulary.

A's vocabulary file is a list of merges, whose order is that of the ids; its tokens are found by `tiktoken` with these
ids as ranks (three times faster), or by `tokenizers` where the file's merges have another order or a text has a very
long run without an end. Both give the same ids.

Defined cases: null and empty texts, and texts that the tokens don't spell (a literal U+2581 is a space for B), have no
tokens: zeros and an empty `groups`; a null doc_id is an id like others; each row counts as one document, repeated
ones too; special tokens' strings in a text are plain text; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, slices, stored, tidy

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
COMMON = 500_000
SLICE_BYTES = 1 << 20
#: Distinct pairs that a task holds before it hands them on.
HELD_PAIRS = 1 << 20
#: The pre-tokenizer's pattern (a fixed value of byte-level BPE files that split by their own rule).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_RUN = re.compile(r"\S{400}|\s{400}")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible Latin-1 for itself, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """The A side: ids of a text with a leading space, and each id's bytes."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(spec.decode())
        self.slow.encode_special_tokens = True
        model, letters = json.loads(spec), byte_letters()
        special = {t["content"] for t in model["added_tokens"]}
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.spelling = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.spelling[k] = b"" if token in special else bytes(letters[c] for c in token)
        self.fast = None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        own = model.get("pre_tokenizer") or {}
        ordered = [vocab[a + b] for a, b in pairs]
        if ordered == sorted(ordered) and own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own["add_prefix_space"] and not model.get("normalizer"):
            import tiktoken

            ranks = {s: k for k, s in enumerate(self.spelling) if s}
            if all(bytes([b]) in ranks and ranks[bytes([b])] <= min(ordered, default=1 << 30) for b in range(256)):
                self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        text = " " + text
        if self.fast is not None and not _LONG_RUN.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class Pieces:
    """The B side."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        self.spelling = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() if p.type in (1, 4) else b"" for p in spec.pieces]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.size_a, self.size_b = (np.array([len(s) for s in side.spelling], dtype=np.int64) for side in (self.a, self.b))
        self.width = max(len(self.size_a), len(self.size_b))
        self.shown = np.array([f"{k}{mark}" for mark in ",|;" for k in range(self.width)], dtype=object)

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Both sides' ids and the number of bytes of each text; none where the ids don't spell it."""
        none = np.empty(0, dtype=np.int64)
        some = [k for k, t in enumerate(texts) if t]
        a, b, size = [none] * len(texts), [none] * len(texts), np.zeros(len(texts), dtype=np.int64)
        for k, own_b in zip(some, self.b([texts[k] for k in some]), strict=True):
            own_a, raw = self.a(texts[k]), b" " + texts[k].encode()
            if all(b"".join([side.spelling[i] for i in ids]) == raw for side, ids in ((self.b, own_b), (self.a, own_a.tolist()))):
                a[k], b[k], size[k] = own_a.astype(np.int64), np.array(own_b, dtype=np.int64), len(raw)
        return a, b, size

    def __call__(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """Per text n_a, n_b, n_groups, n_links, groups; pairs (a * size of B + b, sorted) and how often each is linked."""
        own_a, own_b, size = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in own], dtype=np.int64) for own in (own_a, own_b))
        a, b = (np.concatenate([np.empty(0, np.int64), *own]) for own in (own_a, own_b))
        bound = np.concatenate(([0], np.cumsum(size)))  # of documents, in bytes
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at_a, at_b = (np.bincount(end, minlength=int(bound[-1]) + 1) for end in (end_a, end_b))
        both = at_a & at_b
        upto_a, upto_b, upto_both = np.cumsum(at_a), np.cumsum(at_b), np.cumsum(both)
        n_groups = np.diff(upto_both[bound])

        stretch = np.flatnonzero(at_a | at_b)
        link_a, link_b = upto_a[stretch] - at_a[stretch], upto_b[stretch] - at_b[stretch]
        n_links = n_a + n_b - n_groups
        doc = np.repeat(np.arange(len(texts)), n_links)
        space = len(self.size_a) * len(self.size_b)
        pair, times = np.unique(doc * space + a[link_a] * len(self.size_b) + b[link_b], return_counts=True)
        parts = np.searchsorted(pair, np.arange(len(texts) + 1) * space)
        pair %= space
        kind = np.uint32 if space < 2**32 else np.uint64

        # A's tokens of a group stand behind all B tokens of earlier groups, B's behind all A tokens up to their own.
        last = np.flatnonzero(both)
        order = np.empty(len(a) + len(b), dtype=np.int64)
        group_a, group_b = upto_both[end_a] - both[end_a], upto_both[end_b] - both[end_b]
        order[np.arange(len(a)) + np.concatenate(([0], upto_b[last]))[group_a]] = a + self.width * both[end_a]
        order[np.arange(len(b)) + upto_a[last][group_b]] = b + 2 * self.width * both[end_b]
        shown = self.shown[order].tolist()
        to = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(shown[x:y])[:-1] for x, y in zip([0, *to], to, strict=False)]
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups,
            "pairs": [pair[x:y].astype(kind).tobytes() for x, y in zip(parts, parts[1:], strict=False)],
            "times": [times[x:y].astype(np.uint32).tobytes() for x, y in zip(parts, parts[1:], strict=False)],
        }


_HELD: dict[bytes, Aligner] = {}


def _aligner(a: bytes, b: bytes) -> Aligner:
    key = hashlib.sha256(a + b).digest()
    if key not in _HELD:
        _HELD[key] = Aligner(a, b)
    return _HELD[key]


class Alignment:
    """Documents of a table, aligned; the files are read on the driver and sent along (2 MB)."""

    def __init__(self, docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE):
        spark = docs.sparkSession
        frugal(spark)
        files = []
        for name in (a_file, b_file):
            with open(name, "rb") as f:
                files.append(f.read())
        shared = spark.sparkContext.broadcast(tuple(files))
        aligner = _aligner(*files)
        self.n_b, self.kind = len(aligner.size_b), np.uint32 if len(aligner.size_a) * len(aligner.size_b) < 2**32 else np.uint64
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
            ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()),
        ])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            align = _aligner(*shared.value)
            for part in (x for batch in batches for x in slices(batch, "text", SLICE_BYTES)):
                found = align(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[f.name], f.type) for f in schema if f.name != "doc_id")], schema=schema)

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        #: doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`), pairs and times (packed).
        self.rows = rows.mapInArrow(tidy(run), "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, times binary")

    def counts(self, rows: DataFrame) -> DataFrame:
        """pair, a, b, n_docs (documents of rows that hold the pair linked) and best (whether that is the highest of its a)."""
        kind, n_b = self.kind, self.n_b

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            size = 0

            def summed() -> pa.RecordBatch:
                pair, n = np.unique(np.concatenate([np.empty(0, kind), *held]), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], names=["pair", "n"])

            for batch in batches:
                for blob in batch.column("pairs").to_pylist():
                    held.append(np.frombuffer(blob, dtype=kind))
                    size += len(held[-1])
                    if size >= HELD_PAIRS:
                        yield summed()
                        held, size = [], 0
            yield summed()

        n = rows.select("pairs").mapInArrow(tidy(distinct), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n_docs"))
        n = stored(n.select("pair", F.expr(f"cast(pair div {n_b} as int)").alias("a"), F.expr(f"cast(pair % {n_b} as int)").alias("b"), "n_docs"))
        highest = n.groupBy("a").agg(F.max("n_docs").alias("highest"))  # as many rows as A has ids at most
        return n.join(F.broadcast(highest), "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def _least(counts: DataFrame, most: int) -> float:
    """The least n_docs of what is sent to all tasks: pairs with it or more are `most` at most."""
    size = F.floor(F.log2("n_docs") * 16).cast("int").alias("size")  # a thousand sizes at most
    room, least = most, float("inf")
    for r in sorted(counts.groupBy(size).agg(F.count("*").alias("n"), F.min("n_docs").alias("least")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["least"]
    return least


def alignment(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, common: int = COMMON) -> DataFrame:
    """Per document row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    own = Alignment(docs, a_file, b_file)
    kind = own.kind
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256)).alias("groups_sha256")
    rows = stored(own.rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    counts = stored(own.counts(rows))
    least = _least(counts, common)
    table = counts.where(F.col("n_docs") >= least).select("pair", "n_docs", "best").toArrow()
    pair, n_docs, best = (table.column(k).to_numpy() for k in range(3))
    order = np.argsort(pair)
    shared = docs.sparkSession.sparkContext.broadcast((pair[order].astype(kind), n_docs[order], best[order].astype(np.int64)))

    def links(batch: pa.RecordBatch):
        """Row of each pair, the pair, how often it is linked, its place in the table, whether it is there."""
        pairs, n = shared.value[0], np.array([len(x) // np.dtype(kind).itemsize for x in batch.column("pairs").to_pylist()], dtype=np.int64)
        own = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), dtype=kind)
        times = np.frombuffer(b"".join(batch.column("times").to_pylist()), dtype=np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
        there = pairs[at] == own if len(pairs) else np.zeros(len(own), dtype=bool)
        return np.repeat(np.arange(len(n)), n), own, times, at, there

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n_docs, best = shared.value
        for part in (x for batch in batches for x in slices(batch, "pairs", SLICE_BYTES)):
            row, _, times, at, there = links(part)
            first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(part)))))
            sums = []
            for worth in (best, n_docs):
                upto = np.concatenate(([0], np.cumsum(np.where(there, times * worth[at], 0) if len(worth) else times * 0)))
                sums.append(pa.array(np.diff(upto[first])))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *sums], names=[*kept, "n_best", "count_sum"])

    def rarer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, "pairs", SLICE_BYTES)):
            row, own, times, _, there = links(part)
            yield pa.RecordBatch.from_arrays([pa.array(part.column("row").to_numpy()[row[~there]]), pa.array(own[~there].astype(np.int64)), pa.array(times[~there])], names=["row", "pair", "times"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    typed = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    whole = rows.mapInArrow(tidy(summed), f"{typed}, n_best bigint, count_sum bigint")
    rest = rows.select("row", "pairs", "times").mapInArrow(tidy(rarer), "row bigint, pair bigint, times bigint")
    rest = rest.join(counts.where(F.col("n_docs") < least).select("pair", "n_docs", "best"), "pair")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"))
    plus = lambda x, more: (F.col(x) + F.coalesce(F.col(more), F.lit(0))).alias(x)
    return whole.join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")


def groups_of(groups: Column) -> Column:
    """The groups as an array of structs of ids: a array<int>, b array<int>."""
    ids = lambda x: F.transform(F.split(x, ","), lambda k: k.cast("int"))
    each = F.transform(F.split(groups, ";"), lambda g: F.struct(ids(F.split_part(g, F.lit("|"), F.lit(1))).alias("a"), ids(F.split_part(g, F.lit("|"), F.lit(2))).alias("b")))
    return F.when(groups == "", F.array().cast("array<struct<a:array<int>,b:array<int>>>")).otherwise(each)
