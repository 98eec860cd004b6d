"""SentencePiece BPE encoding with seeded merge-dropout, and its lossless decoding.

The model file (a path, read on the driver and sent along: half a megabyte) gives pieces and scores. A text becomes
"▁" and itself with spaces as "▁"; its characters are the first symbols. The agenda holds, for neighbouring symbols
that make a piece, the candidate merges by score, then place. A candidate is skipped where a hash keyed by the seed,
the variant, the run of letters and the candidate's bounds falls below the rate. With rate 0 the result is the plain
encoding of the model. Pieces never reach past a word's end, so texts are taken word by word, equal words of a
variant once per batch (with the default, every occurrence is one of its own); all words of a batch process their agendas in step. The variant of a word follows from the
seed, the doc_id and the word's place in the text.

What no piece spells is written in byte pieces, and so is a literal "▁" (else it would come back as a space):
decoding gives back every text exactly.

Defined cases: a null text has null ids (n_tokens 0, lossless true); an empty one has none; rows with a null doc_id
are encoded as if it were 0; repeated rows have equal ids; other columns are kept by `encoded` or ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, mixed, slices, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE = 0.1
SEED = 20240501
#: Ways in which one word may come out in a corpus: as many as it has occurrences, for what a hash is worth.
VARIANTS = 1 << 30
SLICE_BYTES = 3 << 20
WORDS_AT_ONCE = 40_000
#: Longer runs without a word end go through a heap of their own.
LONG = 48
SPACE = "▁"
LITERAL = "\ud800"
NONE = np.int64(1) << 40
_U64 = np.uint64


class Pieces:
    """The model's vocabulary as symbols and merges."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        self.text = [p.piece for p in spec.pieces]
        self.bytes = np.full(256, -1, dtype=np.int64)
        self.normal: dict[str, int] = {}
        for k, p in enumerate(spec.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = k
            elif p.type in (1, 4):
                self.normal[p.piece] = k
        if (self.bytes < 0).any() or spec.normalizer_spec.name != "identity" or not spec.normalizer_spec.add_dummy_prefix:
            raise ValueError("a BPE model with byte pieces, the identity normalizer and a leading space is needed")
        self.symbols = dict(self.normal)
        for c in sorted({c for p in self.normal for c in p}):
            self.symbols.setdefault(c, len(self.text) + len(self.symbols))
        self.by_words = not any(SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1 for p in self.normal)
        self.base = max(self.symbols.values()) + 1  # unknown characters come after
        self.of = self.base + np.arange(0x110000, dtype=np.int64)
        for c, k in self.symbols.items():
            if len(c) == 1:
                self.of[ord(c)] = k
        scores = sorted({-p.score for p in spec.pieces})
        rank = {s: k for k, s in enumerate(scores)}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, k in self.normal.items():
            for cut in range(1, len(piece)):
                a, b = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank[-spec.pieces[k].score], k)
        self.pairs = pairs
        self.bits = 19
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, NONE, dtype=np.int64)
        self.merged = np.zeros(1 << self.bits, dtype=np.int64)
        for (a, b), (r, k) in pairs.items():
            key = (a << 24) | b
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.rank[at], self.merged[at] = key, r, k
        filled = self.keys >= 0
        run = most = 0
        for f in filled.tolist():
            run = run + 1 if f else 0
            most = max(most, run)
        self.probes = most + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _U64(0x9E3779B97F4A7C15)) >> _U64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such piece) and piece of each pair."""
        keys = (a << 24) | b
        at = self._slot(keys)
        rank = np.full(len(keys), NONE, dtype=np.int64)
        piece = np.zeros(len(keys), dtype=np.int64)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == keys[left]
            rank[left[hit]], piece[left[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            on = ~hit & (found >= 0)
            if not on.any():
                break
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return rank, piece


class Encoder:
    def __init__(self, pieces: Pieces, rate: float = RATE, seed: int = SEED, variants: int = VARIANTS):
        self.pieces, self.rate, self.seed, self.variants = pieces, rate, seed, max(1, variants)
        self.cut = _U64(min(int(rate * 2**64), 2**64 - 1))
        self.split = re.compile(rf"\n+|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if pieces.by_words else r"(?s).+")

    def skipped(self, key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.rate <= 0:
            return np.zeros(len(key), dtype=bool)
        bounds = start.astype(np.uint64) * _U64(0xD6E8FEB86659FD93) + middle.astype(np.uint64) * _U64(0xA0761D6478BD642F) + end.astype(np.uint64) * _U64(0xE7037ED1A0B428DB)
        return mixed(key ^ bounds) < self.cut

    def words(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.pieces.of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        done_word, done_at, done_sym = [], [], []
        ends = np.cumsum(sizes)
        for w in np.flatnonzero(sizes > LONG).tolist():
            own_sym, own_at = self._long(sym[ends[w] - sizes[w] : ends[w]], keys[w])
            done_sym.append(own_sym)
            done_at.append(own_at)
            done_word.append(np.full(len(own_sym), w))
        word = np.repeat(np.arange(len(words)), sizes)
        start = np.arange(len(sym)) - np.repeat(ends - sizes, sizes)
        stop = start + 1
        short = sizes[word] <= LONG
        sym, word, start, stop = sym[short], word[short], start[short], stop[short]
        rank, merged = self._candidates(sym, word, start, stop, keys, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            over = np.repeat(least == NONE, count)
            if over.any():
                done_sym.append(sym[over])
                done_at.append(start[over])
                done_word.append(word[over])
                on = ~over
                sym, word, start, stop, rank, merged = sym[on], word[on], start[on], stop[on], rank[on], merged[on]
                least, count = least[least != NONE], count[least != NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            hit = hit[np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))]
            sym[hit], stop[hit] = merged[hit], stop[hit + 1]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            sym, word, start, stop, rank, merged = sym[keep], word[keep], start[keep], stop[keep], rank[keep], merged[keep]
            changed = np.concatenate((at, at[at > 0] - 1))
            changed = np.unique(changed)
            rank[changed], merged[changed] = self._candidates(sym, word, start, stop, keys, changed)
        word, at, sym = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_word, done_at, done_sym))
        order = np.argsort(word * (int(sizes.max(initial=0)) + 1) + at, kind="stable")
        return self._spelled(sym[order], word[order], len(words))

    def _candidates(self, sym, word, start, stop, keys, at) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(at), NONE, dtype=np.int64)
        merged = np.zeros(len(at), dtype=np.int64)
        some = np.flatnonzero(at + 1 < len(sym))
        some = some[word[at[some]] == word[at[some] + 1]]
        k = at[some]
        rank[some], merged[some] = self.pieces.look_up(sym[k], sym[k + 1])
        some = some[rank[some] < NONE]
        k = at[some]
        rank[some[self.skipped(keys[word[k]], start[k], stop[k], stop[k + 1])]] = NONE
        return rank, merged

    def _long(self, sym: np.ndarray, key) -> tuple[np.ndarray, np.ndarray]:
        n = len(sym)
        sym = sym.tolist()
        nxt, prv, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        pairs, agenda = self.pieces.pairs.get, []
        keys = np.array([key], dtype=np.uint64)

        def offer(a: int) -> None:
            b = nxt[a]
            if b < n and (found := pairs((sym[a], sym[b]))) and not self.skipped(keys, np.array([a]), np.array([stop[a]]), np.array([stop[b]]))[0]:
                heapq.heappush(agenda, (found[0], a, b, stop[a], stop[b], found[1]))

        for a in range(n - 1):
            offer(a)
        while agenda:
            _, a, b, middle, end, piece = heapq.heappop(agenda)
            if not (alive[a] and b < n and alive[b] and nxt[a] == b and stop[a] == middle and stop[b] == end):
                continue
            sym[a], stop[a], nxt[a], alive[b] = piece, end, nxt[b], False
            if nxt[b] < n:
                prv[nxt[b]] = a
            offer(a)
            if prv[a] >= 0:
                offer(prv[a])
        left = [k for k in range(n) if alive[k]]
        return np.array([sym[k] for k in left], dtype=np.int64), np.array(left, dtype=np.int64)

    def _spelled(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces as byte pieces."""
        odd = np.flatnonzero(sym >= len(self.pieces.text))
        if not len(odd):
            return sym, np.bincount(word, minlength=n_words)
        extra = {v: k for k, v in self.pieces.symbols.items() if v >= len(self.pieces.text)}
        spelled = {s: [int(self.pieces.bytes[b]) for b in (extra[s] if s in extra else chr(s - self.pieces.base)).replace(LITERAL, SPACE).encode()] for s in set(sym[odd].tolist())}
        size = np.ones(len(sym), dtype=np.int64)
        size[odd] = [len(spelled[s]) for s in sym[odd].tolist()]
        out = np.repeat(sym, size)
        begin = np.cumsum(size) - size
        for k, s in zip(begin[odd].tolist(), sym[odd].tolist(), strict=True):
            out[k : k + len(spelled[s])] = spelled[s]
        return out, np.bincount(word, weights=size, minlength=n_words).astype(np.int64)

    def __call__(self, texts: list[str | None], doc_ids: list[int | None]) -> list[np.ndarray]:
        known: dict[str, int] = {}
        codes, sizes = [], []
        for text in texts:
            # A literal U+2581 goes as a lone surrogate, which no text holds, and is spelled in its bytes.
            shown = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""
            own = self.split.findall(shown)
            sizes.append(len(own))
            codes.extend([known.setdefault(w, len(known)) for w in own])
        if not codes:
            return [np.empty(0, dtype=np.int32) for _ in texts]
        code, size = np.array(codes, dtype=np.int64), np.array(sizes)
        begin = np.cumsum(size) - size
        place = np.arange(len(code)) - np.repeat(begin, size)
        doc = np.repeat(np.array([d or 0 for d in doc_ids], dtype=np.int64).view(np.uint64), size)
        seed = mixed(np.array([self.seed], dtype=np.int64).view(np.uint64))
        variant = (mixed(mixed(doc ^ seed) + place.astype(np.uint64)) % _U64(self.variants)).astype(np.int64) if self.rate > 0 else np.zeros(len(code), np.int64)
        which, back = np.unique(code * self.variants + variant, return_inverse=True)
        listed = list(known)
        hashed = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in listed], dtype=np.uint64)
        keys = mixed(hashed[which // self.variants] + seed + mixed((which % self.variants).astype(np.uint64)))
        ids, counts = [], []
        for a in range(0, len(which), WORDS_AT_ONCE):
            own, n = self.words([listed[c] for c in (which[a : a + WORDS_AT_ONCE] // self.variants).tolist()], keys[a : a + WORDS_AT_ONCE])
            ids.append(own.astype(np.int32))
            counts.append(n)
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        first = np.cumsum(counts) - counts
        n = counts[back]
        total = np.cumsum(n)
        flat = ids[np.repeat(first[back] - (total - n), n) + np.arange(int(total[-1]))]
        ends = np.concatenate(([0], total))
        return [flat[ends[a] : ends[a + s]] for a, s in zip(begin.tolist(), sizes, strict=True)]


def decoder(pieces: Pieces):
    """A function from ids to the text."""
    plain = [p.replace(SPACE, " ").encode() for p in pieces.text]
    for value, k in enumerate(pieces.bytes.tolist()):
        plain[k] = bytes([value])

    def decode(ids) -> str:
        return b"".join([plain[k] for k in ids]).decode()[1:]

    return decode


def _model(docs: DataFrame, model: str):
    with open(model, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


_HELD: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _HELD:
        _HELD[key] = Pieces(model)
    return _HELD[key]


def encoded(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED, variants: int = VARIANTS, digest: bool = False) -> DataFrame:
    """Per document row: doc_id, n_chars (code points), n_tokens, and ids, or with `digest` ids_sha256 (of the ids as
    little-endian int32) and lossless (whether decoding gave back the text)."""
    frugal(docs.sparkSession)
    shared = _model(docs, model)
    last = [("ids_sha256", pa.string()), ("lossless", pa.bool_())] if digest else [("ids", pa.list_(pa.int32()))]
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), *last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        encode, decode = Encoder(pieces, rate, seed, variants), decoder(pieces)
        for part in (x for b in batches for x in slices(b, "text", SLICE_BYTES)):
            texts, doc_ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
            ids = encode(texts, doc_ids)
            columns = [part.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64())]
            if digest:
                columns.append(pa.array([None if t is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for t, x in zip(texts, ids, strict=True)], pa.string()))
                columns.append(pa.array([decode(x.tolist()) == (t or "") for t, x in zip(texts, ids, strict=True)], pa.bool_()))
            else:
                columns.append(pa.array([None if t is None else x for t, x in zip(texts, ids, strict=True)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, n_chars bigint, n_tokens bigint, " + ("ids_sha256 string, lossless boolean" if digest else "ids array<int>"))


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text, from doc_id and ids."""
    shared = _model(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(_pieces(shared.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else decode(x) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
