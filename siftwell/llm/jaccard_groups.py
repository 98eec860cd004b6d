"""N-gram Jaccard join: grouped prefix join over sets of word shingles, and the classes that its links make.

Two documents link when the Jaccard coefficient of their sets of distinct 5-word shingles is 0.75 or more
(`percent * union <= 100 * intersection`, in integers). Shingles are 64-bit hashes; so are set ids. To find sets that
share a shingle, lower 40 bits travel; where two sets are compared, 48 (false equalities: about one in a million visits
of a set to a block, and they matter only to pairs right below the line).

1. Every text gives its set, its set id and size; equal sets are one member from here on.
2. Shingles are ordered: first those that no shard of the corpus found frequent, by hash, then frequent ones by
   count. (Any one order gives the same links. It keeps passages that many documents share out of the prefixes. The lower
   hashes, which lead, are counted in shards of more documents.)
3. A set's prefix holds its first n - ceil(0.75 n) + 1 shingles: linked sets share a prefix shingle. Members with
   the same prefix and size are one group; groups are packed by ranges of scrambled shingles, of about equal numbers of
   entries, and each range yields its runs of groups that share a shingle.
4. First pass: each member is compared with the one neighbour it shares most prefix shingles with (block pivots
   within a run, neighbours within a group), so that a class of n near copies costs about n comparisons.
5. Second pass: a group outside its run's largest class is compared with the one of that class next to it in size.
6. Third pass: blocks hold groups that the first passes brought together, linked or not, of a bounded number of
   shingles. A group goes to each block that holds a group of another class whose size and place in a shared run allow
   a link (once for each pair of groups, mostly: where the first shingles that both carry tell that they share an earlier one,
   they meet in that one's run), and meets all members there by term-at-a-time accumulation over the block's postings: prefixes first, then
   whole sets where what prefixes share leaves a link possible. None is capped, so classes are exact, and rows number groups times blocks, not pairs. (Place: the first shingle that two
   linked sets share stands early enough in both for the needed overlap to follow. Each run tests this on its own, and
   that first shingle's run always passes it.)

Only set ids, prefixes and the sets of members with a partner travel; texts don't.

Defined cases: null, empty or blank texts have an empty set, link with nothing and are their own class; fewer
than five words make one shingle of the whole sequence. Equal texts under one doc_id or several are linked. A null
doc_id takes its class's smallest id (null if there is none). Extra columns are ignored, in `deduplicated` kept.
A text hash of 64 bits tells rows of one doc_id apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import byte_texts, discard, frugal, mixed, packed, slices, stored, tidy

WORDS = 5
PERCENT = 75
SLICE_BYTES = 1 << 20
#: Shingles that this many documents of a shard share are reported, and are frequent from so many in all shards on; so many at most are ordered by count.
FREQUENT_IN_SHARD = 3
FREQUENT_LEAST = 3
FREQUENT_MOST = 1 << 20
#: The lower hashes, of which prefixes mostly consist, are counted in shards of their own: these span more documents, and two tell.
LEADING = int(0.4 * 2**64)
LEADING_IN_SHARD = 2
SHARD_SHINGLES = 3 << 19
#: Prefix shingles in a range, and in the packets that a task sends out.
RANGE_ENTRIES = 300_000
RANGES_LEAST = 64
PACKET_ENTRIES = 600_000
BLOCK = 64
#: Shingles in a block of the third pass, and of the groups that one task holds against it (six bytes each on the way, eight in a task).
BLOCK_SHINGLES = 1 << 19
#: A run longer than this makes its shingle count as frequent, and prefixes are then taken anew.
LONG_RUN = 1024
#: Edges that one task contracts at most (16 bytes each); beyond that components are found by all tasks in rounds.
FEW_EDGES = 500_000
#: log2 of the bits, at most, of the filter over ids that is sent to all tasks (8 MB).
FILTER_BITS = 26
#: First prefix shingles of a group that it carries where runs meet, and first frequent ones (copies of one text that were edited
#: apart share these only): two groups that share one of them meet only where they share the first.
FIRSTS = 4
OFTEN = 2
CARRIED = FIRSTS + OFTEN

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = mixed(np.arange(1, WORDS + 65, dtype=np.uint64)) | np.uint64(1)
_U64 = np.uint64
_LOW = np.uint64((1 << 40) - 1)
_LEADING = np.uint64(LEADING)


def narrow(values: np.ndarray, width: int = 5) -> np.ndarray:
    """The lower bytes of each hash, packed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def wide(data: bytes, width: int = 5) -> np.ndarray:
    packed = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(packed), 8), dtype=np.uint8)
    out[:, :width] = packed
    return out.view("<u8").reshape(-1)


def planes(values: np.ndarray) -> np.ndarray:
    """Small integers as their first bytes, their second bytes and so on: what is zero shrinks to nothing on the way."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def shingle_sets(texts: list[bytes | None], width: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    lowered = [(t or b"").lower() for t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    data = np.frombuffer(b" ".join(lowered) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(begins):
        return [np.empty(0, dtype=_U64) for _ in texts]
    place = np.arange(len(data), dtype=np.int64)
    place[: begins[0]] = 0
    place[begins[0] :] -= np.repeat(begins, np.diff(np.append(begins, len(data))))
    place[space] = 0
    weight = mixed(np.arange(1, int(place.max()) + 2, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)
    parts = (data.astype(np.uint64) + _U64(1)) * weight[place]
    parts[space] = 0
    words = mixed(np.add.reduceat(parts, begins))
    first = np.searchsorted(begins, starts)
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _STEP[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + _STEP[width + b - a : width + b - a + 1]))
        else:
            out.append(np.empty(0, dtype=_U64))
    return out


def set_id(values: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set."""
    total = mixed(values ^ _U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total ^ _U64(len(values))).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _described(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, text_key, key (set id), n; kind 1: a shingle frequent in a shard as key, with its count as n."""
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def frequent(held: list[np.ndarray], least: int) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= least
        n = int(often.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {LEADING_IN_SHARD: [], FREQUENT_IN_SHARD: []}
        many, seen = dict.fromkeys(shards, 0), {least: set() for least in shards}
        for part in (x for b in batches for x in slices(b, "text", SLICE_BYTES)):
            sets = shingle_sets(byte_texts(part.column("text")))
            ids = [set_id(s) for s in sets]
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), part.column("doc_id"), part.column("text_key"), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], schema=schema)
            for s, key in zip(sets, ids, strict=True):
                cut = np.searchsorted(s, _LEADING)
                for least, x in ((LEADING_IN_SHARD, s[:cut]), (FREQUENT_IN_SHARD, s[cut:])):
                    if len(x) and key not in seen[least]:
                        seen[least].add(key)
                        shards[least].append(x.copy())
                        many[least] += len(x)
            for least in shards:
                if many[least] >= SHARD_SHINGLES:
                    yield frequent(shards[least], least)
                    shards[least], many[least], seen[least] = [], 0, set()
        for least, held in shards.items():
            if held:
                yield frequent(held, least)

    return _texts(docs).mapInArrow(tidy(run), "kind tinyint, doc_id bigint, text_key bigint, key bigint, n bigint")


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their counts: the FREQUENT_MOST of the highest counts at most."""
    counts = described.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST)
    tail = counts.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()
    least, many = 0, 0
    for row in tail:
        if (many := many + row["count"]) > FREQUENT_MOST:
            least = 2 ** (row["level"] + 1)
            break
    found = counts.where(F.col("n") >= least).toArrow()
    keys, first = np.unique(found.column("key").to_numpy().view(np.uint64) & _LOW, return_index=True)
    return keys, found.column("n").to_numpy()[first]


def _prefix(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, int]:
    """A set's prefix, and how many shingles in it come before the frequent ones."""
    keep = prefix_size(len(values), percent)
    keys, counts = frequent
    if len(keys):
        low = values & _LOW
        at = np.searchsorted(keys, low)
        at[at == len(keys)] = 0
        count = np.where(keys[at] == low, counts[at], 0)
        if often := np.count_nonzero(count):
            return values[np.argsort(count, kind="stable")[:keep]], min(keep, len(values) - often)
    return values[:keep].copy(), keep  # not a view that holds the whole set


def _firsts(head: np.ndarray, rare: int, group: int) -> np.ndarray:
    """A prefix's first shingles and its first frequent ones as they travel (where there are fewer, bits of the group's own), and the place of the latter."""
    out = np.full(CARRIED + 1, group, dtype=np.int64)
    for at, x in ((0, head[:FIRSTS]), (FIRSTS, head[rare : rare + OFTEN])):
        out[at : at + len(x)] = x.view(np.int64)
    out[-1] = rare
    return out & np.int64(_LOW)


def _packets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], ranges: int, percent: int) -> DataFrame:
    """Prefix shingles of groups, packed per range of shingles: per entry groups, n, tokens and rest (how many shingles of
    the set come from here on). Rows of a negative range hold members instead: groups, set ids as tokens, first shingles as rest."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("range", pa.int64()), ("groups", pa.binary()), ("n", pa.binary()), ("tokens", pa.binary()), ("rest", pa.binary())])

    def row(at: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"range": [at]} | {k: [packed(v)] for k, v in zip(schema.names[1:], columns, strict=True)}, schema=schema)

    def packet(members: list[tuple[int, int]], heads: list[tuple[int, int, np.ndarray]], firsts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        both = np.array(members, dtype=np.int64)
        yield row(-1 - int(mixed(both[:1, 0].view(np.uint64))[0] % _U64(ranges)), both[:, 1], np.empty(0), both[:, 0], np.stack(firsts))
        token = np.concatenate([h[2] for h in heads])
        owner = np.repeat(np.arange(len(heads), dtype=np.int32), [len(h[2]) for h in heads])
        group, n = np.array([h[0] for h in heads], dtype=np.int64), np.array([h[1] for h in heads], dtype=np.int32)
        rest = np.concatenate([np.arange(h[1], h[1] - len(h[2]), -1, dtype=np.int32) for h in heads])
        to = (((mixed(token) >> _U64(32)) * _U64(ranges)) >> _U64(32)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            at = owner[mine]
            yield row(int(to[mine[0]]), group[at], planes(n[at]), narrow(token[mine]), planes(rest[mine]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, heads, firsts, many = [], [], [], 0
        seen, grouped = set(), set()
        for part in (x for b in batches for x in slices(b, "text", SLICE_BYTES)):
            for s in shingle_sets(byte_texts(part.column("text"))):
                if not len(s) or (key := set_id(s)) in seen:
                    continue
                seen.add(key)
                head, rare = _prefix(s, shared.value, percent)
                group = set_id(np.append(head, _U64(len(s))))
                if group not in grouped:
                    grouped.add(group)
                    heads.append((group, len(s), head))
                    many += len(head)
                members.append((key, group))
                firsts.append(_firsts(head, rare, group))
            pa.default_memory_pool().release_unused()
            if many >= PACKET_ENTRIES:
                yield from packet(members, heads, firsts)
                members, heads, firsts, many = [], [], [], 0
                seen, grouped = set(), set()
        if members:
            yield from packet(members, heads, firsts)

    return _texts(docs).drop("text_key").mapInArrow(tidy(run), "range bigint, groups binary, n binary, tokens binary, rest binary")


def _runs(packets: DataFrame) -> DataFrame:
    """Per range: its runs of two groups or more (ends of runs; group, n and rest per entry), or members (groups, ids and first shingles)."""
    names = ["ends", "groups", "n", "rest", "member_groups", "member_ids", "firsts", "long", "lengths"]
    schema = pa.schema([("range", pa.int64()), *((k, pa.binary()) for k in names)])
    none = np.empty(0, dtype=np.int64)

    def joined(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]

    def run(table: pa.Table) -> pa.Table:
        at = table.column("range")[0].as_py()
        group = np.concatenate(joined(table, "groups", np.int64))
        if at < 0:
            firsts = np.concatenate(joined(table, "rest", np.int64)).reshape(-1, CARRIED + 1)
            rows = np.unique(np.column_stack([group, np.concatenate(joined(table, "tokens", np.int64)), firsts]), axis=0)
            columns = (none, none, none, none, rows[:, 0], rows[:, 1], rows[:, 2:], none, none)
        else:
            token = np.concatenate([wide(x) for x in table.column("tokens").to_pylist()])
            size, rest = (np.concatenate([from_planes(x) for x in table.column(c).to_pylist()]) for c in ("n", "rest"))
            order = np.argsort(token)
            token = token[order]
            same = token[1:] == token[:-1]
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            order, token = order[shared], token[shared]
            group, size, rest = group[order], size[order], rest[order]
            order = np.lexsort((group, size, token))
            token, group, size, rest = token[order], group[order], size[order], rest[order]
            if len(token):
                new = np.concatenate(([True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])))
                token, group, size, rest = token[new], group[new], size[new], rest[new]
            ends = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token)).astype(np.int64) if len(token) else none
            lengths = np.diff(np.concatenate(([0], ends)))
            keep = np.repeat(lengths > 1, lengths)  # a group may have met itself only
            of_run = token[ends - 1][lengths > LONG_RUN] if len(ends) else token
            columns = (np.cumsum(lengths[lengths > 1]), group[keep], size[keep].astype(np.int32), rest[keep].astype(np.int32), none, none, none, of_run, lengths[lengths > LONG_RUN])
        return pa.Table.from_pydict({"range": [at]} | {k: [packed(v)] for k, v in zip(names, columns, strict=True)}, schema=schema)

    return packets.groupBy("range").applyInArrow(run, "range bigint, " + ", ".join(f"{k} binary" for k in names))


def _column(values: np.ndarray) -> pa.Array:
    """One number a row, or a row's numbers packed."""
    if values.ndim == 1:
        return pa.array(values)
    return pa.array([packed(narrow(x)) for x in values], pa.binary())


def _unpacked(runs: DataFrame, schema: str, names: list[str], make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {x: batch.column(x)[k].as_py() for x in batch.schema.names}
                arrays = make(row["range"], *(np.frombuffer(row[x], dtype=t) for x, t in (("ends", np.int64), ("groups", np.int64), ("n", np.int32), ("member_groups", np.int64), ("member_ids", np.int64), ("firsts", np.int64))))
                for at in range(0, len(arrays[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([_column(a[at : at + (1 << 18)]) for a in arrays], names=names)

    return runs.mapInArrow(tidy(run), schema)


def _members(range_no, ends, groups, n, member_groups, member_ids, firsts):
    return member_groups, member_ids, firsts.reshape(-1, CARRIED + 1)


def _neighbours(percent: int):
    def make(range_no, ends, groups, n, member_groups, member_ids, firsts):
        """Pairs of groups in a run, a block's pivot with the rest, and block pivots in turn: group, pivot, n of the group, shared shingles.

        Pivots are told by a hash, as the runs of a large class lack a few of its groups each: a place in them is one group here and another there.
        """
        if not len(ends):
            return (np.empty(0, np.int64),) * 4
        begins = np.concatenate(([0], ends[:-1]))
        place = np.arange(len(groups)) - np.repeat(begins, ends - begins)
        heads = np.flatnonzero(place % BLOCK == 0)
        lengths = np.diff(np.append(heads, len(groups)))
        order = mixed(groups.view(np.uint64))
        pivots = np.flatnonzero(order == np.repeat(np.minimum.reduceat(order, heads), lengths))
        to = np.repeat(pivots, lengths)
        to[pivots] = np.where(place[heads] > 0, np.roll(pivots, 1), -1)
        has = to >= 0
        to = to[has]
        fit = 100 * np.minimum(n[to], n[has]).astype(np.int64) >= percent * np.maximum(n[to], n[has]).astype(np.int64)
        pairs, counts = np.unique(np.stack([groups[has][fit], groups[to][fit], n[has][fit]]), axis=1, return_counts=True)
        return pairs[0], pairs[1], pairs[2], counts.astype(np.int64)

    return make


def _ranged(range_no, ends, groups, n, member_groups, member_ids, firsts):
    own = np.unique(groups)
    return np.full(len(own), range_no, dtype=np.int64), own


def _open(runs: DataFrame, of_group: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """g, other and shared of the groups in a run with one of another class (g, c, block, firsts) that they may link with.

    With `nearest`, for each group outside a run's largest class the one of that class next to it in size, and about how
    many prefix shingles they share; else the blocks that hold any.

    A run leaves out two groups whose first shingles tell that they share an earlier one: they meet in that one's run, and
    the first shingle that linked sets share is never left out. So like sets don't meet in each range anew.
    """
    labels = _unpacked(runs, "range bigint, g bigint", ["range", "g"], _ranged).join(of_group, "g")
    labels = labels.groupBy("range").agg(F.collect_list(F.struct("g", "c", "block", "firsts")).alias("held"))
    labels = labels.select("range", F.col("held.g").alias("known"), F.col("held.c").alias("label"), F.col("held.block").alias("block"), F.col("held.firsts").alias("firsts"))
    schema = pa.schema([("g", pa.int64()), ("other", pa.int64()), ("shared", pa.int64())])

    def counted(found: list[np.ndarray]) -> np.ndarray:
        every = np.concatenate(found, axis=1)
        every = every[:, np.lexsort((every[1], every[0]))]
        new = np.flatnonzero(np.concatenate(([True], (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1]))))
        return np.stack([every[0, new], every[1, new], np.add.reduceat(every[2], new)])

    def fits(m1: np.ndarray, m2: np.ndarray, rest1: np.ndarray, rest2: np.ndarray) -> np.ndarray:
        """Whether sets of m1 and m2 shingles can link if this is the first one they share."""
        return (100 + percent) * np.minimum(rest1, rest2) >= percent * (m1 + m2)

    def common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For each of the first shingles in `one` (a row each), whether those of its kind in `two` hold it."""
        return np.stack([np.logical_or.reduce([one[a] == two[b] for b in kind]) for kind in (range(FIRSTS), range(FIRSTS, CARRIED)) for a in kind])

    def places(firsts: np.ndarray) -> np.ndarray:
        """The places of the first shingles in their prefix."""
        return np.concatenate((np.broadcast_to(np.arange(FIRSTS)[:, None], (FIRSTS, firsts.shape[1])), firsts[-1].astype(np.int64) + np.arange(OFTEN)[:, None]))

    def earlier(one: np.ndarray, place: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether two groups' first shingles have one in common before the place in `one` of what a run shares."""
        return (common(one, two) & (place > places(one))).any(axis=0)

    def about(one: np.ndarray, two: np.ndarray, m: np.ndarray) -> np.ndarray:
        """How many prefix shingles two groups share, by their first ones; 1 if these have none in common, as each run counts then."""
        held, rare = common(one, two), one[-1].astype(np.int64)
        often = np.maximum(0, m * (100 - percent) // 100 - rare)
        return np.maximum(1, held[:FIRSTS].sum(axis=0) * rare // FIRSTS + held[FIRSTS:].sum(axis=0) * often // OFTEN)

    def of_run(own: np.ndarray, of: np.ndarray, block: np.ndarray, m: np.ndarray, rest: np.ndarray, firsts: np.ndarray) -> Iterator[np.ndarray]:
        """What a run yields; its entries come in order of size."""
        values, counts = np.unique(of, return_counts=True)
        largest = values[np.argmax(counts)]
        outer = np.flatnonzero(of != largest)
        if nearest:
            inner = np.flatnonzero(of == largest)
            at = np.searchsorted(inner, outer)
            near = np.where((at > 0) & ((at == len(inner)) | (outer - inner[np.maximum(at - 1, 0)] <= inner[np.minimum(at, len(inner) - 1)] - outer)), inner[np.maximum(at - 1, 0)], inner[np.minimum(at, len(inner) - 1)])
            fit = fits(m[outer], m[near], rest[outer], rest[near]) & ~earlier(firsts[:, outer], (m - rest)[outer], firsts[:, near])
            outer, near = outer[fit], near[fit]
            yield np.stack([own[outer], own[near], about(firsts[:, outer], firsts[:, near], m[outer])])
            return
        place, at = m - rest, places(firsts)
        for k in outer.tolist():
            low, high = np.searchsorted(m, -(-percent * m[k] // 100)), np.searchsorted(m, 100 * m[k] // percent, side="right")
            # With the largest class every pair counts here, with others the pair counts at its first.
            other = (of[low:high] == largest) | ((of[low:high] != of[k]) & (np.arange(low, high) > k))
            meets = low + np.flatnonzero(other & fits(m[k], m[low:high], rest[k], rest[low:high]))
            if len(meets) and (before := np.flatnonzero(place[k] > at[:, k])).size:
                held = firsts[:CARRIED, meets]
                meets = meets[~np.logical_or.reduce([(held == firsts[a, k]).any(axis=0) for a in before])]
            if not len(meets):
                continue
            to = np.unique(block[meets])
            yield np.stack([np.full(len(to), own[k]), to, np.ones(len(to), np.int64)])

    def of_pairs(at: np.ndarray, own: np.ndarray, of: np.ndarray, block: np.ndarray, m: np.ndarray, rest: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """What of_run yields for runs of two groups, that begin at `at`, all at once."""
        first = of[at] < of[at + 1]
        inner, outer = np.where(first, at, at + 1), np.where(first, at + 1, at)
        fit = fits(m[outer], m[inner], rest[outer], rest[inner])
        if not nearest:
            fit &= (m[inner] >= -(-percent * m[outer] // 100)) & (m[inner] <= 100 * m[outer] // percent)
        outer, inner = outer[fit], inner[fit]
        new = ~earlier(firsts[:, outer], (m - rest)[outer], firsts[:, inner])
        outer, inner = outer[new], inner[new]
        return np.stack([own[outer], own[inner], about(firsts[:, outer], firsts[:, inner], m[outer])] if nearest else [own[outer], block[inner], np.ones(len(outer), np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ends, groups, n, rest = (np.frombuffer(batch.column(x)[r].as_py(), dtype=t) for x, t in (("ends", np.int64), ("groups", np.int64), ("n", np.int32), ("rest", np.int32)))
                known, label, block = (batch.column(x)[r].values.to_numpy() for x in ("known", "label", "block"))
                order = np.argsort(known)
                at = order[np.searchsorted(known[order], groups)]
                f = wide(b"".join(batch.column("firsts")[r].values.to_pylist())).reshape(-1, CARRIED + 1)
                c, b, f = label[at], block[at], np.ascontiguousarray(f.T)[:, at]
                begins = np.concatenate(([0], ends[:-1]))
                several = np.minimum.reduceat(c, begins) != np.maximum.reduceat(c, begins)
                pairs = several & (ends - begins == 2)
                found = [of_pairs(begins[pairs], groups, c, b, n.astype(np.int64), rest.astype(np.int64), f)] if pairs.any() else []
                several &= ~pairs
                many = sum(x.shape[1] for x in found)
                for first, last in zip(begins[several].tolist(), ends[several].tolist(), strict=True):
                    for x in of_run(groups[first:last], c[first:last], b[first:last], n[first:last].astype(np.int64), rest[first:last].astype(np.int64), f[:, first:last]):
                        if x.shape[1]:
                            found.append(x)
                            many += x.shape[1]
                    if many > 500_000:
                        found = [counted(found)]
                        many = 0
                if many := sum(x.shape[1] for x in found):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in counted(found)], schema=schema)
            pa.default_memory_pool().release_unused()

    rows = runs.select("range", "ends", "groups", "n", "rest").join(labels, "range").mapInArrow(tidy(run), "g bigint, other bigint, shared bigint")
    return rows.groupBy("g", "other").agg(F.sum("shared").alias("shared"))


def _id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit map over doc_id that lets all of them through and few others; of a bounded size."""
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(12 * ids.count() + 1))))
    schema = pa.schema([("word", pa.int64()), ("held", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _bits_of(batch.column("doc_id").to_numpy(), bits):
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], schema=schema)

    held = ids.mapInArrow(tidy(run), "word bigint, held bigint").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.int64)
    words[held.column("word").to_numpy()] = held.column("held").to_numpy()
    return words, bits


def _bits_of(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    spread = mixed(ids.astype(np.int64).view(np.uint64) + _U64(1))
    return (spread >> _U64(64 - bits)).astype(np.int64), (spread & _U64((1 << bits) - 1)).astype(np.int64)


def _sets_of(docs: DataFrame, wanted: DataFrame, described: DataFrame, head=None) -> DataFrame:
    """key, values (packed hashes; of the set's `head` if there is one) of the wanted set ids, and of few others."""
    first = described.where("kind = 0 and n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    ids = first.join(wanted, "key", "left_semi").where("doc_id is not null").select("doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(_id_filter(stored(ids)))
    schema = pa.schema([("key", pa.int64()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            keep = ids.is_null().to_numpy(zero_copy_only=False)  # without an id only the set id tells
            one, two = _bits_of(ids.fill_null(0).to_numpy(zero_copy_only=False), bits)
            keep |= ((words[one >> 6] >> (one & 63)) & (words[two >> 6] >> (two & 63)) & 1).astype(bool)
            for part in slices(batch.filter(pa.array(keep)), "text", SLICE_BYTES):
                sets = [s for s in shingle_sets(byte_texts(part.column("text"))) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([packed(narrow(head(s) if head else s, 6)) for s in sets], pa.binary())], schema=schema)

    return _texts(docs).drop("text_key").mapInArrow(tidy(run), "key bigint, values binary")


def _with_long_runs(frequent: tuple[np.ndarray, np.ndarray], runs: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], bool]:
    """The frequent shingles with those of long runs, and whether any of these is new and fits."""
    rows = runs.where(F.octet_length("long") > 0).select("long", "lengths").toArrow()
    keys = np.concatenate([np.empty(0, _U64), *(np.frombuffer(x, dtype=np.uint64) for x in rows.column("long").to_pylist())])
    counts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, dtype=np.int64) for x in rows.column("lengths").to_pylist())])
    new = np.flatnonzero(~np.isin(keys, frequent[0]))
    new = new[np.argsort(-counts[new], kind="stable")][: max(0, 2 * FREQUENT_MOST - len(frequent[0]))]
    keys, counts = np.concatenate((frequent[0], keys[new])), np.concatenate((frequent[1], counts[new]))
    order = np.argsort(keys)
    return (keys[order], counts[order]), len(new) > 0


def _linked(docs: DataFrame, pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """Those of the (stored) pairs a, b whose sets link."""
    sets = _sets_of(docs, pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), described)
    a = sets.select(F.col("key").alias("a"), F.col("values").alias("a_values"))
    b = sets.select(F.col("key").alias("b"), F.col("values").alias("b_values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_values"), batch.column("b_values"), strict=True):
                one, two = wide(x.as_buffer(), 6), wide(y.as_buffer(), 6)
                every = np.sort(np.concatenate((one, two)))
                both = int((every[1:] == every[:-1]).sum())
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = a.join(pairs.select("a").distinct(), "a", "left_semi")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "a_values", "b_values").mapInArrow(tidy(run), "a bigint, b bigint")


def _bridges(docs: DataFrame, visits: DataFrame, placed: DataFrame, described: DataFrame, percent: int, frequent=None) -> DataFrame:
    """a, b: classes that a link joins, of the members g that visit a block and those (g, key, label, n, block) in it.

    With the frequent shingles, prefixes meet instead, and the visits (a: g, b: block) that may find a link return.
    Visitors of a block are dealt over tasks by their number of shingles; each of these tasks holds the whole block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent) if frequent else None
    visitors = visits.join(placed.select("g", "key", "label", "n"), "g").select("g", "block", "key", "label", "n")
    tasks = visitors.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("tasks"))
    task = F.xxhash64("block", "part").alias("task")
    come = visitors.join(tasks, "block").withColumn("part", F.pmod(F.xxhash64("key"), F.col("tasks"))).select(task, "block", "g", "key", "label", "n", F.lit(True).alias("visits"))
    held = placed.join(tasks, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1))).select(task, "block", "g", "key", "label", "n", F.lit(False).alias("visits"))
    rows = stored(come.unionByName(held).distinct())
    head = (lambda s: _prefix(s, shared.value, percent)[0]) if shared else None
    sets = _sets_of(docs, rows.select("key").distinct(), described, head).dropDuplicates(["key"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        visits = table.column("visits").to_numpy()
        label, n = table.column("label").to_numpy(), table.column("n").to_numpy()
        sets = [wide(x.as_buffer(), 6) for x in table.column("values")]
        at = np.flatnonzero(~visits)
        found: set[tuple[int, int]] = set()
        if len(at):
            size = np.array([len(sets[k]) for k in at.tolist()])
            token = np.concatenate([sets[k] for k in at.tolist()])
            order = np.argsort(token)
            token, owner = token[order], np.repeat(np.arange(len(at)), size)[order]
            for k in np.flatnonzero(visits).tolist():
                low, high = np.searchsorted(token, sets[k]), np.searchsorted(token, sets[k], side="right")
                many = high - low
                place = np.arange(int(many.sum())) + np.repeat(low - np.cumsum(many) + many, many)
                both = np.bincount(owner[place], minlength=len(at))
                if shared:  # what two sets share beyond their prefixes is at most the longer rest of one of them
                    both += -(-percent * np.maximum(n[k], n[at]) // 100) - 1
                linked = label[at][(100 + percent) * both >= percent * (n[k] + n[at])]
                linked = linked[linked != label[k]]
                if shared and len(linked):
                    found.add((table.column("g")[k].as_py(), table.column("block")[k].as_py()))
                elif len(linked):
                    found.update((int(label[k]), x) for x in np.unique(linked).tolist())
        pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return rows.join(sets, "key").select("task", "block", "g", "label", "n", "visits", "values").groupBy("task").applyInArrow(run, "a bigint, b bigint")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of the edges u, v by union and find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up] if up in root else up
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """node, label (its component's smallest node) for the nodes of the edges a, b.

    One task contracts `few` edges at most, whose size is counted first; more go through alternating stars, each round
    stored. Both give the same labels. The result is a stored table.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() <= few:
        found = stored(e.coalesce(1).mapInArrow(tidy(_contracted), "node bigint, label bigint"))
        discard(e)
        return found
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = stored(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        discard(e)
        e = after
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    found = stored(e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
    discard(e)
    return found


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Per document row: doc_id, text_key, n_shingles, component_id, class_key; and the stored tables that this reads."""
    frugal(docs.sparkSession)
    described = stored(_described(docs))
    frequent = _frequent(described)
    short = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    entries = described.where("kind = 0 and n > 0").agg(F.sum(short)).first()[0] or 0
    ranges = max(RANGES_LEAST, math.ceil(entries / RANGE_ENTRIES))
    while True:
        runs = stored(_runs(_packets(docs, frequent, ranges, percent)))
        frequent, more = _with_long_runs(frequent, runs)
        if not more:
            break
        discard(runs)

    members = stored(_unpacked(runs.where("range < 0"), "g bigint, key bigint, firsts binary", ["g", "key", "firsts"], _members).dropDuplicates(["g", "key"]))
    runs = runs.where("range >= 0 and octet_length(ends) > 0")
    heads = members.groupBy("g").agg(F.min("key").alias("key"))
    near = _unpacked(runs, "g bigint, h bigint, n bigint, shared bigint", ["g", "h", "n", "shared"], _neighbours(percent)).groupBy("g", "h", "n").agg(F.sum("shared").alias("shared"))
    # Few shared shingles promise no link; the second pass takes such pairs where they matter.
    near = near.where(20 * F.col("shared") >= F.col("n")).groupBy("g").agg(F.max_by("h", F.struct("shared", "h")).alias("h"))
    between = near.join(heads.withColumnRenamed("key", "b"), "g").join(heads.select(F.col("g").alias("h"), F.col("key").alias("a")), "h").select("a", "b")
    within = members.join(heads.withColumnRenamed("key", "a"), "g").where("a <> key").select("a", F.col("key").alias("b"))
    first = stored(between.unionByName(within).where("a <> b").distinct())
    links = stored(_linked(docs, first, described, percent))
    found = components(links)
    discard(links)

    sizes = described.where("kind = 0 and n > 0").groupBy("key").agg(F.first("n").alias("n"))
    placed = members.join(sizes, "key").join(found.withColumnRenamed("node", "key"), "key", "left")
    placed = stored(placed.select("g", "key", "n", "firsts", F.coalesce("label", "key").alias("label")))
    discard(found)

    def of_groups(placed: DataFrame) -> DataFrame:
        """g, c (its class; a group whose members are in several classes is a class of its own here), mixed, firsts."""
        ends = placed.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("key").alias("key"), F.sum("n").alias("n"), F.max("firsts").alias("firsts"))
        return ends.select("g", "key", "n", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("g")).alias("c"), (F.col("low") != F.col("high")).alias("mixed"), "firsts")

    def merged(placed: DataFrame, bridges: DataFrame) -> DataFrame:
        root = components(bridges)
        joined = placed.join(root.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        after = stored(joined.withColumn("label", F.coalesce("root", "label")).drop("root"))
        discard(root, placed)
        return after

    # Second pass: one partner for each group, by the members of the smallest ids.
    near = _open(runs, of_groups(placed).select("g", "c", F.lit(0).cast("bigint").alias("block"), "firsts"), percent, nearest=True)
    near = near.groupBy("g").agg(F.max_by("other", F.struct("shared", "other")).alias("h"), F.max("shared").alias("shared"))
    near = near.join(of_groups(placed).select("g", "n"), "g").where(40 * F.col("shared") >= F.col("n")).select("g", "h")
    pairs = near.join(heads.withColumnRenamed("key", "x"), "g").join(heads.select(F.col("g").alias("h"), F.col("key").alias("y")), "h")
    second = stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    late = stored(_linked(docs, second, described, percent))
    label = placed.select("key", "label").distinct()
    bridges = late.join(label.select(F.col("key").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("key").alias("b"), F.col("label").alias("lb")), "b")
    placed = merged(placed, bridges.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    discard(late)

    # Third pass, in blocks of what was compared so far.
    about = components(first.unionByName(second))
    near = about.select(F.col("node").alias("key"), F.col("label").alias("about"))
    groups = of_groups(placed).join(near, "key", "left").withColumn("about", F.coalesce("about", "key"))
    parts = groups.groupBy("about").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    groups = groups.join(parts, "about").withColumn("block", F.xxhash64("about", F.pmod(F.xxhash64("g"), F.col("parts"))))
    groups = stored(groups.select("g", "c", "mixed", "block", "firsts"))
    visits = _open(runs, groups.select("g", "c", "block", "firsts"), percent, nearest=False).select("g", F.col("other").alias("block"))
    visits = stored(visits.unionByName(groups.where("mixed").select("g", "block")).distinct())
    held = stored(placed.join(groups.select("g", "block"), "g"))
    near = stored(_bridges(docs, visits, held, described, percent, frequent).select(F.col("a").alias("g"), F.col("b").alias("block")).distinct())
    last = stored(_bridges(docs, near, held, described, percent))
    placed = merged(placed, last)
    discard(runs, members, first, second, about, groups, visits, held, near, last)

    label = placed.select("key", "label").distinct()

    rows = described.where("kind = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("key").alias("set_key"))
    ids = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("low"))
    ids = ids.join(label.withColumnRenamed("key", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    roots = ids.groupBy("label").agg(F.min("low").alias("component_id"))
    ids = ids.join(roots, "label").select("set_key", "component_id", F.col("label").alias("class_key"))
    full = rows.where("n_shingles > 0").join(ids, "set_key")
    empty = rows.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "class_key": F.col("set_key")})
    names = ["doc_id", "text_key", "n_shingles", "component_id", "class_key"]
    return full.select(*names).unionByName(empty.select(*names)), [described, placed]


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id."""
    return _classes(docs, percent)[0].select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, with one row of each class: that of the smallest doc_id (null last), then text hash.

    Documents without a shingle all stay.
    """
    found, tables = _classes(docs, percent)
    held = stored(found.where("n_shingles > 0").select("doc_id", "text_key", "component_id", "class_key"))
    discard(*tables)
    each = held.groupBy("doc_id", "text_key", "component_id", "class_key").agg(F.count("*").alias("n"))
    mine = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Several texts of a class under its smallest id (or without one): the smallest hash stays.
    rivals = each.where(mine).groupBy("class_key").agg(F.min("text_key").alias("first"), F.count("*").alias("n_texts")).where("n_texts > 1")
    late = each.where(mine).join(rivals, "class_key").where("text_key <> first").select("doc_id", "text_key")
    names = [F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")]
    gone = each.where(~mine).select("doc_id", "text_key").unionByName(late).distinct().select(*names)
    repeated = each.where(mine & (F.col("n") > 1)).select(*names)
    text = F.col("text").cast("string")
    same = lambda t: F.col("doc_id").cast("long").eqNullSafe(t["__id"]) & (F.xxhash64(text) == t["__key"])
    left = docs.join(gone, same(gone), "left_anti")
    once = left.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, same(repeated), "left_anti").unionByName(once)
