"""Lookups and similarity joins. Which physical join runs is left to the planner and its size checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.similarity import counts_of, jaccard
from siftwell.functions.text import bigrams, fingerprint, tokens


def first_lookup(rows: DataFrame, dimension: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """Left join to the first row of the dimension per key."""
    first = Window.partitionBy(*on).orderBy(*order)
    return rows.join(dimension.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"), on, "left")


def default_lookup(rows: DataFrame, counts: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Left join, defaults where there is no partner."""
    return rows.join(counts, on, "left").fillna(defaults)


def either_contains(rows: DataFrame, names: DataFrame, left: Column, right: Column) -> DataFrame:
    """Rows whose text contains a name or is contained in one; names is a short list."""
    return rows.join(names, (left != "") & (left.contains(right) | right.contains(left)), "left_semi")


def flagged(rows: DataFrame, selected: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows with whether their key is among the selected."""
    return rows.join(selected.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def rejected(rows: DataFrame, selected: DataFrame, on: list[str], reason: str) -> DataFrame:
    return rows.join(selected.select(*on), on, "left_anti").withColumn("exclude_reason", F.lit(reason))


def longest_prefix(urls: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """urls (key, origin, path) with `allowed`: the rule (origin, kind, prefix) with the longest prefix decides; ties allow."""
    found = urls.join(rules, "origin").where(F.col("path").startswith(F.col("prefix")))
    best = found.groupBy(key).agg(F.max_by("kind", F.struct(F.length("prefix"), (F.col("kind") == "allow").cast("int"))).alias("kind"))
    return urls.join(best, key, "left").withColumn("allowed", F.coalesce(F.col("kind") == "allow", F.lit(True))).drop("kind")


def upserted(audit: DataFrame, key: list[str], score: str) -> DataFrame:
    """One row per key, that with the highest score."""
    best = Window.partitionBy(*key).orderBy(F.desc(score), *[F.asc(c) for c in audit.columns if c not in (*key, score) and dict(audit.dtypes)[c].split("<")[0] not in ("array", "map", "struct")])
    return audit.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def updated(audit: DataFrame, updates: DataFrame, key: list[str], fallback: str, value: str) -> DataFrame:
    """audit with `value` from the update of the same key, else of the same fallback column."""
    exact = updates.groupBy(*key).agg(F.max(value).alias("__exact"))
    loose = updates.groupBy(fallback).agg(F.max(value).alias("__loose"))
    return audit.join(exact, key, "left").join(loose, fallback, "left").withColumn(value, F.coalesce("__exact", "__loose", value)).drop("__exact", "__loose")


def suffix_match(hosts: Column, hints: Column) -> Column:
    """Whether the host ends with one of the hints (array)."""
    return F.exists(hints, lambda h: (hosts == h) | hosts.endswith(F.concat(F.lit("."), h)))


def _prefix_pairs(rows: DataFrame, items: str, least: float) -> DataFrame:
    """Pairs of ids that share an item of both prefixes: rare items first, lossless for Jaccard, which needs an overlap of ceil(t n)."""
    bound = F.ceil(F.col("n") * least - 1e-9)
    flat = rows.select("id", F.size(items).alias("n"), F.explode(items).alias("item"))
    common = flat.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    # Items of one row only pair nothing, but count as the rarest when prefixes are measured.
    ranked = flat.join(common, "item", "left").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "item")))
    head = ranked.where((F.col("place") <= F.col("n") - bound + 1) & F.col("df").isNotNull()).select("item", "id", "n")
    other = head.select("item", F.col("id").alias("id2"), F.col("n").alias("n2"))
    fits = (F.col("id") < F.col("id2")) & (F.least("n", "n2") >= F.greatest("n", "n2") * least - 1e-9)
    return head.join(other, "item").where(fits).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


#: Rows and bytes of signatures of a block, rows that are compared at once, bits that are, blocks that a larger band has at least.
BLOCK_ROWS, BLOCK_BYTES, STEP, STEP_BITS, SPLIT = 32768, 8_000_000, 512, 1 << 21, 4


def _dealt(spark) -> int:
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number's 64 bits, mixed (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_keys(form: str) -> np.ndarray:
    """A text's bigrams as sorted numbers, one for each."""
    points = np.frombuffer(form.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.sort(points[:-1] << 21 | points[1:])


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Hashes of sorted keys, each repeat told apart: as a set they overlap as often as the keys do with repeats."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    nth = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
    return _mixed(_mixed(keys) + nth.astype(np.uint64))


def _gram_hashes(form: str) -> np.ndarray:
    return _numbered(_gram_keys(form))


def _word_hashes(words: str) -> np.ndarray:
    return _mixed(np.array([int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for w in words.split(" ")], np.uint64))


def _widths(band: int, width: float) -> tuple[int, int]:
    """Bits of a signature of the band, and how many of them an item flips."""
    upper = float(np.exp((band + 1) * width))
    bits = 1 << min(16, max(7, int(np.ceil(np.log2(1.25 * upper)))))
    return bits, max(1, min(16, int(bits / (2 * upper))))


def _signature(hashes: np.ndarray, bits: int, flips: int) -> bytes:
    """Bits that each item flips in `flips` places: two sets differ in no more bits than that many for each item that one of them lacks."""
    places = [(_mixed(hashes + np.uint64(k)) if k else hashes) & np.uint64(bits - 1) for k in range(flips)]
    return np.packbits((np.bincount(np.concatenate(places).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _near(x: tuple, y: tuple, same: bool, bits: int, flips: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks (ids, sizes, signatures) that may reach the Dice; the smaller id first."""
    step = max(16, min(STEP, STEP_BITS // bits))

    def parts(ids, sizes, signs):
        order = np.argsort(sizes, kind="stable")
        for k in range(0, len(order), step):
            own = order[k : k + step]
            yield ids[own], sizes[own], np.unpackbits(signs[own], axis=1).astype(np.float32) * 2 - 1

    ratio, a, b = least / (2 - least), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x_ids, x_sizes, x_signs in parts(*x):
        for y_ids, y_sizes, y_signs in parts(*y):
            if min(x_sizes[-1], y_sizes[-1]) < ratio * max(x_sizes[0], y_sizes[0]) - 1e-9 or same and y_sizes[-1] < x_sizes[0]:
                continue  # sorted by size: even the closest sizes differ too much, or the pair of parts has met the other way
            # The product is the bits less twice those that differ.
            i, j = np.nonzero(x_signs @ y_signs.T >= bits - 2 * flips * (1 - least) * (x_sizes[:, None] + y_sizes[None, :]) - 0.01)
            fits = np.minimum(x_sizes[i], y_sizes[j]) >= ratio * np.maximum(x_sizes[i], y_sizes[j]) - 1e-9
            fits &= x_ids[i] != y_ids[j]
            i, j = i[fits], j[fits]
            a.append(np.minimum(x_ids[i], y_ids[j]))
            b.append(np.maximum(x_ids[i], y_ids[j]))
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return pairs[0], pairs[1]


def _like_pairs(rows: DataFrame, size: Column, column: str, hashes: Callable[[str], np.ndarray], least: float) -> DataFrame:
    """Pairs of ids whose items may reach the Dice, none of those that do left out; hashes gives a column's items, told apart.

    Prose shares most of its bigrams, so that no prefix tells texts apart. Rows are dealt into bands by size, as wide as
    sizes may differ, and bands into blocks of bounded rows and bytes; a block meets those of its band and of the next.
    What meets is not the items but a signature of about a bit for each, and a matrix product counts the bits that
    differ. Work grows with the pairs of like sizes, memory with a block, disk with the signatures.
    """
    spark, width = rows.sparkSession, float(-np.log(least / (2 - least) - 1e-6))
    rows = rows.select(F.col("id").cast("bigint").alias("id"), size.alias("n"), F.col(column).alias("items")).where("n > 0")
    rows = rows.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    # A few dozen bands, whatever the rows.
    held = {r["band"]: r["n"] for r in rows.groupBy("band").agg(F.count("*").alias("n")).collect()}
    parts = {k: max(-(-n // BLOCK_ROWS), -(-n * (_widths(k, width)[0] // 8) // BLOCK_BYTES), min(-(-n // (8 * STEP)), SPLIT)) for k, n in held.items()}
    meets = sum(p * (p + 1) // 2 + p * parts.get(k + 1, 0) for k, p in parts.items())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_bytes = [], 0
            for i, n, items, band in zip(*(batch.column(k).to_pylist() for k in ("id", "n", "items", "band")), strict=True):
                own = hashes(items)
                part = int(_mixed(np.array([i], np.int64))[0] % np.uint64(parts[band]))
                key = lambda low, across, p, q: (low * 2 + across) << 40 | p << 20 | q
                sent = [(key(band, 0, min(part, q), max(part, q)), part > q) for q in range(parts[band])]
                sent += [(key(band, 1, part, q), False) for q in range(parts.get(band + 1, 0))]
                signed = _signature(own, *_widths(band, width))
                out += [(m, second, i, n, signed) for m, second in sent]
                if band - 1 in parts:
                    lower = _signature(own, *_widths(band - 1, width))
                    out += [(key(band - 1, 1, q, part), True, i, n, lower) for q in range(parts[band - 1])]
                n_bytes += len(signed) * len(sent)
                if n_bytes > BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, n_bytes = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names, kinds = ["meet", "second", "id", "n", "signed"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    # Few bytes make much work, so that sizes don't tell how many tasks to make of them.
    tasks = max(1, min(meets, 4 * _dealt(spark)))
    met = rows.mapInArrow(sign, "meet bigint, second boolean, id bigint, n bigint, signed binary").repartition(tasks, "meet")

    def run(table: pa.Table) -> pa.Table:
        meet = table.column("meet")[0].as_py()
        low, across, same = meet >> 41, meet >> 40 & 1, not meet >> 40 & 1 and (meet >> 20 & 0xFFFFF) == (meet & 0xFFFFF)
        second, bits = table.column("second").to_numpy(), _widths(low, width)
        ids, sizes = table.column("id").to_numpy(), table.column("n").to_numpy()
        signs = np.frombuffer(b"".join(table.column("signed").to_pylist()), np.uint8).reshape(len(ids), bits[0] // 8)
        x, y = ((ids[m], sizes[m], signs[m]) for m in (~second, ~second if same else second))
        a, b = _near(x, y, same, *bits, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("meet").applyInArrow(run, "a bigint, b bigint").distinct()


def _dice_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of ids whose fingerprints' bigrams (with repeats) may reach the Dice; rows: id, fp."""
    return _like_pairs(rows, F.length("fp") - 1, "fp", _gram_hashes, least)


def _word_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs of ids whose distinct words may reach the Jaccard, which is a Dice of 2 t / (1 + t); rows: id, words (with single spaces)."""
    n = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.translate("words", " ", "")) + 1)
    return _like_pairs(rows, n, "words", _word_hashes, 2 * least / (1 + least))


@lru_cache(maxsize=64)
def _word_set(words: str) -> frozenset:
    return frozenset(words.split(" ") if words else ())


@lru_cache(maxsize=64)
def _gram_counts(form: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_gram_keys(form), return_counts=True)


def _dice(f: str, g: str) -> float:
    """Of the bigrams of two fingerprints, with repeats; equal ones have 1."""
    if f == g or min(len(f), len(g)) < 2:
        return float(f == g)
    (x, n), (y, m) = _gram_counts(f), _gram_counts(g)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 2 * int(np.minimum(n[i], m[j]).sum()) / (len(f) + len(g) - 2)


def similar_title_pairs(titles: DataFrame, least_jaccard: float = 0.72, least_dice: float = 0.88) -> DataFrame:
    """a < b (ids), jaccard and dice of similar titles, found by signatures and compared in full; titles: id, title.

    Give each distinct title once (its repeats are similar to the same titles); equal fingerprints have Dice 1.
    """
    from siftwell.operators.dedup import stored  # it imports this module

    # Formed once, by all cores: the joins below read the forms many times.
    spark = titles.sparkSession
    rows = titles.repartition(_dealt(spark), "id").select("id", fingerprint(F.col("title")).alias("fp"), F.array_join(tokens(F.col("title")), " ").alias("words"))
    rows = stored(rows.where("fp <> ''"))
    single = rows.where("length(fp) = 1").select("id", F.array("fp").alias("fps"))
    pairs = _word_pairs(rows, least_jaccard).union(_dice_pairs(rows, least_dice)).union(_prefix_pairs(single, "fps", 1.0)).distinct()
    x, y = (rows.select(F.col("id").alias(k), F.col("fp").alias(f"f{k}"), F.col("words").alias(f"w{k}")) for k in ("a", "b"))
    full = stored(pairs).join(x, "a").join(y, "b").select("a", "b", "fa", "fb", "wa", "wb").repartition(_dealt(spark))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, f, g, v, w in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "fa", "fb", "wa", "wb")), strict=True):
                s, t = _word_set(v), _word_set(w)
                share = len(s & t) / len(s | t) if s and t else 0.0
                close = _dice(f, g)
                if share >= least_jaccard or close >= least_dice:
                    out.append((a, b, share, close))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "jaccard", "dice"])

    kind = rows.schema["id"].dataType.simpleString()
    return full.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "fa", "fb", "wa", "wb").mapInArrow(measured, "a bigint, b bigint, jaccard double, dice double").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "jaccard", "dice")


def _numbered_grams(counts: Column) -> Column:
    """Items by how often they occur, each repeat told apart: as a set they overlap as often as the items do with repeats."""
    return F.flatten(F.transform(F.map_entries(counts), lambda e: F.transform(F.sequence(F.lit(1).cast("bigint"), e["value"]), lambda i: F.concat(e["key"], F.lit("#"), i.cast("string")))))


def event_forms(items: DataFrame) -> DataFrame:
    """What event_pairs compares, of the items (rank, title, event, entities, amounts, rounds) that have an event and a named token."""
    t = F.col("title")
    return items.where("event is not null").where(F.size("entities") > 0).select("rank", "event", "entities", "amounts", "rounds", fingerprint(t).alias("fp"), tokens(t).alias("t"), _numbered_grams(counts_of(bigrams(t))).alias("g"))


def event_pairs(earlier: DataFrame, later: DataFrame, least: float = 0.55) -> DataFrame:
    """a < b (ranks of earlier and later) and reason of items about one event; both of event_forms, `earlier` small enough for every task.

    The pairs share type and a named token; tokens that name nobody (`stopwords`) are out already.
    """
    named = earlier.select(F.col("rank").alias("a"), "event", F.explode("entities").alias("entity"))
    shared = later.select(F.col("rank").alias("b"), "event", F.explode("entities").alias("entity")).join(F.broadcast(named), ["event", "entity"]).where("a < b").select("a", "b").distinct()
    x, y = (rows.select(F.col("rank").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in rows.columns if c != "rank")) for rows, k in ((earlier, "a"), (later, "b")))
    full = shared.join(y, "b").join(F.broadcast(x), "a")
    # As the later item tells it: its own first entity, amount and round that the earlier one has too.
    first = lambda c: F.get(F.array_intersect(f"{c}_b", f"{c}_a"), F.lit(0))
    same = F.concat_ws("", F.lit("same_event:"), "event_a", F.lit(", entity:"), first("entities"))
    fact = F.concat_ws("", same, F.concat(F.lit(", amount:"), first("amounts")), F.concat(F.lit(", round:"), first("rounds")))
    dice = F.when((F.size("g_a") > 0) & (F.size("g_b") > 0), 2 * F.size(F.array_intersect("g_a", "g_b")) / (F.size("g_a") + F.size("g_b"))).otherwise(F.lit(0.0))
    close = F.when(F.col("fp_a") == F.col("fp_b"), 1.0).otherwise(F.greatest(jaccard(F.col("t_a"), F.col("t_b")), dice))
    reason = F.when(F.arrays_overlap("amounts_a", "amounts_b") | F.arrays_overlap("rounds_a", "rounds_b"), fact).when(close >= least, F.concat(same, F.lit(", similar_title")))
    return full.withColumn("reason", reason).where("reason is not null").select("a", "b", "reason")
