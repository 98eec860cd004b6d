"""Similarity of titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import fingerprint, grams_of, let, search_title, tokens


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""

    def share(s: Column) -> Column:
        both, n = F.size(F.array_intersect(s["a"], s["b"])), F.size(F.array_union(s["a"], s["b"]))
        return F.when((F.size(s["a"]) > 0) & (F.size(s["b"]) > 0), both / n).otherwise(F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def multiset_dice(a: Column, b: Column) -> Column:
    """Of two arrays with repeats: twice the sum of the smaller counts, by both sizes."""
    return dice_of_counts(counts_of(a), counts_of(b))


def counts_of(items: Column) -> Column:
    """Map from each item to how often it occurs. Equal items are neighbours once sorted, so first places tell."""

    def counted(s: Column) -> Column:
        ends = lambda p, i: F.coalesce(F.get(p, i + 1), (F.size(s["all"]) + 1).cast("bigint"))
        return let(F.transform(s["each"], lambda x: F.array_position(s["all"], x)), lambda p: F.map_from_arrays(s["each"], F.transform(p, lambda first, i: ends(p, i) - first)))

    return let(let(F.sort_array(items), lambda s: F.struct(s.alias("all"), F.array_distinct(s).alias("each"))), counted)


def dice_of_counts(a: Column, b: Column) -> Column:
    """multiset_dice of two maps of counts_of."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda n, x: n + x)

    def share(s: Column) -> Column:
        both = F.aggregate(F.array_intersect(F.map_keys(s["a"]), F.map_keys(s["b"])), F.lit(0).cast("bigint"), lambda n, x: n + F.least(s["a"][x], s["b"][x]))
        return F.when((F.size(s["a"]) > 0) & (F.size(s["b"]) > 0), 2 * both / (total(s["a"]) + total(s["b"]))).otherwise(F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def forms(text: Column) -> Column:
    """What titles are compared by: fingerprint, tokens and counted bigrams. For a text compared often, a column of its own."""
    return let(F.struct(fingerprint(text).alias("print"), tokens(text).alias("tokens")), lambda s: F.struct(s["print"].alias("print"), s["tokens"].alias("tokens"), counts_of(grams_of(s["print"])).alias("grams")))


def close_forms(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the larger of both measures, of two forms()."""
    measured = F.greatest(jaccard(a["tokens"], b["tokens"]), dice_of_counts(a["grams"], b["grams"]))
    return F.when((a["print"] != "") & (a["print"] == b["print"]), F.lit(1.0)).otherwise(measured)


def similar_forms(a: Column, b: Column, least_jaccard: float = 0.72, least_dice: float = 0.88) -> Column:
    near = (a["print"] == b["print"]) | (jaccard(a["tokens"], b["tokens"]) >= least_jaccard) | (dice_of_counts(a["grams"], b["grams"]) >= least_dice)
    return (a["print"] != "") & (b["print"] != "") & near


def similar_titles(a: Column, b: Column, least_jaccard: float = 0.72, least_dice: float = 0.88) -> Column:
    """Equal fingerprints, or tokens or bigrams close enough; never with an empty title."""
    return let(F.struct(forms(a).alias("a"), forms(b).alias("b")), lambda s: similar_forms(s["a"], s["b"], least_jaccard, least_dice))


def text_similarity(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the larger of both measures."""
    return let(F.struct(forms(a).alias("a"), forms(b).alias("b")), lambda s: close_forms(s["a"], s["b"]))


def search_similarity(a: Column, b: Column) -> Column:
    """Equal 1; contained, the share of the length; else Dice of bigram sets."""

    def close(s: Column) -> Column:
        x, y = s["x"], s["y"]
        gx, gy = F.array_distinct(grams_of(x)), F.array_distinct(grams_of(y))
        dice = F.when(F.size(gx) + F.size(gy) > 0, 2 * F.size(F.array_intersect(gx, gy)) / (F.size(gx) + F.size(gy))).otherwise(F.lit(0.0))
        within = x.contains(y) | y.contains(x)
        share = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
        return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).when(within, share).otherwise(dice)

    return let(F.struct(search_title(a).alias("x"), search_title(b).alias("y")), close)
