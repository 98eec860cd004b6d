"""Reason-coded checks of summaries, items and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.similarity import text_similarity
from siftwell.functions.text import clean, fingerprint, match_form, matches, mostly_latin, without_particles
from siftwell.functions.urls import is_aggregator, is_http
from siftwell.operators.rules import entities, hard_exclusion
from siftwell.packs import Pack

#: Largest similarity with the title and largest length, by where a summary comes from.
SIMILARITY = {"openai_description": 1.01, "structured_overseas": 1.01, "local_extractive": 0.97}
LENGTH = {"openai_description": 120}


def structured(pack: Pack, text: Column) -> Column:
    t = clean(text)
    return (F.length(t) >= 18) & matches(t, pack.concept("structured_subject")) & matches(t, pack.concept("structured_action"))


def summary_reason(pack: Pack, title: Column, summary: Column, most: Column | int = 100, similarity: Column | float = 0.8, require_structured: bool = False) -> Column:
    """Why a summary won't do, or null."""
    t = clean(summary)
    out = (
        F.when(F.length(t) == 0, "empty_summary").when(F.length(t) > most, "summary_too_long").when(matches(t, pack.concept("summary_metadata")), "summary_contains_metadata")
        .when(text_similarity(title, summary) >= similarity, "title_summary_too_similar")
    )
    return out.when(~structured(pack, summary), "unstructured_title_fallback") if require_structured else out


def limits(source: Column) -> tuple[Column, Column]:
    """Largest length and similarity for a summary's source."""
    most, close = F.lit(100), F.lit(0.8)
    for k, v in LENGTH.items():
        most = F.when(source == k, v).otherwise(most)
    for k, v in SIMILARITY.items():
        close = F.when(source == k, v).otherwise(close)
    return most, close


def _source_only(summary: Column, source: Column) -> Column:
    own, name = fingerprint(summary), fingerprint(source)
    return (name != "") & (F.length(F.replace(own, name, F.lit(""))) < 12)


def title_eligible(pack: Pack, title: Column) -> Column:
    return matches(clean(title), pack.concept("title_event"))


def fallback_reason(pack: Pack, title: Column, summary: Column, source: Column, summary_source: Column) -> Column:
    """Why a description or title used as a summary won't do; null for others."""
    c, t = pack.concept, clean(summary)
    n = F.length(t)
    english = (summary_source == "description") & mostly_latin(t)
    own, full = fingerprint(t), fingerprint(title)
    concise = (n >= 25) & matches(t, c("structured_subject")) & matches(t, c("fallback_strong_event"))
    reason = (
        F.when(n == 0, "fallback_empty").when(n > 100, "fallback_too_long")
        .when(english & ((n < 60) | ~matches(t, c("english_event")) | ~t.rlike("[.!?][\"')\\]]?$")), "english_description_incomplete")
        .when(~english & (~matches(t, c("fallback_event")) | ~matches(t, c("report_ending"))), "noun_phrase_summary")
        .when((summary_source == "description") & ~english & (n < 40) & ~concise, "description_too_short")
        .when((summary_source == "titleFallback") & ~title_eligible(pack, title), "title_event_not_explicit")
        .when((own != "") & full.contains(own) & (F.length(own) < F.length(full) * 0.8), "truncated_title_summary")
        .when(_source_only(t, source), "source_name_only")
    )
    return F.when(summary_source.isin("description", "titleFallback"), reason)


def model_description_reason(pack: Pack, title: Column, summary: Column, source: Column) -> Column:
    """Why a model's summary of a description won't do, or null."""
    c, t = pack.concept, clean(summary)
    n = F.length(t)
    actor = matches(t, "[A-Za-z0-9가-힣&·._-]{2,40}(?:은|는|이|가|와|과)\\s") | matches(t, c("structured_subject"))
    brief = (n >= 25) & actor & matches(t, c("fallback_strong_event"))
    rewrite = (text_similarity(title, t) >= 0.95) & (without_particles(title, pack) == without_particles(t, pack))
    shared = F.arrays_overlap(entities(pack, title), entities(pack, t))
    name = "openai_description_"
    return (
        F.when((fingerprint(title) == "") | (fingerprint(title) == fingerprint(t)), name + "same_as_title")
        .when((n < 30) & ~brief, name + "too_short").when(n > 120, name + "too_long")
        .when(~matches(t, c("fallback_event")) | ~matches(t, c("report_ending")), name + "missing_event")
        .when(rewrite, name + "particle_only_rewrite").when(~F.coalesce(shared, F.lit(False)) & ~actor, name + "missing_entity").when(_source_only(t, source), "source_name_only")
    )


def unsupported_numbers(summary: Column, text: Column) -> Column:
    """Numbers that the summary states and the text doesn't."""
    of = lambda x: F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\d[\d,.]*\d|\d)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.array_except(of(summary), of(text))


def is_vague(pack: Pack, summary: Column) -> Column:
    form, out = match_form(summary), F.lit(False)
    for v in pack.vague:
        out = out | form.contains(v)
    return out


def item_reason(pack: Pack, required: tuple[str, ...] = ("title", "url", "source", "category", "summary_type")) -> Column:
    """Why a final item can't be published, or null; over columns title, url, source, category, summary_type, summary, description, body."""
    out = F.when(F.lit(False), "")
    for name in required:
        out = out.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", f"missing_{name}")
    out = out.when((F.trim(F.coalesce("summary", F.lit(""))) == "") & (F.col("summary_type") != "unavailable"), "missing_summary").when(is_aggregator(F.col("url")), "google_news_url_forbidden")
    hard = hard_exclusion(pack, F.col("title"), F.col("description"), F.col("body"), F.col("summary"))
    return F.coalesce(out, hard, F.when(~is_http(F.col("url")), "invalid_article_url"))


def document_checks(items: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Whether total, items and the sum of the categories' counts agree: one row."""
    summed = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_categories"))
    out = items.agg(F.count("*").alias("items")).crossJoin(summed).withColumn("total", F.lit(total).cast("long"))
    return out.withColumn("valid", (F.col("items") == F.col("total")) & (F.col("in_categories") == F.col("total")))
