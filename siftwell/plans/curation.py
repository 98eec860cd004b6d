"""The batch run as one chain: range, evaluation, dedup, preselection, body, rescoring, summary, gates, event dedup, final
selection. Every excluded row keeps its reason in the audit.

A summary comes from the cache, else from the model (an injected callable, with a budget of calls, articles with bodies
first), else by the ladder of body, description, overseas title and title. The gates then judge it in order: the source's
own checks, the number of title summaries, quality, hard exclusions, and the item as it would be published."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import clean, matches
from siftwell.functions.times import in_range, local_date
from siftwell.functions.urls import canonical
from siftwell.operators import answers, dedup, quality, rules, selection, summaries, titles
from siftwell.operators.dedup import stored
from siftwell.packs import Pack


@dataclass(frozen=True)
class Run:
    items: DataFrame
    audit: DataFrame
    removed_events: DataFrame


def candidates(entries: DataFrame, pack: Pack, start: Column, end: Column) -> DataFrame:
    """Entries in the range, judged; source_allowed beside. Unlisted sources wait in recovery if strong."""
    rows = entries.where(in_range(F.col("published_at"), start, end) & F.col("title").isNotNull() & canonical(F.col("url")).isNotNull())
    rows = rules.evaluated(rows, pack, start, end).withColumn("source_allowed", rules.source_allowed(pack, F.col("source")))
    unlisted = F.when(F.col("connection_type").isNotNull(), "source_not_allowed_recovery_candidate").otherwise("source_not_allowed")
    out = F.when(F.col("exclude_reason").isNotNull(), F.col("exclude_reason")).when(~F.col("source_allowed"), unlisted)
    return rows.withColumns({"exclude_reason": out, "recovery": F.coalesce(out == "source_not_allowed_recovery_candidate", F.lit(False))})


def gated(rows: DataFrame, pack: Pack, order: list[Column], titles_at_most: int = 0) -> DataFrame:
    """rows with summary, summary_source, score and exclude_reason as the gates leave them; rows are a run's candidates, bounded by its limits.

    rows: id, title, description, source, category, url, body, score, summary, summary_source, title_summary. At most so
    many summaries of titles pass, in the order given, but any of explicit support for startups by partners. A description
    too like its title gets the title's summary while there is room.
    """
    t, src, body = F.col("title"), F.col("source"), F.coalesce("body", F.lit(""))

    def gate(summary: Column, source: Column) -> tuple[Column, Column, Column]:
        """The source's own reason, the quality's, and what comes after: hard exclusions and the item's own."""
        most, close = quality.limits(source)
        fine = F.coalesce(quality.summary_reason(pack, t, summary, most, close), F.when((source == "titleFallback") & ~quality.structured(pack, summary), "unstructured_title_fallback"))
        fine = F.when(source != "unavailable", F.concat(F.lit("summary_"), fine))
        described = F.coalesce(fine, F.concat(F.lit("summary_"), quality.model_description_reason(pack, t, summary, src)))
        own = F.when(source == "openai_description", described).otherwise(F.concat(F.lit("summary_"), quality.fallback_reason(pack, t, summary, src, source)))
        return own, fine, rules.hard_exclusion(pack, t, F.col("description"), body, summary)

    told = {"own": ("summary", "summary_source"), "title": ("title_summary", None)}
    out = rows
    for name, (summary, source) in told.items():
        own, fine, hard = gate(F.col(summary), F.col(source) if source else F.lit("titleFallback"))
        out = out.withColumns({f"__{name}_own": own, f"__{name}_fine": fine, f"__{name}_hard": hard})
    clear = lambda name: F.coalesce(*(F.col(f"__{name}_{k}") for k in ("own", "fine", "hard"))).isNull()
    alike = (F.col("summary_source") == "description") & (F.col("__own_fine") == "summary_title_summary_too_similar") & F.col("title_summary").isNotNull() & F.col("__title_fine").isNull()
    partners = matches(t, pack.concept("partnership"))
    titled = F.col("summary_source") == "titleFallback"
    out = out.withColumn("__passes", (alike & clear("title")) | (titled & clear("own")))
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("__room", F.coalesce(F.sum(F.col("__passes").cast("int")).over(earlier), F.lit(0)) < titles_at_most)
    again = alike & F.col("__room")
    reason = lambda name: F.coalesce(F.col(f"__{name}_own"), F.when(titled & ~F.col("__room") & ~partners, "title_fallback_limit"), F.col(f"__{name}_fine"), F.col(f"__{name}_hard"))
    out = out.withColumn("exclude_reason", F.when(again, reason("title")).otherwise(reason("own")))
    out = out.withColumns({"summary": F.when(again, F.col("title_summary")).otherwise(F.col("summary")), "summary_source": F.when(again, "titleFallback").otherwise(F.col("summary_source"))})
    out = out.withColumns({"score": rules.final_score(F.col("score"), F.col("summary_source"), F.lit(False)), "summary_type": F.col("summary_source")})
    kept = [c for c in out.columns if not c.startswith("__")]
    return out.withColumn("exclude_reason", F.coalesce("exclude_reason", quality.item_reason(pack))).select(*kept)


def by_model(eligible: DataFrame, pack: Pack, model: Callable[[str, str, str], str], calls: int) -> DataFrame:
    """id, summary, source of what the model made of the first articles, those with bodies first."""
    asked = eligible.orderBy(*summaries.summary_order(F.col("body"), F.col("id"))).limit(calls)
    full = F.length(clean(F.col("body"))) >= 300
    text = summaries.model_input(asked.where(full), pack).select("id", "text")
    rows = asked.join(text, "id", "left").select("id", "title", "source", "description", F.coalesce("text", "description").alias("text"), (~F.coalesce(full, F.lit(False))).alias("described"), F.lit("").alias("summary"))
    found = answers.answered(rows, model, pack).where("summary_by = 'model'")
    return found.join(rows.select("id", "described"), "id").select("id", "summary", F.when(F.col("described"), "openai_description").otherwise("openai_body").alias("source"))


def briefing(entries: DataFrame, bodies: DataFrame, pack: Pack, start: Column, end: Column, limits: selection.Limits = selection.Limits(), extract: int = 30, cache: DataFrame | None = None, model: Callable[[str, str, str], str] | None = None, calls: int = 12, titles_at_most: int = 0) -> Run:  # noqa: B008
    """entries: id, title, description, source, url, published_at, feed_priority, source_weight, is_domestic,
    category_hints; bodies: id, body; cache: key, summary. Returns the items, the audit of all judged rows, and events removed as repeats."""
    judged = stored(candidates(entries, pack, start, end))
    open_rows = judged.where(F.col("exclude_reason").isNull() | F.col("recovery"))
    kept = stored(dedup.articles(open_rows, [F.asc("recovery"), *dedup.dedup_order()]).drop("rank"))
    kept = kept.withColumn("protected", rules.protected(pack, F.col("title")))
    chosen = stored(selection.preselected(kept, per_category=max(2 * limits.per_category, 8), most=extract))

    full = rules.rescored(chosen.withColumn("exclude_reason", F.lit(None).cast("string")).join(bodies, "id", "left"), pack)
    full = stored(full)
    eligible = full.where("exclude_reason is null")
    by_body = summaries.extractive(eligible.where(F.length(F.coalesce("body", F.lit(""))) >= 300), pack).withColumnRenamed("summary", "body_summary")
    by_description = summaries.extractive(eligible.where(summaries.description_eligible(pack, F.col("description"))), pack, "description").withColumnRenamed("summary", "description_summary")
    told = titles.title_summaries(eligible.where(quality.title_eligible(pack, F.col("title"))), pack).select("id", F.col("summary").alias("title_summary"))
    better = [summaries.cached(eligible, cache, pack, kind).select("id", "summary", F.lit(kind).alias("source")) for kind in ("openai_body", "openai_description")] if cache is not None else []
    held = better[0].unionByName(better[1]) if better else eligible.select("id", F.lit("").alias("summary"), F.lit("").alias("source")).limit(0)
    if model is not None:
        held = stored(held.unionByName(by_model(eligible.join(held, "id", "left_anti"), pack, model, calls)))
    held = held.groupBy("id").agg(F.max(F.struct(F.col("source") == "openai_body", "summary", "source")).alias("best")).select("id", F.col("best.summary").alias("best_summary"), F.col("best.source").alias("best_source"))
    rows = eligible.join(by_body, "id", "left").join(by_description, "id", "left").join(told, "id", "left").join(held, "id", "left")
    overseas = F.when(F.col("category") == pack.overseas_category, summaries.overseas_sentence(pack, F.col("title")))
    rows = rows.withColumn("__s", summaries.ladder(F.col("body_summary"), F.col("description_summary"), overseas, F.col("title_summary"))).select("*", "__s.*")
    better_one = F.col("best_summary").isNotNull()
    rows = rows.withColumns({"summary": F.when(better_one, F.col("best_summary")).otherwise(F.col("summary")), "summary_source": F.when(better_one, F.col("best_source")).otherwise(F.col("summary_source"))})
    summed = gated(stored(rows.drop("__s")), pack, summaries.summary_order(F.col("body"), F.col("id")), titles_at_most)
    summed = stored(summed.drop("body_summary", "description_summary", "title_summary", "best_summary", "best_source"))
    good = summed.where("exclude_reason is null")

    both = rules.joined(F.col("title"), F.col("summary"))
    order = [summaries.source_rank(F.col("summary_source")).desc(), F.desc("score"), F.asc("id")]
    placed = dedup.ranked(good.withColumns({"event": rules.event_type(pack, both), "entities": rules.entities(pack, F.col("title")), "amounts": rules.event_amounts(both), "rounds": rules.event_rounds(both)}), order)
    unique, removed = dedup.by_event(placed)
    final = selection.constrained(unique.withColumn("published", local_date(F.col("published_at"))), limits)
    items = unique.join(final.select("id"), "id", "left_semi").withColumn("facts", rules.facts(pack, F.col("title"), F.col("summary")))

    late = full.where("exclude_reason is not null").select("id", "exclude_reason").unionByName(summed.where("exclude_reason is not null").select("id", "exclude_reason"))
    late = late.unionByName(removed.select("id", F.concat(F.lit("duplicate_event:"), "reason").alias("exclude_reason")))
    late = late.withColumnRenamed("exclude_reason", "late_reason")
    audit = judged.join(late, "id", "left").join(kept.select("id", F.lit(True).alias("kept")), "id", "left").join(chosen.select("id", F.lit(True).alias("chosen")), "id", "left").join(items.select("id", F.lit(True).alias("selected")), "id", "left")
    why = F.when(F.col("selected"), None).otherwise(F.coalesce("late_reason", F.when(F.col("chosen"), "final_rank_or_category_limit"), F.when(F.col("kept"), "preselection_rank_or_category_limit"), "exclude_reason", F.lit("duplicate")))
    return Run(items, audit.withColumns({"exclude_reason": why, "final_selected": F.coalesce("selected", F.lit(False))}).drop("late_reason", "kept", "chosen", "selected"), removed)
