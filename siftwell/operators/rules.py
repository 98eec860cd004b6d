"""Rule packs compiled to column expressions: signals, exclusion reasons, categories, scores, extracted facts.

Every expression reads the given text columns; a pack's patterns become one `rlike` each, so a table is scanned once
and no rule needs a join. Rows keep all outcomes as columns; nothing is dropped here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import times
from siftwell.functions.text import any_matches, clean, contains_keyword, hits, let, match_form, matches, regex, single_spaces
from siftwell.packs import Pack



def joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))


def signals(pack: Pack, title: Column, description: Column, body: Column | None = None) -> Column:
    """`name:field` of each signal, in the first of title, description and body that it matches."""
    found = []
    for s in pack.signals:
        own = F.when(matches(title, s.pattern), f"{s.name}:title").when(matches(description, s.pattern), f"{s.name}:description")
        found.append(own.when(matches(body, s.pattern), f"{s.name}:body") if body is not None else own)
    return F.array_distinct(F.array_compact(F.array(*found)))


def has_signal_or_keyword(pack: Pack, text: Column) -> Column:
    """The gate for list links."""
    form = match_form(text)
    keyword = F.lit(False)
    for words in pack.categories.values():
        for w in words:
            keyword = keyword | contains_keyword(form, w)
    return any_matches(text, [s.pattern for s in pack.signals]) | keyword


def has_any_keyword(words: list[str], title: Column, description: Column) -> Column:
    return hits(match_form(joined(title, description)), words) > 0


def source_allowed(pack: Pack, source: Column) -> Column:
    """Equal to a listed source, contained in one or containing one, in match form; unnamed sources aren't."""
    form = match_form(source)
    own = F.lit(False)
    for name in pack.sources:
        own = own | form.contains(name.lower()) | F.lit(name.lower()).contains(form)
    return (form != "") & own


def hard_exclusion(pack: Pack, title: Column, description: Column, body: Column, summary: Column) -> Column:
    """The first hard reason that holds, or null."""
    c = pack.concept

    def first(x: Column) -> Column:
        current = matches(x["event"], c("event")) & (matches(x["event"], c("target")) | matches(x["event"], c("ecosystem")))
        listed = matches(x["all"], c("listed"), ignore_case=False)
        return (
            F.when(matches(x["event"], c("rights_issue")) & listed, "hard_exclude_public_company_rights_issue")
            .when((matches(x["title"], c("market_noise")) | matches(x["title"], c("market_words"))) & ~current, "hard_exclude_stock_market")
            .when(listed & matches(x["event"], c("plant")) & ~matches(x["lead"], c("direct_investment")), "hard_exclude_large_corp_industrial_investment")
            .when(matches(x["event"], c("award")), "hard_exclude_government_promotion_award")
            .when(matches(x["body"], c("origin")) & ~matches(x["title"], c("event")) & ~current, "hard_exclude_historical_venture_origin_only")
        )

    def cleaned(t: Column) -> Column:
        own = {"title": t, "event": clean(joined(t, body, summary)), "all": clean(joined(t, description, body, summary)), "lead": clean(joined(t, F.substring(F.coalesce(body, F.lit("")), 1, 1200))), "body": body}
        return F.struct(*(v.alias(k) for k, v in own.items()))

    return let(let(clean(title), cleaned), first)


@dataclass(frozen=True)
class Connection:
    """How an article connects with the pack's subject: type A to E or null, and what speaks against it."""

    kind: Column
    large_company: Column
    general_industry: Column
    missing: Column


def connection_struct(pack: Pack, title: Column, description: Column, body: Column) -> Column:
    """connection() as one struct (kind, large, general, missing): give it a column of its own, so that it is computed once."""
    c = pack.concept
    has = lambda text, name, fold=True: matches(text, c(name), fold)

    def cleaned(x: Column) -> Column:
        own = {"title": x["t"], "body": x["b"], "context": clean(joined(x["t"], description, x["b"])), "evidence": clean(joined(x["t"], x["b"])), "lead": F.substring(x["b"], 1, 700)}
        return F.struct(*(v.alias(k) for k, v in own.items()))

    def met(x: Column) -> Column:
        e, context = x["evidence"], x["context"]
        own = {n: has(e, n) for n in ("target", "ecosystem", "actor", "event", "market_event", "collaboration", "support", "financing")}
        own["subject"] = has(x["title"], "target") | (has(x["lead"], "target") & has(x["lead"], "event"))
        own["large"] = has(context, "large_company", False)
        own["general"] = has(context, "outlook") | has(context, "general_tech") | has(context, "achievement")
        own["capex"], own["invests"], own["editorial"] = has(context, "capex"), has(context, "investment"), has(context, "editorial")
        own["late"] = has(x["body"], "origin") & ~has(x["title"], "event")
        return F.struct(*(v.alias(k) for k, v in own.items()))

    def kind(m: Column) -> Column:
        own = (
            F.when(m["target"] & m["collaboration"] & m["actor"], "E")
            .when(m["actor"] & (m["target"] | m["ecosystem"]) & (m["support"] | m["financing"] | m["collaboration"]), "B")
            .when(m["financing"] & (m["target"] | m["ecosystem"] | m["invests"]), "C")
            .when(m["support"] & (m["target"] | m["ecosystem"]), "D")
            .when((m["subject"] & m["event"]) | m["market_event"], "A")
        )
        void = (~m["event"] & ~m["subject"] & ~m["market_event"]) | m["editorial"] | (m["late"] & ~m["market_event"])
        return F.struct(F.when(~void, own).alias("kind"), (m["general"] | (m["capex"] & ~m["target"] & ~m["ecosystem"])).alias("general"), m.alias("met"))

    def judged(k: Column) -> Column:
        m = k["met"]
        missing = F.array(
            F.when(~m["target"] & ~m["ecosystem"], "startup_or_venture_target"),
            F.when(~m["event"] & ~m["market_event"], "title_or_body_ecosystem_event"),
            F.when(m["large"] & k["kind"].isNull(), "startup_link_for_public_company"),
            F.when(k["general"] & k["kind"].isNull(), "startup_link_for_general_industry"),
        )
        return F.struct(k["kind"].alias("kind"), m["large"].alias("large"), k["general"].alias("general"), F.array_compact(missing).alias("missing"))

    texts = let(F.struct(clean(title).alias("t"), clean(body).alias("b")), cleaned)
    return let(let(let(texts, met), kind), judged)


def connection_of(struct: Column) -> Connection:
    return Connection(struct["kind"], struct["large"], struct["general"], struct["missing"])


def connection(pack: Pack, title: Column, description: Column, body: Column) -> Connection:
    return connection_of(connection_struct(pack, title, description, body))


def category_score(pack: Pack, category: str, title: Column, description: Column, hints: Column) -> Column:
    words = pack.categories[category]
    return F.least(hits(match_form(title), words), F.lit(3)) * 7 + F.least(hits(match_form(description), words), F.lit(4)) * 3 + F.when(F.coalesce(F.array_contains(hints, category), F.lit(False)), 2).otherwise(0)


def category_scores(pack: Pack, title: Column, description: Column, hints: Column) -> Column:
    """Array of (score, category, matched), best first; ties in the pack's order."""

    def ranked(s: Column) -> Column:
        rows = []
        for k, (name, words) in enumerate(pack.categories.items()):
            in_title, in_description = hits(s["t"], words), hits(s["d"], words)
            score = F.least(in_title, F.lit(3)) * 7 + F.least(in_description, F.lit(4)) * 3 + F.when(F.coalesce(F.array_contains(hints, name), F.lit(False)), 2).otherwise(0)
            rows.append(F.struct((-score).alias("minus"), F.lit(k).alias("place"), F.lit(name).alias("category"), (in_title + in_description > 0).alias("matched")))
        return F.transform(F.array_sort(F.array(*rows)), lambda r: F.struct((-r["minus"]).alias("score"), r["category"].alias("category"), r["matched"].alias("matched")))

    return let(F.struct(match_form(title).alias("t"), match_form(description).alias("d")), ranked)


def category(pack: Pack, title: Column, description: Column, hints: Column, best: Column | None, domestic: Column, kind: Column) -> Column:
    """The pack's categories in a cascade: first that holds. `best`: the best keyword category's struct, if any."""
    c, context = pack.concept, joined(title, description)
    hinted = F.coalesce(F.array_contains(hints, pack.overseas_category), F.lit(False))
    out = (
        F.when(matches(context, c("secondary")), pack.secondary_category)
        .when(matches(context, c("program")), pack.program_category)
        .when(~domestic & matches(context, c("overseas")) & hinted, pack.overseas_category)
        .when(matches(title, c("institutional_support")) | matches(title, c("partnership")), pack.default_category)
        .when(matches(title, c("direct_investment")), pack.investment_category)
        .when(matches(context, c("tech_business")), pack.tech_category)
        .when(matches(title, c("support_category")), pack.default_category)
        .when(matches(context, c("investment")), pack.investment_category)
    )
    if best is not None:
        out = out.when(best["matched"] & ~best["category"].isin(pack.investment_category, pack.overseas_category), best["category"])
    return out.when(kind == "C", pack.investment_category).otherwise(pack.default_category)


def exclusion(pack: Pack, title: Column, description: Column, category_of: Column, domestic: Column, link: Connection, defer: bool, spaced: Column | None = None) -> Column:
    """The first reason to exclude, or null. With `defer`, weak connections wait for the body; spaced: the description in single spaces, if at hand."""
    c, context = pack.concept, joined(title, description)
    weak = link.kind.isNull()
    out = F.when(matches(context, c("market_noise")) & weak, "stock_market_noise").when(matches(context, c("editorial")), "low_value_editorial_article")
    if not defer:
        out = out.when(link.large_company & weak, "public_company_or_large_corp_general").when(link.general_industry & weak, "general_industry_article").when(weak, "strong_connection_missing")
    overseas = ~domestic & (category_of == pack.overseas_category) & (~matches(context, c("overseas")) | matches(context, c("advice")))
    out = out.when(overseas if not defer else overseas & ~weak, "overseas_vc_signal_missing")
    return F.coalesce(hard_exclusion(pack, title, description if spaced is None else spaced, F.lit(""), F.lit("")), out)


def editorial_adjustment(pack: Pack, title: Column, description: Column, body: Column | None, category_of: Column) -> Column:
    c = pack.concept
    total = F.lit(0)
    for s in pack.signals:
        if s.title or s.description or s.body:
            own = F.when(matches(title, s.pattern), s.title).when(matches(description, s.pattern), s.description)
            total = total + (own.when(matches(body, s.pattern), s.body) if body is not None else own).otherwise(0)
    context = joined(title, description)
    everything = context if body is None else joined(context, body)
    event = matches(everything, c("strong_event"))
    total = total - F.when(matches(context, c("editorial")), 30).otherwise(0)
    total = total - F.when(matches(context, c("outlook")), F.when(event, 5).otherwise(16)).otherwise(0)
    total = total - F.when(matches(context, c("large_general")), F.when(event, 5).otherwise(18)).otherwise(0)
    overseas = F.when(matches(everything, c("overseas")), 8).otherwise(-24) - F.when(matches(context, c("advice")), 30).otherwise(0)
    return total + F.when(category_of == pack.overseas_category, overseas).otherwise(0)


def body_adjustment(pack: Pack, body: Column) -> Column:
    total = F.lit(0)
    for s in pack.signals:
        if s.body:
            total = total + F.when(matches(body, s.pattern), s.body).otherwise(0)
    return F.least(F.lit(12), total)


def relevance(pack: Pack, title: Column, description: Column, source: Column, published: Column, priority: Column, weight: Column, keyword_score: Column, category_of: Column, start: Column, end: Column) -> Column:
    form_title, form_description = match_form(title), match_form(description)
    tech = F.least(hits(form_title, pack.tech_words) * 5 + hits(form_description, pack.tech_words) * 2, F.lit(12))
    return (
        keyword_score
        + F.when(source_allowed(pack, source), 5).otherwise(0)
        + F.when(priority == "primary", 4).when(priority == "discovery", -2).otherwise(0)
        + F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(weight, F.lit(0))))
        + F.coalesce(times.freshness(published, start, end), F.lit(0))
        - F.when(F.length(F.coalesce(title, F.lit(""))) < 12, 4).otherwise(0)
        - F.least(hits(form_title, pack.advertising) * 4, F.lit(8))
        + F.when(category_of == pack.tech_category, tech).otherwise(0)
        + editorial_adjustment(pack, title, description, None, category_of)
    )


def evaluated(articles: DataFrame, pack: Pack, start: Column, end: Column) -> DataFrame:
    """Articles (title, description, source, published_at, feed_priority, source_weight, is_domestic, category_hints) with
    matched_signals, connection_type, is_large_company, is_general_industry, missing_signals, category, score,
    exclude_reason and provisional_reason."""
    t, d, hints = F.col("title"), F.col("description"), F.col("category_hints")
    # White space is put right once: what cleans a text again, alone or joined, then finds little to do.
    articles = articles.withColumn("__d", single_spaces(d))
    articles = articles.withColumn("__link", connection_struct(pack, t, F.col("__d"), F.lit("")))
    link = connection_of(F.col("__link"))
    rows = articles.withColumns(
        {
            "matched_signals": signals(pack, t, d),
            "connection_type": link.kind,
            "is_large_company": link.large_company,
            "is_general_industry": link.general_industry,
            "missing_signals": link.missing,
            "__scores": category_scores(pack, t, F.col("__d"), hints),
        }
    )
    held = Connection(F.col("connection_type"), F.col("is_large_company"), F.col("is_general_industry"), F.col("missing_signals"))
    rows = rows.withColumn("category", category(pack, t, d, hints, F.get("__scores", F.lit(0)), F.col("is_domestic"), held.kind))
    own = F.get(F.filter("__scores", lambda s: s["category"] == F.col("category")), F.lit(0))["score"]
    score = relevance(pack, t, d, F.col("source"), F.col("published_at"), F.col("feed_priority"), F.col("source_weight"), F.coalesce(own, F.lit(0)), F.col("category"), start, end)
    weak = held.kind.isNull()
    score = score + F.when(weak, -14).otherwise(10) - F.when(held.large_company & weak, 12).otherwise(0) - F.when(held.general_industry & weak, 10).otherwise(0)
    none = F.size("matched_signals") == 0
    reason = F.when(none, "broad_signal_missing").otherwise(exclusion(pack, t, d, F.col("category"), F.col("is_domestic"), held, defer=True, spaced=F.col("__d")))
    provisional = F.when(held.large_company, "public_company_or_large_corp_general").when(held.general_industry, "general_industry_article").otherwise("strong_connection_missing")
    return rows.withColumns({"score": score.cast("int"), "exclude_reason": reason}).withColumn("provisional_reason", F.when(weak & F.col("exclude_reason").isNull(), provisional)).drop("__scores", "__link", "__d")


def rescored(articles: DataFrame, pack: Pack) -> DataFrame:
    """evaluated() articles with a body: judged again without deferral; body score, late connections and signals added."""
    t, d, b = F.col("title"), F.col("description"), F.coalesce("body", F.lit(""))
    both = joined(d, b)
    articles = articles.withColumns({"__d": single_spaces(d), "__b": single_spaces(b)})
    articles = articles.withColumn("__link", connection_struct(pack, t, F.col("__d"), F.col("__b")))
    link = connection_of(F.col("__link"))
    rows = articles.withColumns({"__kind": link.kind, "__large": link.large_company, "__general": link.general_industry, "__signals": signals(pack, t, d, b)})
    held = Connection(F.col("__kind"), F.col("__large"), F.col("__general"), F.array())
    rows = rows.withColumn("category", category(pack, t, both, F.col("category_hints"), None, F.col("is_domestic"), held.kind))
    late = F.col("connection_type").isNull() & held.kind.isNotNull()
    score = F.col("score") + body_adjustment(pack, b) + F.when(late, 24).otherwise(0)
    rows = rows.withColumn("post_reason", exclusion(pack, t, both, F.col("category"), F.col("is_domestic"), held, defer=False, spaced=joined(F.col("__d"), F.col("__b"))))
    rows = rows.withColumns({"score": score.cast("int"), "matched_signals": F.array_distinct(F.concat("matched_signals", "__signals")), "connection_type": held.kind, "is_large_company": held.large_company, "is_general_industry": held.general_industry})
    return rows.withColumn("exclude_reason", F.coalesce("exclude_reason", "post_reason")).drop("__link", "__kind", "__large", "__general", "__signals", "post_reason", "__d", "__b")


def final_score(score: Column, summary_source: Column, unresolved: Column) -> Column:
    return F.greatest(F.lit(0), score - F.when(summary_source == "titleFallback", 5).when(summary_source == "unavailable", 20).otherwise(0) - F.when(unresolved, 8).otherwise(0))


def first_match(text: Column, patterns: list[str], group: int = 1, ignore_case: bool = True) -> Column:
    """The group of the first pattern that matches, or null."""
    found = [F.nullif(F.trim(F.regexp_extract(text, regex(p, ignore_case), group)), F.lit("")) for p in patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def first_label(text: Column, labels: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for label, pattern in reversed(labels):
        out = F.when(matches(text, pattern), label).otherwise(out)
    return out


def company(pack: Pack, title: Column, summary: Column) -> Column:
    """By verb pattern, in quotes, as a sentence's subject; null if none."""

    def named(t: Column) -> Column:
        quoted = F.nullif(F.regexp_extract(t, "[‘“'\"]([^’”'\"]{2,35})[’”'\"]", 1), F.lit(""))
        return F.coalesce(first_match(t, pack.companies[:2], 1, ignore_case=False), quoted, first_match(clean(joined(t, summary)), pack.companies[2:], 1, ignore_case=False))

    return let(F.regexp_replace(clean(title), r"\s*\|\s*[^|]{2,40}$", ""), named)


def facts(pack: Pack, title: Column, summary: Column) -> Column:
    """Struct of company, amount, stage, event and industry."""

    def found(x: Column) -> Column:
        return F.struct(
            x["company"].alias("company"),
            F.when(~x["amount"].rlike(r"[€$£]\s*\d+[.,]$"), x["amount"]).alias("amount"),
            first_match(x["text"], pack.stages).alias("stage"),
            first_label(x["text"], pack.event_labels).alias("event"),
            first_label(x["text"], pack.industries).alias("industry"),
        )

    named = company(pack, title, summary)
    return let(let(clean(joined(title, summary)), lambda t: F.struct(t.alias("text"), first_match(t, pack.amounts).alias("amount"), named.alias("company"))), found)


def stored_or_found(stored: dict[str, Column], found: Column) -> Column:
    """facts() with what a published item states itself in the first place."""
    names = ("company", "amount", "stage", "event", "industry")
    return F.struct(*(F.coalesce(F.nullif(stored.get(n, F.lit(None).cast("string")), F.lit("")), found[n]).alias(n) for n in names))


def event_type(pack: Pack, text: Column) -> Column:
    return first_label(match_form(text), pack.event_types)


def event_amounts(text: Column) -> Column:
    found = F.regexp_extract_all(match_form(text), F.lit(r"(\d[\d,.]*\s*(?:조|억|만)(?:\s*원)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda a: F.regexp_replace(a, r"[\s,]", "")))


def event_rounds(text: Column) -> Column:
    found = F.regexp_extract_all(match_form(text), F.lit(r"((?:프리[-\s]?)?(?:시리즈|series)\s*[a-z])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda a: F.regexp_replace(F.regexp_replace(a, "^series", "시리즈"), r"[\s-]", "")))


def entities(pack: Pack, title: Column) -> Column:
    """Distinct tokens that may name someone: no stop words, none that begin with a digit."""
    bare = F.regexp_replace(F.regexp_replace(match_form(title), r"\[[^\]]*\]|\([^)]*\)", " "), r"[^\p{L}\p{N}&·_-]+", " ")
    words = F.transform(F.split(bare, r"\s+"), lambda w: F.regexp_replace(w, r"^[._-]+|[._-]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*pack.stopwords) & ~w.rlike(r"^\d|^(?:프리)?시리즈[a-z]$")))


def importance(score: Column, domestic: Column, found: Column) -> Column:
    plus = lambda c, n: F.when(c.isNotNull() & (c != ""), n).otherwise(0)
    return score + F.when(domestic, 8).otherwise(0) + plus(found["amount"], 8) + plus(found["stage"], 6) + plus(found["event"], 4) + plus(found["company"], 2)


def is_overseas(pack: Pack, category_of: Column, source: Column, host: Column) -> Column:
    out = category_of == pack.overseas_category
    for name in pack.overseas_sources:
        out = out | F.lower(source).contains(name.lower())
    for name in pack.overseas_hosts:
        out = out | (host == name) | host.endswith("." + name)
    return F.coalesce(out, F.lit(False))


def protected(pack: Pack, title: Column) -> Column:
    """Titles that preselection doesn't count among the ordinary ones."""
    t = clean(title)
    return matches(t, pack.concept("direct_investment")) | (matches(t, pack.concept("program")) & matches(t, r"선정|선발|selected"))


