"""Extractive summaries and the templates, ladders and model hook around them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.similarity import counts_of, dice_of_counts, jaccard, multiset_dice
from siftwell.functions.text import SPACES, addresses_only, clean, contains_keyword, description_hash, fingerprint, grams_of, hits, let, match_form, matches, mostly_latin, regex, sentences, short_hash, single_spaces, tokens
from siftwell.functions.urls import canonical
from siftwell.packs import Pack

MOST = 100


def sanitised(pack: Pack, sentence: Column, source: Column) -> Column:
    """Without tags, agency marks, dates, addresses and bullets; '' if only the source's name is left."""
    out = clean(sentence)
    for pattern, instead in pack.strip:
        cut = lambda t: F.regexp_replace(t, pattern if pattern.startswith("(?") else f"(?iu){pattern}", instead)  # noqa: B023, E731
        out = let(out, lambda t: F.when(t.contains("@"), cut(t)).otherwise(t)) if addresses_only(pattern) else cut(out)  # noqa: B023
    out = F.trim(F.regexp_replace(single_spaces(out), r"^[▶◆■●※]\s*", ""))
    only = F.trim(F.regexp_replace(F.lower(out), r"[\s|·:.-]+$", "")) == F.lower(clean(source))
    return F.when(only, "").otherwise(out)


def complete(pack: Pack, sentence: Column) -> Column:
    n = F.length(sentence)
    english = matches(sentence, pack.concept("english_event")) & sentence.rlike("[.!?][\"')\\]]?$")
    return n.between(25, MOST) & F.when(mostly_latin(sentence), english).otherwise(matches(sentence, pack.concept("complete_ending")))


def _points(pairs: list[tuple[Column, int]]) -> Column:
    total = F.lit(0)
    for test, n in pairs:
        total = total + F.when(test, n).otherwise(0)
    return total


def title_view(pack: Pack, title: Column) -> Column:
    """What a title's sentences are compared with, once per title: fingerprint, tokens, and whether it tells of money or support."""
    plain = clean(title)
    told = {"investment": pack.concept("investment_title"), "support": pack.concept("support_title")}
    return F.struct(fingerprint(title).alias("print"), tokens(title).alias("tokens"), *(matches(plain, p).alias(k) for k, p in told.items()))


def closeness(view: Column, print_: Column, words: Column) -> Column:
    """text_similarity of a title's view and a sentence's fingerprint and tokens where it reaches 0.8, else 0.

    Below that it decides nothing. Neither measure reaches it if the sizes differ too much, as they mostly do.
    """
    n, m = F.length(view["print"]) - 1, F.length(print_) - 1
    grams = lambda p: counts_of(grams_of(p))
    dice = F.when((n > 0) & (m > 0) & (2 * F.least(n, m) >= 0.8 * (n + m) - 1e-9), dice_of_counts(grams(view["print"]), grams(print_))).otherwise(0.0)
    many = F.least(F.size(view["tokens"]), F.size(words)) >= 0.8 * F.greatest(F.size(view["tokens"]), F.size(words)) - 1e-9
    share = F.when(many, jaccard(view["tokens"], words)).otherwise(0.0)
    near = let(F.greatest(share, dice), lambda c: F.when(c >= 0.8, c).otherwise(0.0))
    return F.when((print_ != "") & (print_ == view["print"]), 1.0).otherwise(near)


def sentence_score(pack: Pack, sentence: Column, form: Column, view: Column, words: Column, close: Column, category: Column, place: Column) -> Column:
    """What a sentence is worth; form: its match form, view: the title's, words: its tokens, close: closeness to the title."""
    c, n = pack.concept, F.length(sentence)
    has = lambda name: matches(sentence, c(name))
    score = F.when(n < 18, -30).when(n <= 120, 10).when(n <= 180, 3).otherwise(-25)
    score = score + _points([(contains_keyword(form, k), w) for k, w in pack.sentence_weights])
    for name, known in pack.category_words.items():
        score = score + F.when(category == name, 5 * hits(form, known)).otherwise(0)
    invest = F.when(has("investment_fact"), 45).otherwise(-55) + _points([(has("investment_size"), 14), (has("investor"), 11), (has("use_of_funds"), 9)])
    support = F.when(has("support_fact"), 25).otherwise(-12) + _points([(has("support_actor"), 8), (has("support_size"), 9), (has("ceremony") & ~has("support_fact"), -30)])
    score = score + F.when(view["investment"], invest).otherwise(0) + F.when(view["support"], support).otherwise(0)
    score = score + _points([(has("money"), 9), (has("subject"), 5), (has("action"), 8), (has("institution"), 6), (has("weak"), -20), (has("advert"), -35), (has("stock_sentence"), -35), (has("promotion"), -25)])
    score = score + F.greatest(F.lit(0), 4 - place)
    score = score + F.least(4 * F.size(F.array_intersect(view["tokens"], words)), F.lit(16))
    score = score + F.when(mostly_latin(sentence), F.when(close >= 0.95, -20).when(close >= 0.8, -5).otherwise(0)).otherwise(F.when(close >= 0.96, -50).when(close >= 0.8, -10).otherwise(0))
    return score + F.when(category == pack.tech_category, F.when(has("context"), 12).when(~has("action"), -35).otherwise(0)).otherwise(0)


def scored_sentences(articles: DataFrame, pack: Pack, text: str = "body") -> DataFrame:
    """id, place, sentence, score, usable of each distinct sentence of the articles (id, title, category, source, text).

    Repeats are found within the row, by sorting its sentences: nothing is shuffled.
    """
    meta = pack.concept("sentence_metadata")
    rows = articles.select("id", "category", "source", title_view(pack, F.col("title")).alias("view"), sentences(F.col(text)).alias("raw"))
    told = F.transform("raw", lambda s, i: F.struct(i.alias("place"), s.alias("raw")))
    told = F.filter(told, lambda s: ~matches(s["raw"], meta))
    told = F.transform(told, lambda s: F.struct(s["place"].alias("place"), sanitised(pack, s["raw"], F.col("source")).alias("sentence")))
    told = F.filter(told, lambda s: (s["sentence"] != "") & ~matches(s["sentence"], meta))
    # A sanitised sentence has plain spaces only.
    keyed = F.array_sort(F.transform(told, lambda s: F.struct(F.lower(F.translate(s["sentence"], " ", "")).alias("key"), s["place"].alias("place"), s["sentence"].alias("sentence"))))
    rows = rows.select("id", "category", "view", keyed.alias("keyed"))
    first = F.filter("keyed", lambda s, i: (i == 0) | (F.get(F.col("keyed"), i - 1)["key"] != s["key"]))
    rows = rows.select("id", "category", "view", F.explode(first).alias("s")).select("id", "category", "view", "s.place", "s.sentence")
    rows = rows.withColumns({"form": match_form(F.col("sentence")), "print": fingerprint(F.col("sentence")), "words": tokens(F.col("sentence"))})
    rows = rows.withColumn("close", closeness(F.col("view"), F.col("print"), F.col("words")))
    score = sentence_score(pack, F.col("sentence"), F.col("form"), F.col("view"), F.col("words"), F.col("close"), F.col("category"), F.col("place"))
    rows = rows.withColumn("score", score)
    usable = (F.col("score") >= 0) & (F.col("close") < 0.96) & ~matches(F.col("sentence"), pack.concept("weak")) & complete(pack, F.col("sentence"))
    return rows.select("id", "place", "sentence", "score", usable.alias("usable"))


def extractive(articles: DataFrame, pack: Pack, text: str = "body") -> DataFrame:
    """id and summary: the best usable sentence, and if it is short the next that adds something."""
    # Gathered by a condition, not filtered: a filter would sink below the scores and compute them all again, column by column.
    best = F.sort_array(F.collect_list(F.when(F.col("usable"), F.struct((-F.col("score")).alias("worth"), "place", "sentence"))))
    rows = scored_sentences(articles, pack, text).groupBy("id").agg(best.alias("best")).where(F.size("best") > 0)
    rows = rows.select("id", F.transform("best", lambda s: s["sentence"]).alias("best")).withColumn("first", F.get("best", F.lit(0)))

    def unlike(own: Column, other: Column) -> Column:
        views = F.struct(fingerprint(own).alias("p"), tokens(own).alias("t"), fingerprint(other).alias("q"), tokens(other).alias("u"))
        return let(views, lambda v: (v["p"] != v["q"]) & (F.greatest(jaccard(v["t"], v["u"]), multiset_dice(grams_of(v["p"]), grams_of(v["q"]))) < 0.65))

    fits = lambda s, i: (i > 0) & (F.length("first") + 1 + F.length(s) <= MOST) & unlike(F.col("first"), s)
    second = F.when(F.length("first") < 45, F.get(F.filter("best", fits), F.lit(0)))
    return rows.select("id", F.concat_ws(" ", "first", second).alias("summary"))


def description_eligible(pack: Pack, description: Column) -> Column:
    t = clean(description)
    words = [w for w, _ in pack.sentence_weights]
    return F.when(mostly_latin(t), (F.length(t) >= 60) & matches(t, pack.concept("english_event"))).otherwise((F.length(t) >= 80) | (hits(match_form(t), words) > 0))


def overseas_sentence(pack: Pack, title: Column) -> Column:
    """A sentence of company, amount, stage and purpose from an English funding title; null without company, verb or amount."""
    c = pack.concept
    part = lambda text, name, group, fold=True: F.nullif(F.regexp_extract(text, regex(c(name), fold), group), F.lit(""))

    def parts(t: Column) -> Column:
        amount = part(t, "funding_amount", 0)
        after = F.regexp_replace(F.substr(t, F.instr(t, amount) + F.length(amount)), r"^[\s,;:–—-]+", "")
        purpose = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(after, "(?i)^to\\s+(.+)$", 1), "[.;|]+$", "")), F.lit(""))
        stage = F.coalesce(part(t, "funding_seed", 0), part(t, "funding_series", 0))
        return F.struct(part(t, "funding_verb", 1, False).alias("company"), F.lower(part(t, "funding_verb", 2, False)).alias("verb"), clean(amount).alias("amount"), amount.rlike(r"[€$£]\s*\d+[.,]$").alias("cut"), stage.alias("stage"), purpose.alias("purpose"))

    def told(x: Column) -> Column:
        label = F.when(x["stage"].isNull(), "funding round").when(x["stage"].rlike(r"(?i)\bround\b"), x["stage"]).otherwise(F.concat(x["stage"], F.lit(" round")))
        extended = F.concat(x["company"], F.lit(" extended its "), label, F.lit(" to "), x["amount"], F.lit(" in total funding."))
        base = F.concat(x["company"], F.lit(" raised "), x["amount"], F.coalesce(F.concat(F.lit(" in a "), x["stage"], F.lit(" round")), F.lit("")))
        full = F.concat(base, F.coalesce(F.concat(F.lit(" to "), x["purpose"]), F.lit("")), F.lit("."))
        raised = F.when(F.length(full) <= MOST, full).otherwise(F.concat(base, F.lit(".")))
        out = F.when(x["verb"].startswith("extend"), extended).otherwise(raised)
        good = x["company"].isNotNull() & (x["amount"] != "") & ~x["cut"] & (F.length(out) <= MOST) & ~out.rlike(r"[€$£]\s*\d+(?:[.,]\d+)?[.!?]$")
        return F.when(good, out)

    bare = F.trim(F.regexp_replace(F.regexp_replace(clean(title), regex(c("funding_tail")), ""), regex(c("funding_head"), False), ""))
    return let(let(bare, parts), told)


def summary_order(body: Column, place: Column) -> list[Column]:
    """Articles with a body of 300 characters first, else as they come."""
    return [(F.length(clean(body)) >= 300).desc(), place.asc()]


def summary_key(url: Column, title: Column, description: Column, source: Column) -> Column:
    """The key under which a summary is cached: by canonical URL, title, description and kind of summary."""
    return short_hash(24, F.coalesce(canonical(url), clean(url)), fingerprint(title), description_hash(description), clean(source))


def cached(articles: DataFrame, cache: DataFrame, pack: Pack, source: str) -> DataFrame:
    """id, summary of the articles (id, url, title, description, source) whose cached summary still passes the checks.

    cache: key, summary. The kind `openai_description` has its own limits and checks.
    """
    from siftwell.operators import quality

    described = source == "openai_description"
    keyed = articles.withColumn("key", summary_key(F.col("url"), F.col("title"), F.col("description"), F.lit(source)))
    rows = keyed.join(cache.select("key", "summary"), "key")
    good = quality.summary_reason(pack, F.col("title"), F.col("summary"), 120 if described else 100, 1.01 if described else 0.8).isNull()
    if described:
        good = good & quality.model_description_reason(pack, F.col("title"), F.col("summary"), F.col("source")).isNull()
    return rows.where(good).select("id", "summary")


def request_metrics(requests: DataFrame) -> DataFrame:
    """One row of counters over the model's requests (error, seconds, tokens; a null error is a success)."""
    kind = limit_kind(F.col("error"))
    bad = F.col("error").isNotNull()
    counters = {"requests": F.count("*"), "succeeded": F.count_if(~bad), "failed": F.count_if(bad), "daily_limits": F.count_if(bad & (kind == "daily")), "rate_limits": F.count_if(bad & kind.isin("rpm", "tpm"))}
    return requests.agg(*(c.alias(k) for k, c in counters.items()), F.round(F.sum("seconds"), 3).alias("seconds"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def ladder(body_summary: Column, description_summary: Column, overseas_summary: Column, title_summary: Column) -> Column:
    """Struct of the first summary there is, and its source."""
    steps = [(body_summary, "local_extractive"), (description_summary, "description"), (overseas_summary, "structured_overseas"), (title_summary, "titleFallback")]
    full = [(F.nullif(F.trim(c), F.lit("")), name) for c, name in steps]
    source = F.lit("unavailable")
    for c, name in reversed(full):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return F.struct(F.coalesce(*(c for c, _ in full)).alias("summary"), source.alias("summary_source"))


#: How sources rank when items of one event are compared.
SOURCE_RANK = {"openai_body": 5, "openai_description": 4, "local_extractive": 3, "extractive_body": 3, "structured_overseas": 3, "description": 2, "titleFallback": 1, "unavailable": 0}


def source_rank(source: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])[source], F.lit(0))


def model_input(articles: DataFrame, pack: Pack, lead: int = 1500, most: int = 3500, keys: int = 8) -> DataFrame:
    """id, text and estimated_tokens of articles (id, title, source, category, description, body): what a model is given.

    The text is the body's beginning and, beyond it, the first key sentences (20 characters at least, each once), `most`
    characters at most; all of it is chosen within the row.
    """
    rows = articles.select("id", "title", "source", "category", "description", clean(F.col("body")).alias("full")).withColumn("lead", F.trim(F.substring("full", 1, lead)))
    # Cheap tests first: most sentences are short or in the lead.
    told = F.filter(F.transform(sentences(F.col("full")), lambda s: clean(s)), lambda s: (F.length(s) >= 20) & ~F.col("lead").contains(s) & matches(s, pack.concept("key_sentence")) & ~matches(s, pack.concept("sentence_metadata")))
    sorted_ = F.array_sort(F.transform(told, lambda s, i: F.struct(F.lower(F.regexp_replace(s, SPACES, "")).alias("key"), i.alias("place"), s.alias("sentence"))))
    rows = rows.withColumn("told", sorted_)
    once = F.filter("told", lambda s, i: (i == 0) | (F.get(F.col("told"), i - 1)["key"] != s["key"]))
    first = F.slice(F.array_sort(F.transform(once, lambda s: F.struct(s["place"].alias("place"), s["sentence"].alias("sentence")))), 1, keys)
    listed = F.array_join(F.transform(first, lambda s: s["sentence"]), "\n")
    text = F.when(F.col("lead") == "", "").otherwise(F.trim(F.substring(F.concat("lead", F.when(listed == "", "").otherwise(F.concat(F.lit(f"\n{pack.key_heading}\n"), listed))), 1, most)))
    given = F.concat_ws(" ", *(clean(F.col(c)) for c in ("title", "source", "category")), F.substring(clean(F.col("description")), 1, lead), "text")
    return rows.withColumn("text", text).select("id", "text", (F.ceil(F.length(clean(given)) / 2) + 350).alias("estimated_tokens"))


#: How a refusal's message tells its kind.
LIMIT_KINDS = {"daily": r"requests? per day|\brpd\b|daily", "tpm": r"tokens? per min|\btpm\b", "rpm": r"requests? per min|\brpm\b"}
_DURATION = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}


def limit_kind(message: Column) -> Column:
    """daily, tpm, rpm or unknown."""
    out = F.lit("unknown")
    for kind, pattern in reversed(LIMIT_KINDS.items()):
        out = F.when(F.lower(message).rlike(pattern), kind).otherwise(out)
    return out


def limit_of(message: str) -> tuple[str, float | None]:
    """A refusal's kind as by limit_kind, and after how many seconds it says to try again."""
    text = message.lower()
    kind = next((k for k, pattern in LIMIT_KINDS.items() if re.search(pattern, text)), "unknown")
    after = re.search(r"(?:try again|retry)[^0-9]*((?:[0-9.]+(?:ms|h|m|s))+)", text)
    seconds = sum(float(n) * _DURATION[u] for n, u in re.findall(r"([0-9.]+)(ms|h|m|s)", after[1])) if after else None
    return kind, seconds
