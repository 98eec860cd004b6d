"""A language model's answers: what it is asked, what its answers claim, and the second try that is told what was wrong.

The model is an injected callable, run on the rows of each partition; its answers are checked in column expressions. What
fails a check goes back once more with the reason; what fails again keeps the local summary and its reason. Answers of a
round are stored, so that no check or lost executor asks the model again.

Defined cases: null titles, texts and answers count as empty; a model that raises leaves the local summary, with the
error as its reason; a claim is supported if any of the inputs states it, spaces and case aside, in either language's
form; repeated ids are asked each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import clean, regex
from siftwell.operators import quality, titles
from siftwell.operators.dedup import stored
from siftwell.packs import Pack

#: What an answer begins with and isn't part of it.
_LABEL = r"(?iu)^\s*(?:요약|summary)\s*[:：]\s*"


def response_text(payload: Column) -> Column:
    """The answer in a response's JSON: its output_text, else the first text of that type in its outputs' contents; ''."""
    whole = F.try_parse_json(payload)
    outputs = F.coalesce(F.try_variant_get(whole, "$.output", "array<variant>"), F.array().cast("array<variant>"))
    contents = F.flatten(F.transform(outputs, lambda o: F.coalesce(F.try_variant_get(o, "$.content", "array<variant>"), F.array().cast("array<variant>"))))
    is_text = lambda v, path: F.schema_of_variant(F.coalesce(F.try_variant_get(v, path, "variant"), F.parse_json(F.lit("null")))) == "STRING"
    told = F.filter(contents, lambda c: (F.try_variant_get(c, "$.type", "string") == "output_text") & is_text(c, "$.text"))
    first = F.try_variant_get(F.get(told, F.lit(0)), "$.text", "string")
    return F.coalesce(F.when(is_text(whole, "$.output_text"), F.try_variant_get(whole, "$.output_text", "string")), first, F.lit(""))


def claims(pack: Pack, summary: Column) -> Column:
    """Amounts, counts and rounds that a summary states."""
    return F.regexp_extract_all(F.coalesce(summary, F.lit("")), F.lit(regex(pack.concept("claim"))), F.lit(0))


def unsupported_claim(pack: Pack, summary: Column, context: Column) -> Column:
    """The first claim of a summary that its inputs don't state, or null."""
    stage = lambda c: F.array(c, F.regexp_replace(c, "(?i)^Series\\s*", "시리즈"), F.regexp_replace(c, "^시리즈\\s*", "Series "))
    return F.get(F.filter(claims(pack, summary), lambda c: ~F.exists(stage(c), lambda x: titles.holds(context, x))), F.lit(0))


def answer_reason(pack: Pack, title: Column, summary: Column, source: Column, context: Column, described: Column) -> Column:
    """Why an answer won't do, or null; described: whether it was made of a description, not of a body."""
    claim = unsupported_claim(pack, summary, context)
    close = F.when(described, 1.01).otherwise(0.8)
    return F.coalesce(
        quality.summary_reason(pack, title, summary, titles.MOST, close),
        F.when(described, quality.model_description_reason(pack, title, summary, source)),
        F.when(quality.is_vague(pack, summary), "vague_expression"),
        F.when(claim.isNotNull(), F.concat(F.lit("unsupported_claim:"), claim)),
    )


def answered(articles: DataFrame, model: Callable[[str, str, str], str], pack: Pack, attempts: int = 2) -> DataFrame:
    """id, summary, summary_by (model or local), attempt and reason of articles (id, title, source, description, text,
    described, summary) through the model, which gets the title, the text and the reason that failed its last answer ('' at first)."""
    kind = dict(articles.dtypes)["id"]
    columns = ["id", "title", "source", "description", "text", "described", "summary"]

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            answers, errors = [], []
            for row in rows.itertuples():
                try:
                    answers.append(model(row.title or "", row.text or "", row.reason or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure leaves the local summary
                    answers.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield rows.assign(answer=answers, error=errors)

    asked = articles.select(*columns).withColumn("reason", F.lit("").cast("string"))
    schema = ", ".join(f"{c} {t}" for c, t in asked.dtypes) + ", answer string, error string"
    context = F.concat_ws(" ", *(clean(F.col(c)) for c in ("title", "description", "text")))
    done: DataFrame | None = None
    for attempt in range(1, attempts + 1):
        told = titles.finalised(pack, F.regexp_replace(F.coalesce("answer", F.lit("")), _LABEL, ""))
        told = F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "").otherwise(told)
        judged = asked.mapInPandas(ask, schema).withColumn("answer", told)
        judged = judged.withColumn("reason", F.coalesce("error", answer_reason(pack, F.col("title"), F.col("answer"), F.col("source"), context, F.col("described"))))
        judged = stored(judged.withColumn("attempt", F.lit(attempt)))
        again = judged.where("reason is not null and error is null")
        ended = judged if attempt == attempts else judged.where("reason is null or error is not null")
        done = ended if done is None else done.unionByName(ended)
        asked = again.select(*columns, "reason")
    good = F.col("reason").isNull()
    return done.select(F.col("id").cast(kind).alias("id"), F.when(good, F.col("answer")).otherwise(F.col("summary")).alias("summary"), F.when(good, "model").otherwise("local").alias("summary_by"), "attempt", "reason")
