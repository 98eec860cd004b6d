"""Headlines as report sentences: who, what, and the facts that a description adds.

A headline is taken apart (subject, clause, leading quotation) by one Arrow UDF that minds quotes and brackets; all else is
column expressions in steps, a projection each, so that nothing is computed twice. What sentence a kind of event gets is
data: a pack's `templates` and `title_templates` are rows with conditions and slots, compiled to one ordered CASE.
Sentences of a description are scored within the row; nothing is shuffled.

Defined cases: null titles and descriptions count as empty; a headline without a known subject keeps its clause alone, and
one without anything to say gets the pack's `no_summary`; equal scores go to the sentence that comes first; columns other
than id, title and description are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.similarity import close_forms, forms
from siftwell.functions.text import SPACES, clean, contains_keyword, let, match_form, matches, object_particle, regex, subject_particle
from siftwell.packs import Pack, Template

MOST = 100
#: Quotes with what closes them, and what a name is written in.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_NAME = "[A-Za-z0-9가-힣][A-Za-z0-9가-힣&·._-]{1,29}"
_PARTICLE = "(?:은|는|이|가)"
_SENTENCE_END = r"[.!?。](?:\s|$)"


def prepared(text: Column) -> Column:
    """Clean, without a tag in brackets before and "and others" behind."""
    out = F.regexp_replace(F.regexp_replace(clean(text), r"^\[[^\]]+\]\s*", ""), r"\s+(?:外|등)$", "")
    return F.trim(F.regexp_replace(out, SPACES, " "))


# --- a headline's parts ----------------------------------------------------------------------------------------------


class Headline:
    """Takes headlines apart; they and their descriptions come prepared."""

    def __init__(self, pack: Pack):
        spaced = lambda words: "|".join(re.escape(w).replace(r"\ ", r"\s*") for w in words) or "(?!)"
        self.action = re.compile(rf"\s(?:{spaced(pack.actions)})")
        self.actions = pack.actions
        self.end = re.compile(rf"\s+(?:{spaced(pack.subject_ends)}).*$", re.S)
        self.nobody = frozenset(pack.nobody)

    @staticmethod
    def quoted(title: str) -> tuple[list[tuple[int, int]], int]:
        """Spans of quotations with their marks (an open one reaches to the end), and the place of the first comma outside them, or -1."""
        spans, comma, begin = [], -1, None
        for k, c in enumerate(title):
            if begin is not None:
                if c == QUOTES[title[begin]]:
                    spans.append((begin, k + 1))
                    begin = None
            elif c in QUOTES:
                begin = k
            elif c == "," and comma < 0:
                comma = k
        return spans + ([(begin, len(title))] if begin is not None else []), comma

    def named(self, head: str) -> str:
        """The name that a headline's beginning comes down to, or ''."""
        last = re.search(r"[“‘\"']([^”’\"']{2,24})[”’\"']\s*$", head)
        if last and not any(a in last[1] for a in self.actions):
            name = last[1].strip()
        else:
            name = re.sub(r"^[\"“'‘][^\"”'’]{2,45}[\"”'’]\s*", "", head)
            name = self.end.sub("", re.sub(r"^.*(?:…|\.{3,})\s*", "", name))
            name = re.sub(r"[“”‘’\"']", "", name).strip()
        return "" if len(name) > 35 or name in self.nobody else name

    def __call__(self, title: str, description: str) -> tuple[str, str, str]:
        """Subject, clause and leading quotation; '' for what there isn't, the clause is the whole title then."""
        _, comma = self.quoted(title)
        subject = clause = ""
        if comma >= 0:
            subject, clause = self.named(title[:comma]), title[comma + 1 :].strip()
        elif speaker := re.match(rf"({_NAME})\s+(?=[\"“'‘])", title):
            subject, clause = speaker[1], title[speaker.end() :].strip()
        elif (action := self.action.search(title)) and action.start() > 1:
            subject, clause = self.named(title[: action.start()]), title[action.start() :].strip()
        if not subject and (told := re.search(rf"(?:^|[.!?]\s*)({_NAME}){_PARTICLE}\s", description)):
            subject = told[1]
        if not clause and subject and title.startswith(subject):
            clause = re.sub(r"^[은는이가,\s]+", "", title[len(subject) :]).strip()
        leading = re.match(r"[\"“'‘]([^\"”'’]{2,45})[\"”'’]", title)
        return subject, clause or title, leading[1].strip() if leading else ""


def analysed(pack: Pack, title: Column, description: Column) -> Column:
    """Struct of subject, clause and leading, from a prepared title and description."""

    @F.arrow_udf("subject string, clause string, leading string")
    def parts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        take = Headline(pack)
        for titles, descriptions in batches:
            rows = [take(t or "", d or "") for t, d in zip(titles.to_pylist(), descriptions.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["subject", "clause", "leading"])

    return parts(title, description)


# --- endings ---------------------------------------------------------------------------------------------------------


def without_quotes(text: Column) -> Column:
    """Quotes out, ellipses as commas, commas spaced but within numbers and none at the ends."""
    out = F.regexp_replace(F.regexp_replace(clean(text), "[“”‘’\"']", ""), r"\s*(?:…|\.{3,})\s*", ", ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*,\s*", ", "), r"(?<=\d),\s+(?=\d)", ",")
    return F.trim(F.regexp_replace(F.regexp_replace(out, SPACES, " "), r"^[,\s]+|[,\s]+$", ""))


def report_ending(pack: Pack, text: Column) -> Column:
    """A clause with the endings of reports: longest verb endings first, until none is left; applying it again changes nothing."""
    stems = [f"(?<={stem})(?:{'|'.join(sorted(ends, key=len, reverse=True))})(?:다)?$" for stems, ends in pack.report_stems for stem in stems.split("|")]
    out = F.regexp_replace(without_quotes(text), r"(\d)\s*(조|억|만)\s*원", "$1$2 원")
    out = F.regexp_replace(F.regexp_replace(out, "(?<=[A-Za-z0-9_])外$", ""), "투자유치", "투자 유치")
    for _ in range(2):  # what a plan's ending leaves may end in a verb, and no further
        out = F.trim(F.regexp_replace(out, r"[.!?。]+$", ""))
        if stems:
            out = F.regexp_replace(out, "|".join(stems), "")
        for pattern, instead in pack.report_plans:
            out = F.regexp_replace(out, pattern, instead)
    return F.trim(out)


def joined_ending(pack: Pack, text: Column) -> Column:
    """A clause as the first of two: its ending leads on to the next."""
    out = report_ending(pack, text)
    for pattern, instead in pack.joined_endings:
        out = F.regexp_replace(out, pattern, instead)
    return out


def report_cut(pack: Pack, text: Column, most: int = MOST) -> Column:
    """The text, or so many characters at most: whole words, then its ending or that of a statement."""

    def cut(t: Column) -> Column:
        ending = F.regexp_extract(t, f"(?:{'|'.join(pack.cut_endings) or '(?!)'})$", 0)
        room = F.when(ending == "", most - 2).otherwise(most - 1 - F.length(ending))
        begun = F.substr(t, F.lit(1), room)
        words = F.trim(F.regexp_replace(begun, r"\s+\S*$", ""))
        whole = F.concat(F.when(words == "", begun).otherwise(words), F.lit(" "), F.when(ending == "", "함").otherwise(ending))
        return F.when(F.length(t) <= most, t).otherwise(whole)

    return let(F.regexp_replace(clean(text), "[.!?。…]+$", ""), cut)


# --- facts -----------------------------------------------------------------------------------------------------------


def _squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(clean(text), SPACES, ""))


def holds(text: Column, fact: Column) -> Column:
    """Whether the text states the fact, spaces and case aside; an empty fact is stated anywhere."""
    return _squeezed(text).contains(_squeezed(fact))


def headline_facts(pack: Pack, title: Column, description: Column) -> Column:
    """Struct of amount, stage and count, from the title or else the description (both prepared); '' for what isn't there."""
    found = lambda name: clean(F.coalesce(*(F.nullif(F.regexp_extract(t, regex(pack.concept(f"fact_{name}")), 0), F.lit("")) for t in (title, description)), F.lit("")))
    amount = F.trim(F.regexp_replace(F.regexp_replace(found("amount"), r"(\d)\s*(조|억|만)\s*원", "$1$2 원"), SPACES, " "))
    stage = F.regexp_replace(F.regexp_replace(found("stage"), r"(?i)^(?:series|시리즈)\s*", "시리즈"), r"^프리[-\s]?시리즈\s*", "프리시리즈")
    return F.struct(amount.alias("amount"), F.trim(stage).alias("stage"), found("count").alias("count"))


def with_facts(pack: Pack, clause: Column, facts: Column, names: tuple[str, ...]) -> Column:
    """The clause with those of the facts that it lacks: amount and stage before it, the count before what is done to so many."""

    def put(c: Column) -> Column:
        before = [(F.concat(facts["amount"], F.lit(" 규모")), facts["amount"])] if "amount" in names else []
        before += [(facts["stage"], facts["stage"])] if "stage" in names else []
        lacking = F.array_join(F.filter(F.array(*(F.when(~holds(c, fact), said) for said, fact in before)), lambda x: x.isNotNull()), " ") if before else F.lit("")
        if "count" in names:
            n, act = facts["count"], r"\s(선정|모집|발표|개최|개소)(?=$|\s)"
            placed = F.when(c.rlike(act), F.concat(F.substr(c, F.lit(1), _at(c, act)), n, F.substr(c, _at(c, act)))).otherwise(F.concat(n, F.lit(" "), c))
            placed = F.when(c.rlike(r"\s(?:지원|확대)(?=$|\s)"), F.concat(n, F.lit(" 대상으로 "), c)).otherwise(placed)
            c = F.when(holds(c, n), c).otherwise(placed)
        return report_ending(pack, F.concat(lacking, F.lit(" "), c))

    return let(clause, put)


def _at(text: Column, pattern: str) -> Column:
    """Place (from 1) of the pattern's first match, which must be there."""
    return F.length(F.split(text, pattern, 2)[0]) + 1


# --- sentences of the description ------------------------------------------------------------------------------------


def _sentences(description: Column) -> Column:
    return F.filter(F.transform(F.split(description, _SENTENCE_END, -1), lambda s: F.trim(s)), lambda s: s != "")


def _best(rows: Column) -> Column:
    """The text of the struct (score, text) with the highest score, the first of equal ones; '' if there is none."""
    ranked = F.transform(rows, lambda r, i: F.struct(r["score"].alias("score"), (-i).alias("place"), r["text"].alias("text")))
    return F.coalesce(F.array_max(ranked)["text"], F.lit(""))


def _without_subject(text: Column, subject: Column) -> Column:
    own = F.regexp_replace(F.substr(text, F.length(subject) + 1), rf"^{_PARTICLE}?\s*", "")
    return F.when((subject != "") & text.startswith(subject), own).otherwise(text)


def action_clause(pack: Pack, description: Column, subject: Column) -> Column:
    """What a description says was done: of its sentences with an action, the longest, most specific one about the subject."""
    action = "|".join(w.replace(" ", r"\s*") for w in pack.actions) or "(?!)"
    kept = F.filter(_sentences(description), lambda s: s.rlike(action) & ~matches(s, pack.concept("body_boilerplate")))

    def rated(sentence: Column) -> Column:
        text = _without_subject(F.trim(F.regexp_replace(sentence, r"\s+-\s+[^-]{2,60}$", "")), subject)

        def named(t: Column) -> Column:
            at = F.instr(t, subject)
            later = F.trim(F.regexp_replace(F.substr(t, at + F.length(subject)), r"^[은는이가,\s]+", ""))
            return report_ending(pack, F.when((subject != "") & at.between(1, 60), later).otherwise(t))

        def worth(c: Column) -> Column:
            n = F.least(F.length(c), F.lit(70)) + 12 * F.regexp_count(c, F.lit(pack.concept("specific_support")))
            return F.struct((n + F.when((subject != "") & sentence.contains(subject), 40).otherwise(0)).alias("score"), c.alias("text"))

        return let(let(text, named), worth)

    return _best(F.transform(kept, rated))


def supporting_clause(pack: Pack, description: Column, title: Column, subject: Column) -> Column:
    """What a description adds to the title: 18 to 180 characters, unlike the title, best with purposes and measures."""
    boilerplate = pack.concept("body_boilerplate")

    def chosen(own: Column) -> Column:
        of = F.transform(F.transform(_sentences(description), lambda s: report_ending(pack, s)), lambda s: F.struct(s.alias("text"), close_forms(own, forms(s)).alias("close")))
        of = F.filter(of, lambda s: F.length(s["text"]).between(18, 180) & (s["close"] < 0.65) & ~matches(s["text"], boilerplate))
        score = lambda s: F.least(F.length(s["text"]), F.lit(90)) + F.when(matches(s["text"], pack.concept("purpose")), 35).otherwise(0) + F.when(matches(s["text"], pack.concept("measure")), 20).otherwise(0) - 100 * s["close"]
        return _best(F.transform(of, lambda s: F.struct(score(s).alias("score"), s["text"].alias("text"))))

    clause = _without_subject(let(forms(title), chosen), subject)
    for opener in pack.openers:
        clause = F.regexp_replace(clause, f"^{opener}", "")
    return report_ending(pack, F.trim(clause))


# --- templates -------------------------------------------------------------------------------------------------------


def filled(shape: str, slots: dict[str, Column]) -> Column:
    """A template's shape with its slots filled."""
    parts, at = [], 0
    for slot in re.finditer(r"\{(\w+)(?:([?:])([^}]*))?\}", shape):
        parts.append(F.lit(shape[at : slot.start()]))
        value, at = slots[slot[1]], slot.end()
        if slot[2] == "?":
            value = F.when(value == "", "").otherwise(F.concat(value, F.lit(slot[3])))
        elif slot[2] == ":":
            value = F.when((value == "") | value.rlike("[을를]$"), value).otherwise(F.concat(value, object_particle(value)))
        parts.append(value)
    return F.concat(*parts, F.lit(shape[at:]))


def met(template: Template, title: Column, context: Column, prepared_title: Column, subject: Column) -> Column:
    """Whether the template's event is met."""
    out = F.lit(True)
    if template.pattern:
        out = out & matches(prepared_title, template.pattern)
    if template.subject:
        out = out & matches(subject, template.subject)
    for words in template.words:
        some = F.lit(False)
        for w in words:
            some = some | contains_keyword(match_form(title if template.title_only else context), w)
        out = out & some
    return out


def dispatched(templates: list[Template], tests: list[Column], results: list[Column]) -> Column:
    out = F.lit(None)
    for template, test, result in reversed(list(zip(templates, tests, results, strict=True))):
        out = F.when(test, result).otherwise(out)
    return out


def composed(pack: Pack, subject: Column, clause: Column) -> Column:
    """Subject with its particle and clause; the clause alone where it has a subject."""

    def put(c: Column) -> Column:
        own = holds(c, subject) | c.rlike(rf"^[A-Za-z0-9가-힣&·._-]{{2,35}}{_PARTICLE}\s")
        return F.when((subject == "") | own, c).otherwise(F.trim(F.concat(subject, subject_particle(subject), F.lit(" "), c)))

    return let(report_ending(pack, clause), put)


def finalised(pack: Pack, text: Column) -> Column:
    return let(report_cut(pack, report_ending(pack, text)), lambda t: F.when(t == "", pack.no_summary).otherwise(t))


def _told(rows: DataFrame, pack: Pack, title: str, description: str, to: str) -> DataFrame:
    """rows with columns {to}_kind and {to}: the sentence of the first of the pack's templates that is met.

    title, description: names of columns.
    """
    t, d, name = F.col(title), F.col(description), lambda x: F.col(f"__{x}")
    out = rows.withColumns({"__t": prepared(t), "__d": prepared(d), "__c": F.concat(F.coalesce(t, F.lit("")), F.lit(" "), F.coalesce(d, F.lit("")))})
    out = out.withColumns({"__a": analysed(pack, name("t"), name("d")), "__f": headline_facts(pack, name("t"), name("d"))})
    out = out.withColumns({f"__{x}": name("a")[x] for x in ("subject", "clause", "leading")})
    tests = [met(x, F.coalesce(t, F.lit("")), name("c"), name("t"), name("subject")) for x in pack.templates]
    out = out.withColumn("__kind", dispatched(pack.templates, tests, [F.lit(x.name) for x in pack.templates]))
    of = lambda what: name("kind").isin([x.name for x in pack.templates if x.detail == what] or [""])
    out = out.withColumns({
        "__more": F.when(of("supporting"), supporting_clause(pack, name("d"), name("t"), name("subject"))).otherwise(""),
        "__done": F.when(of("longer") | of("specific"), action_clause(pack, name("d"), name("subject"))).otherwise(""),
    })
    fund = F.coalesce(F.nullif(clean(F.regexp_extract(name("t"), regex(pack.concept("fact_fund")), 0)), F.lit("")), F.lit("신규 펀드"))
    slots = {"clause": name("clause"), "fund": fund, "leading": name("leading"), "bare": without_quotes(name("clause"))}

    def clause(x: Template) -> Column:
        own = filled(x.shape, slots)
        if x.detail == "specific":
            n = lambda c: F.regexp_count(c, F.lit(pack.concept("specific")))
            own = F.when((name("done") != "") & ((n(name("done")) > n(own)) | (F.length(name("done")) > F.length(own) + 12)), name("done")).otherwise(own)
        if x.lacking and "{clause}" not in x.instead:
            own = F.when(matches(own, x.lacking), own).otherwise(filled(x.instead, slots))
        own = with_facts(pack, own, name("f"), x.facts) if x.facts else own
        if x.lacking and "{clause}" in x.instead:
            own = let(own, lambda c: F.when(matches(c, x.lacking), c).otherwise(filled(x.instead, {**slots, "clause": c})))
        if x.detail == "longer":
            own = let(own, lambda c: F.when((name("done") != "") & (F.length(name("done")) > F.length(c) + 8), with_facts(pack, name("done"), name("f"), x.facts)).otherwise(c))
        for pattern, instead in x.swaps:
            own = F.regexp_replace(own, pattern, instead)
        return own

    out = out.withColumn("__base", dispatched(pack.templates, [name("kind") == x.name for x in pack.templates], [clause(x) for x in pack.templates]))
    joined = F.when(name("more") == "", name("base")).otherwise(F.trim(F.concat(joined_ending(pack, name("base")), F.lit(" "), name("more"))))
    out = out.withColumn("__whole", composed(pack, name("subject"), joined))
    begun = F.trim(F.split(name("d"), "[.!?。]", 2)[0])
    bare = F.when(begun == "", name("t")).otherwise(begun)
    last = pack.templates[-1].name if pack.templates else ""
    out = out.withColumn("__whole", F.when((name("kind") == last) & ((name("whole") == "") | (name("whole") == name("subject"))), bare).otherwise(name("whole")))
    out = out.withColumns({f"{to}_kind": name("kind"), to: finalised(pack, name("whole"))})
    return out.select(*rows.columns, f"{to}_kind", to)


def local_summaries(articles: DataFrame, pack: Pack) -> DataFrame:
    """id, kind, summary: a report sentence of each article's title and description (id, title, description)."""
    return _told(articles.select("id", "title", "description"), pack, "title", "description", "summary").select("id", F.col("summary_kind").alias("kind"), "summary")


def title_summaries(articles: DataFrame, pack: Pack) -> DataFrame:
    """id, kind, summary: a report sentence of each article's title alone (id, title), worded unlike the title where a title template is met."""
    rows = articles.select("id", "title").withColumn("__none", F.lit(""))
    rows = _told(rows, pack, "title", "__none", "plain").withColumn("__t", prepared(F.col("title")))
    rows = rows.withColumns({"__a": analysed(pack, F.col("__t"), F.lit("")), "__f": headline_facts(pack, F.col("__t"), F.lit(""))})
    rows = rows.withColumns({"__subject": F.col("__a.subject"), "__clause": report_ending(pack, F.col("__a.clause"))})
    subject, raw = F.col("__subject"), F.coalesce(F.col("title"), F.lit(""))

    def sentence(x: Template) -> Column:
        target = F.regexp_replace(F.col("__clause"), x.cut, "") if x.cut else F.col("__clause")
        for pattern, instead in x.swaps:
            target = F.regexp_replace(target, pattern, instead)
        target = let(F.trim(target), lambda c: F.when(c == "", x.default).otherwise(c))
        return filled(x.shape, {"actor": F.concat(subject, subject_particle(subject)), "target": target, "stage": F.col("__f.stage"), "amount": F.col("__f.amount")})

    known = (subject != "") & (F.col("__clause") != "")
    tests = [known & met(x, raw, raw, raw, subject) for x in pack.title_templates]
    kind = dispatched(pack.title_templates, tests, [F.lit(x.name) for x in pack.title_templates]) if tests else F.lit(None).cast("string")
    rows = rows.withColumn("kind", kind)
    told = dispatched(pack.title_templates, [F.col("kind") == x.name for x in pack.title_templates], [sentence(x) for x in pack.title_templates]) if tests else F.lit(None).cast("string")
    return rows.select("id", F.coalesce("kind", F.concat(F.lit("plain "), F.col("plain_kind"))).alias("kind"), F.when(F.col("kind").isNull(), F.col("plain")).otherwise(finalised(pack, told)).alias("summary"))
