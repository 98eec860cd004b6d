"""Line dedup by a log-template tree, in DataFrame operations alone.

A line's white space is reduced and tokens with a digit become `<*>`. The tree has a fixed depth: a line's path is its
number of tokens and its first `DEPTH` tokens, and ends in a leaf. As one of these may be a variable field (a name), lines
whose leaf doesn't recur go on to the leaves of the paths of `DEPTH` + 1 tokens with one of the first `DEPTH` left open
(three of them, a line may be in each), which are counted among these lines. In leaves that recur,
a token is kept where it stands at its place in lines of at least `CONTEXTS` contexts; others are variable fields, `<*>`. So
a line gets a template in each of its leaves; a template with a share of `CONSTANT` kept tokens at least, met in `CONTEXTS`
contexts or more, recurs, and its lines are dropped from all documents.

A context is a document's masked content, its lines in order: exact copies of a document, and copies with other numbers,
count once, however many there are, and are left to whoever removes copies. Documents that differ in a word are documents
of their own, so the lines that form letters or near copies share recur and go. A document counts once for a token or a
template, however many of its lines have it.

Texts are cut into lines once, and the lines kept in a table with hashes (128 bits for a document's row and for a line,
64 for a leaf). From there a line's text travels only where its leaf recurs, and once for each distinct line; a document's
once, to lose its lines. All tokens of a line in `CONTEXTS` contexts are kept, so only rarer lines are taken apart.

Defined cases: a null text stays null; an empty one stays; blank lines stay, are no part of a context and count as lines; a text
whose lines all recur becomes empty; a null doc_id is a document like others; repeated rows give repeated rows; extra
columns are kept, and `n_chars`, where there is one, follows the text; with `counts`, columns n_lines and n_dropped are
replaced. Only \\n ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import discard, stored

CONTEXTS = 5
DEPTH = 3
CONSTANT = 0.7
SPREAD = 16
#: Recurring leaves that are sent to all tasks (16 bytes each); more are joined, spread over tasks.
FEW_LEAVES = 250_000


def masked(text: Column) -> Column:
    """The text with single spaces within lines and `<*>` for tokens with a digit."""
    even = F.when(text.rlike(r"[\t\r\f\x0B]|  "), F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")).otherwise(text)
    return F.when(even.rlike("[0-9]"), F.regexp_replace(even, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*", "<*>")).otherwise(even)


def _leaves(line: Column) -> tuple[Column, Column]:
    """Hash of the line's path, and those of its paths with a place left open. A line of no more than `DEPTH` tokens has none of these."""
    n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    first = F.split(F.substring_index(line, " ", DEPTH + 1), " ")
    opened = [F.xxhash64(n, F.lit(k), *(F.get(first, F.lit(j)) for j in range(DEPTH + 1) if j != k)) for k in range(DEPTH)]
    whole = F.xxhash64(n, F.substring_index(line, " ", DEPTH))
    return whole, F.when(n > DEPTH, F.array(*opened)).otherwise(F.array().cast("array<bigint>"))


def _row_key(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's doc_id and text."""
    doc, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    return F.xxhash64(doc, text), F.xxhash64(F.lit(7), doc, text)


def _lines(docs: DataFrame) -> DataFrame:
    """Non-blank lines: h1, h2 (the row), pos (from 0), line (masked), its hashes k1, k2, leaf, opened (leaves), context (the document's masked lines)."""
    h1, h2 = _row_key(docs)
    rows = docs.select(h1.alias("h1"), h2.alias("h2"), F.split(masked(F.col("text").cast("string")), "\n", -1).alias("raw"))
    cut = F.transform("raw", lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    rows = rows.select("h1", "h2", F.filter(cut, lambda x: x["line"] != "").alias("cut"))
    rows = rows.select("h1", "h2", F.xxhash64(F.col("cut.line")).alias("context"), F.inline("cut"))
    line = F.col("line")
    leaf, opened = _leaves(line)
    return rows.select("h1", "h2", "pos", "context", leaf.alias("leaf"), opened.alias("opened"), F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2"), "line")


def _of(rows: DataFrame, leaves: DataFrame, few: bool, how: str = "left_semi") -> DataFrame:
    """The rows whose leaf is among leaves, or with left_anti the others."""
    if few:
        return rows.join(F.broadcast(leaves), "leaf", how)
    spread = leaves.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("part", F.pmod("k1", F.lit(SPREAD)).cast("int")).join(spread, ["leaf", "part"], how).drop("part")


def _recurring_leaves(rows: DataFrame, contexts: int) -> DataFrame:
    return stored(rows.groupBy("leaf", "context").agg(F.lit(1).alias("one")).groupBy("leaf").count().where(F.col("count") >= contexts).select("leaf"))


def recurring(docs: DataFrame, contexts: int = CONTEXTS, constant: float = CONSTANT, few_leaves: int = FEW_LEAVES) -> tuple[DataFrame, DataFrame]:
    """Two tables: places (h1, h2, pos, k1, k2) of lines in recurring leaves, and the lines (line, template, k1, k2) whose template recurs."""
    every = stored(_lines(docs))
    leaves = _recurring_leaves(every.select("leaf", "context"), contexts)
    few = leaves.count() <= few_leaves
    columns = ["h1", "h2", "pos", "k1", "k2", "context", "leaf"]
    others = _of(every.select("leaf", "k1", "context", "opened"), leaves, few, "left_anti").select("context", F.explode("opened").alias("leaf"))
    more = _recurring_leaves(others, contexts)
    rest = _of(every, leaves, few, "left_anti").drop("leaf").withColumn("leaf", F.explode("opened")).select(*columns, "line")
    places = stored(_of(every.select(*columns, "line"), leaves, few).select(*columns, "line").union(_of(rest, more, more.count() <= few_leaves).select(*columns, "line")))
    discard(every, leaves, more)
    key = ["leaf", "k1", "k2"]
    met = stored(places.select(*key, "context").distinct())
    texts = places.groupBy("k1", "k2").agg(F.min("line").alias("line"))
    lines = stored(met.groupBy(*key).agg(F.count("*").alias("n")).join(texts, ["k1", "k2"]))

    rare = lines.where(F.col("n") < contexts)
    tokens = rare.select(*key, F.posexplode(F.split("line", " ")).alias("at", "token"))
    each = met.join(rare.select(*key, "line"), key).select("leaf", "context", F.posexplode(F.split("line", " ")).alias("at", "token")).distinct()
    often = each.groupBy("leaf", "at", "token").agg(F.count("*").alias("m")).where(F.col("m") >= contexts).select("leaf", "at", "token")
    sure = lines.where(F.col("n") >= contexts).select("leaf", F.posexplode(F.split("line", " ")).alias("at", "token"))
    often = often.union(sure).distinct().withColumn("kept", F.lit(True))
    shown = tokens.join(often, ["leaf", "at", "token"], "left").groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("at", F.when(F.col("kept"), F.col("token")).otherwise("<*>").alias("token")))).alias("tokens"),
        F.avg(F.when(F.col("kept") & (F.col("token") != "<*>"), 1.0).otherwise(0.0)).alias("constant"),
    )
    shown = shown.where(F.col("constant") >= constant).join(rare, key).select(*key, "line", "n", F.concat_ws(" ", F.col("tokens.token")).alias("template"))
    words = F.split("line", " ")
    whole = lines.where((F.col("n") >= contexts) & (F.size(F.filter(words, lambda t: t != "<*>")) / F.size(words) >= constant))
    shown = stored(shown.union(whole.select(*key, "line", "n", F.col("line").alias("template"))))
    # A line in enough contexts decides for its template; where only several lines together may reach them, theirs are
    # counted (spread by context, as a line may be very common).
    sums = shown.groupBy("template").agg(F.max("n").alias("most"), F.sum("n").alias("m"))
    unsure = shown.join(sums.where((F.col("most") < contexts) & (F.col("m") >= contexts)), "template", "left_semi")
    unsure = unsure.select(*key, "template", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    theirs = met.withColumn("part", F.pmod("context", F.lit(SPREAD)).cast("int")).join(unsure, [*key, "part"]).select("template", "context").distinct()
    reached = theirs.groupBy("template").agg(F.count("*").alias("m")).where(F.col("m") >= contexts).select("template")
    templates = sums.where(F.col("most") >= contexts).select("template").union(reached)
    found = stored(shown.join(templates, "template", "left_semi").select("line", "template", "k1", "k2"))
    discard(met, lines, shown)
    return places.select("h1", "h2", "pos", "k1", "k2"), found


def deduplicated(docs: DataFrame, contexts: int = CONTEXTS, constant: float = CONSTANT, counts: bool = False, few_leaves: int = FEW_LEAVES) -> DataFrame:
    """The documents, all columns, without lines whose template recurs; `counts` adds n_lines and n_dropped."""
    places, lines = recurring(docs, contexts, constant, few_leaves)
    gone = places.join(lines.select("k1", "k2"), ["k1", "k2"], "left_semi")
    gone = gone.groupBy(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).agg(F.collect_set("pos").alias("__gone"))
    text = F.col("text").cast("string")
    h1, h2 = _row_key(docs)
    found = docs.join(gone, (h1 == gone["__h1"]) & (h2 == gone["__h2"]), "left")
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    out = found.withColumn("__text", F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(left, "\n")))
    if counts:
        n = F.when(text.isNotNull(), F.size(F.split(text, "\n", -1))).otherwise(0).cast("long")
        out = out.withColumns({"n_lines": n, "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")})
        out = out.withColumn("n_dropped", F.when(F.col("__gone").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_dropped")))
    changed = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast(dict(docs.dtypes)["n_chars"]))
    return out.withColumns(changed).drop("__text", "__gone", "__h1", "__h2")
