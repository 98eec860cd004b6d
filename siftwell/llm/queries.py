"""The opN_ queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import table


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.topk_search import vector_top_k

    return vector_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.licences import licences

    return licences(table(spark, sf_dir, "documents"))


def _licence_sql() -> str:
    from siftwell.llm.licences import TEMPLATES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"  # noqa: E731
    rows = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(TEMPLATES))
    pairs = lambda text: rf"regexp_extract_all(translate({text}, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"  # noqa: E731
    set_of = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH t AS (SELECT k, name, {set_of} AS b FROM (SELECT k, name, {pairs("text")} AS w FROM (VALUES {rows}) v(k, name, text))),
d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM d),
u AS (
  SELECT doc_id, text AS u FROM d
  UNION SELECT doc_id, unnest(string_split_regex(text, '
[ 	
]*
')) FROM d
  UNION SELECT * FROM l
  UNION SELECT doc_id, unnest(string_split(regexp_replace(u, '([.!?]) +', '' || chr(10), 'g'), chr(10))) FROM l),
s AS (SELECT doc_id, u, {set_of} AS b FROM (SELECT doc_id, u, {pairs("u")} AS w FROM u)),
m0 AS (
  SELECT doc_id, u, name, max(2 * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b))) AS dice
  FROM s JOIN t ON len(s.b) BETWEEN len(t.b) * 0.8 / 1.2 - 1e-9 AND len(t.b) * 1.2 / 0.8 + 1e-9
  WHERE len(s.b) > 0 AND 2 * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) >= 0.8 GROUP BY ALL
  QUALIFY row_number() OVER (PARTITION BY doc_id, u ORDER BY dice DESC, name) = 1),
met AS (SELECT doc_id, list(DISTINCT name) AS names FROM m0 GROUP BY doc_id),
m AS (
  SELECT doc_id, u, dice, CASE name WHEN 'BSD-3-Clause/clause' THEN 'BSD-3-Clause' ELSE name END AS name FROM m0 JOIN met USING (doc_id)
  WHERE NOT (name = 'BSD-2-Clause' AND list_contains(names, 'BSD-3-Clause/clause')) AND NOT (name = 'proprietary' AND len(names) > 1)),
g AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, round(max(dice), 6) AS best_score, count(*) AS n_matches FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(best_score, 0.0) AS best_score, coalesce(n_matches, 0) AS n_matches FROM documents LEFT JOIN g USING (doc_id)
"""


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.merge_dropout import encoded

    return encoded(table(spark, sf_dir, "documents"), digest=True)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.main_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.line_templates import deduplicated

    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.jaccard_groups import classes

    return classes(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.language_id import language_of

    return language_of(table(spark, sf_dir, "documents")).drop("spans")


def op11_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.decision_list import decisions

    return decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.token_alignment import alignment

    return alignment(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.fill_middle import restored, transformed

    made = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda text, name: F.sha2(text, 256).alias(name)  # noqa: E731
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output"), "output_sha256"), sha(restored(F.col("output"), F.col("form")), "restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_toxicity": op2_toxicity,
    "op3_licences": op3_licences,
    "op4_merge_dropout": op4_merge_dropout,
    "op5_decontamination": op5_decontamination,
    "op6_main_text": op6_main_text,
    "op7_quality": op7_quality,
    "op8_line_templates": op8_line_templates,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_language_id": op10_language_id,
    "op11_decision_list": op11_decision_list,
    "op12_token_alignment": op12_token_alignment,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE: dict[str, str] = {
    "op1_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op3_licences": _licence_sql(),
    "op5_decontamination": rf"""
WITH it AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, 10 AS n, w[i : i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM it WHERE len(w) >= 10)
  UNION ALL SELECT item_id, len(w), w FROM it WHERE len(w) BETWEEN 1 AND 9),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, i, dw.n FROM dw JOIN iw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op8_line_templates": r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS l FROM raw),
l1 AS (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(l, '[ \t\r\f\x0B]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM l0),
l2 AS (SELECT *, string_split(line, ' ') AS t FROM l1 WHERE line <> ''),
l3 AS (SELECT doc_id, pos, line, t, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf FROM l2),
whole AS (SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS context FROM l2 GROUP BY doc_id),
l4 AS MATERIALIZED (SELECT DISTINCT context, leaf, line, t FROM l3 JOIN whole USING (doc_id)),
leaves AS (SELECT leaf FROM l4 GROUP BY leaf HAVING count(DISTINCT context) >= 5),
opened AS MATERIALIZED (
  SELECT DISTINCT context, line, t, unnest([len(t) || ' 1 ' || array_to_string(t[2:4], ' '), len(t) || ' 2 ' || t[1] || ' ' || t[3] || ' ' || t[4], len(t) || ' 3 ' || t[1] || ' ' || t[2] || ' ' || t[4]]) AS leaf
  FROM l4 WHERE len(t) > 3 AND leaf NOT IN (FROM leaves)),
more AS (SELECT leaf FROM opened GROUP BY leaf HAVING count(DISTINCT context) >= 5),
met AS MATERIALIZED (SELECT context, leaf, line, t FROM l4 WHERE leaf IN (FROM leaves) UNION ALL SELECT context, leaf, line, t FROM opened WHERE leaf IN (FROM more)),
often AS (
  SELECT leaf, place, token FROM (SELECT leaf, context, unnest(range(0, len(t))) AS place, unnest(t) AS token FROM met)
  GROUP BY leaf, place, token HAVING count(DISTINCT context) >= 5),
tok AS (SELECT leaf, line, unnest(range(0, len(t))) AS place, unnest(t) AS token FROM (SELECT DISTINCT leaf, line, t FROM met)),
shown AS (
  SELECT k.leaf, k.line, string_agg(CASE WHEN o.leaf IS NULL THEN '<*>' ELSE k.token END, ' ' ORDER BY k.place) AS template,
    avg(CASE WHEN o.leaf IS NOT NULL AND k.token <> '<*>' THEN 1.0 ELSE 0.0 END) AS constant
  FROM tok k LEFT JOIN often o ON o.leaf = k.leaf AND o.place = k.place AND o.token = k.token GROUP BY k.leaf, k.line),
recurs AS (SELECT template FROM shown JOIN met USING (leaf, line) WHERE constant >= 0.7 GROUP BY template HAVING count(DISTINCT context) >= 5),
gone AS (SELECT DISTINCT line FROM shown WHERE constant >= 0.7 AND template IN (FROM recurs)),
cut AS (SELECT l0.doc_id, count(*) AS n_lines, count(g.line) AS n_dropped, coalesce(string_agg(l0.l, chr(10) ORDER BY l0.pos) FILTER (WHERE g.line IS NULL), '') AS text
  FROM l0 JOIN l1 USING (doc_id, pos) LEFT JOIN gone g ON g.line = l1.line GROUP BY l0.doc_id)
SELECT d.doc_id, cut.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM documents d LEFT JOIN cut USING (doc_id)
""",
    "op9_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT doc_id, hash(w[i : i + 4]) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION SELECT doc_id, hash(w) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
""",
    "op13_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (
  SELECT doc_id, x, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, x, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, x, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
""",
}
