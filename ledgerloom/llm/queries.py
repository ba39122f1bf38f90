"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import collocations, decontaminate, html_extract, language_id, line_dedup, merkle, mixing, pii, quality_classifier, quality_rules, simhash, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), model)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents")).drop("host_rate")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), removed_col="n_removed_lines")
    return out.select("doc_id", "text", "n_removed_lines")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"), key="ledgerloom-demo-key")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_html_extract, op3_quality_classifier, op4_decontaminate, op5_simhash, op6_quality_rules, op7_line_dedup, op8_mixing, op9_toxicity, op10_pii, op11_collocations, op12_language_id, op13_merkle_manifest)}

_OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i:i + 7]) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, sum(least(8, gap)) AS n FROM (SELECT rid, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 8) AS gap FROM p) GROUP BY rid),
m AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
q AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(100.0, m * (1 - m) / v - 1)) ELSE 100.0 END AS k FROM q),
o AS (SELECT source, (f + m * k) / (n + k) <= 0.5 AS ok FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM b JOIN o ON b.source IS NOT DISTINCT FROM o.source"""

_OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM f WHERE k > 1),
q AS (SELECT c.lang, c.phrase, c.k, c.a, j, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
 FROM c JOIN s USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j + 1:], ' ')),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b
 WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = b.lang AND x.k > b.k AND x.a = b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}) || ':' || {0} END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
 lambda have, b: list_reduce(list_prepend(xor(have, b), list_transform(range(8), lambda z: 0::BIGINT)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
_GROW = """(SELECT tree, 0 AS level, place, leaf AS h FROM {0} UNION ALL SELECT tree, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place))
 FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {1}) WHERE m > 1 GROUP BY tree, level, place // 3)"""
_WALK = """(SELECT rid, tree, 0 AS level, place, sib, fold FROM {0} UNION ALL SELECT w.rid, any_value(w.tree), any_value(w.level) + 1, any_value(w.place) // 3,
 any_value(w.sib) || coalesce(string_agg(CASE WHEN u.place <> w.place THEN u.h END, '' ORDER BY u.place), ''), sha256(string_agg(CASE WHEN u.place = w.place THEN w.fold ELSE u.h END, '' ORDER BY u.place))
 FROM {1} w JOIN {2} u ON u.tree IS NOT DISTINCT FROM w.tree AND u.level = w.level AND u.place // 3 = w.place // 3 JOIN {3} s ON s.tree IS NOT DISTINCT FROM w.tree AND w.level < s.level GROUP BY w.rid)"""
_OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, {_LEAF} AS head, coalesce(({_CRC}) & 1 = 1, false) AS hit FROM documents),
l AS (SELECT *, sha256(head || {_FIELD.format("text")}) AS leaf, sha256(head || CASE WHEN hit THEN {_FIELD.format("replace(text, chr(10), '')")} ELSE {_FIELD.format("text")} END) AS given FROM d),
t AS (SELECT *, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
up AS {_GROW.format("t", "up")},
tops AS (SELECT tree, max(level) AS level, arg_max(h, level) AS h FROM up GROUP BY tree),
t2 AS (SELECT 0 AS tree, tree AS source, h AS leaf, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place FROM tops),
up2 AS {_GROW.format("t2", "up2")},
tops2 AS (SELECT tree, max(level) AS level, arg_max(h, level) AS h FROM up2 GROUP BY tree),
start AS (SELECT rid, tree, place, '' AS sib, given AS fold FROM t),
walk AS {_WALK.format("start", "walk", "up", "tops")},
start2 AS (SELECT w.rid, 0 AS tree, t2.place, w.sib, w.fold FROM walk w JOIN tops s ON s.tree IS NOT DISTINCT FROM w.tree AND s.level = w.level JOIN t2 ON t2.source IS NOT DISTINCT FROM w.tree),
walk2 AS {_WALK.format("start2", "walk2", "up2", "tops2")}
SELECT t.doc_id, t.leaf, s.h AS subroot, r.h AS root, sha256(w.sib) AS proof_sha256, w.fold AS folded_root, w.fold = r.h AS verified
FROM t JOIN tops s ON s.tree IS NOT DISTINCT FROM t.tree, tops2 r JOIN walk2 w ON w.level = r.level WHERE w.rid = t.rid"""

#: The others rest on hashes, random rounding, models or graph search that SQL has not; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op6_quality_rules": _OP6_SQL, "op11_collocations": _OP11_SQL, "op13_merkle_manifest": _OP13_SQL}
