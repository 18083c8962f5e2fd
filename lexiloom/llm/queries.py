"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import chat_format, decontamination, licenses, near_duplicates, packing, personal_data, quality_model, quality_rules, secrets_forest, tokens
from lexiloom.llm.tables import table
from lexiloom.plans.stash import stash


def byte_bpe() -> str:
    """Path of the public byte-level tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(spark, tokens.write_tokens(table(spark, sf_dir, "documents"), byte_bpe(), 2))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_digest(personal_data.find_personal_data(table(spark, sf_dir, "documents"), keep_text=False))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), 1)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    written = stash(chat_format.format_conversations(turns), "chat")
    return chat_format.conversation_digest(chat_format.read_windows(written))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = secrets_forest.corpus_words(docs)
    return secrets_forest.find_secrets(docs, secrets_forest.train(secrets_forest.built_in_findings(spark), words), words)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_files, op2_license_scan, op3_decontamination, op4_personal_data, op5_near_duplicates, op6_packing, op7_quality_model, op8_chat_format, op9_quality_rules, op10_secret_scan)
    return {f.__name__: f for f in own}


_NEAR = r"""WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, len(x) AS n FROM s),
e AS (SELECT doc_id, unnest(x) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
y AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y.u, r.root FROM r JOIN y ON y.v = r.id)
SELECT doc_id, n AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM n JOIN r ON r.id = doc_id GROUP BY doc_id, n"""


#: The whole operator in SQL: counts, first windows, levels, exact binomial tails, pools.
_RULES = rf"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 7)) AS i, unnest(list_transform(range(0, len(w) - 7), lambda i: array_to_string(w[i + 1 : i + 8], ' '))) AS g FROM w WHERE len(w) >= 8),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, sum(least(8, i - coalesce(p, -8))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c WHERE c > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, len(l) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CASE WHEN len(w) >= 8 THEN
    list_min(list_transform(list_filter(range(0, len(w) - 7), lambda i: w[i + 1] = low), lambda i: array_to_string(w[i + 1 : i + 8], ' '))) ELSE array_to_string(w, ' ') END AS first_window
  FROM (SELECT *, list_min(w[1 : len(w) - 7]) AS low FROM w) AS w LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {quality_rules.strictness()} AS strict_at FROM f),
o AS (SELECT lang, min(strict_at) AS strict_at FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang, first_window),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
q AS (SELECT ln({quality_rules.CONFIDENCE}::DOUBLE / (count(*) + 2)) AS bound, ceil(ln({quality_rules.CONFIDENCE}::DOUBLE / (count(*) + 2)) / ln(1 - {quality_rules.RISK}::DOUBLE)) AS need FROM n),
b AS (SELECT o.lang, o.strict_at, n.n >= need AS own FROM o JOIN n USING (lang), q),
t AS (SELECT lang AS name, strict_at FROM b WHERE own UNION ALL SELECT chr(1), strict_at FROM b WHERE NOT own UNION ALL SELECT chr(2), strict_at FROM b),
k AS (SELECT name, j, count(*) AS n, count(*) FILTER (strict_at <= j) AS k FROM t, range({quality_rules.LEVELS}) AS x(j) GROUP BY name, j),
p AS (SELECT name, n, CASE WHEN k <= n * {quality_rules.RISK}::DOUBLE THEN
  ln(list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.RISK}::DOUBLE) + (n - i) * ln(1 - {quality_rules.RISK}::DOUBLE))))) ELSE 0 END AS p FROM k),
v AS (SELECT name, n, nullif(count(*) FILTER (p <= bound), 0) - 1 AS level FROM p, q WHERE n >= need GROUP BY name, n),
z AS (SELECT level FROM v WHERE name IN (chr(1), chr(2)) ORDER BY n LIMIT 1),
y AS (SELECT n.lang, CASE WHEN n.n >= need THEN v.level ELSE (SELECT level FROM z) END AS level FROM n JOIN q ON true LEFT JOIN v ON v.name = n.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(strict_at <= level, false) AS kept FROM s LEFT JOIN y USING (lang)"""


def oracle_sql() -> dict[str, str]:
    """Near duplicates and quality rules are plain SQL.  The others rest on a tokenizer, a trained model, an alignment or the format's windows."""
    return {"op5_near_duplicates": _NEAR, "op9_quality_rules": _RULES}
