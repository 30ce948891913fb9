"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import table


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkwell.llm.records import token_records

    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.neighbours import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkwell.llm.lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.host_rules import host_rules

    return host_rules(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.personal_data import find

    return find(table(spark, sf_dir, "documents")).drop("found")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkwell.llm.byte_bpe import read_ranks, round_trip

    return round_trip(table(spark, sf_dir, "documents"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_toxicity": op2_toxicity,
    "op3_neighbours": op3_neighbours,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_host_rules": op7_host_rules,
    "op8_personal_data": op8_personal_data,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op10_near_dedup": r"""
WITH RECURSIVE T AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
S AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) ELSE w END) AS shingle FROM T),
N AS (SELECT doc_id, count(*) AS n FROM S GROUP BY doc_id), Z AS (SELECT doc_id, shingle, n FROM S JOIN N USING (doc_id)),
P AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS k FROM Z a JOIN Z b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100*a.n >= 80*b.n AND 100*b.n >= 80*a.n GROUP BY ALL),
L AS (SELECT u, v FROM P WHERE 100*k >= 80*(m + n - k)), E AS (SELECT u, v FROM L UNION ALL SELECT v, u FROM L),
R AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT E.v, R.root FROM R JOIN E ON E.u = R.doc_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM R LEFT JOIN N USING (doc_id) GROUP BY doc_id""",
    "op7_host_rules": r"""
WITH W AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
P AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 6, 1))) AS i, w FROM W),
D AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS times FROM P),
R AS (SELECT doc_id, count(DISTINCT spot) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS spot FROM D WHERE times > 1) GROUP BY doc_id),
C AS (SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM W),
B AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS r FROM C LEFT JOIN R USING (doc_id)),
F AS (SELECT *, n_words < 20 OR 100*r > 30*n_words AS base_failed FROM B),
H AS (SELECT source AS host, count(*) AS docs, count(*) FILTER (base_failed OR 100*n_symbols > 100*n_words OR 100*n_dup_lines > 30*len(lines)) AS failed FROM F GROUP BY source),
M AS (SELECT (sum(failed) + 0.5)/(sum(docs) + 1) AS m, var_pop(failed/docs) AS v FROM H),
S AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m*(1-m)/v - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM M),
V AS (SELECT H.*, (failed + m*s)/(docs + s) AS rate FROM H, S)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, r AS n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, docs, failed, round(rate, 9) AS rate
FROM F JOIN V ON F.source IS NOT DISTINCT FROM V.host""",
}
