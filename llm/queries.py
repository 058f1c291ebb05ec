"""The registered queries: every operator over its whole table, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import ann, bpe, decontamination, lm_score, neardup, packing, quality_model, quality_rules, secrets, spelling, token_counts, toxicity, whitening
from llm.stages import table

TOKEN_LIMIT = 4096
QUERY_STEP = 20
SPOIL = 199


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(table(spark, folder, "documents")))
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.counted(secrets.find_secrets(table(spark, folder, "documents")))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    groups = neardup.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return groups.select("row.doc_id", "n_shingles", "component_id", "kept")


def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.search(vectors, vectors.where(f"vec_id % {QUERY_STEP} = 0"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    judged = quality_rules.judged(documents, table(spark, folder, "labels"), keep_text=False)
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.log_likelihood(table(spark, folder, "documents"))


def op10_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(documents, table(spark, folder, "benchmark"), keep_text=False)
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    each = F.arrays_zip(F.col("whitened"), F.col("explained"))
    return white.select("row.vec_id", "n", "deviation", "identity_error", F.posexplode(each).alias("place", "of")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        F.expr("try_cast(deviation as long)").alias("deviation"),
        "of.whitened",
        "of.explained",
        "identity_error",
    )


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(table(spark, folder, "documents"), spoil=SPOIL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_nearest": op6_nearest,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_score": op9_lm_score,
    "op10_quality_model": op10_quality_model,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op11_decontamination": r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
),
win AS (
  SELECT DISTINCT item, least(len(words), 10) AS length,
         array_to_string(words[first : first + least(len(words), 10) - 1], ' ') AS content
  FROM item, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS places(first)
  WHERE len(words) > 0
),
doc AS (
  SELECT row_number() OVER () AS number, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents
),
spot AS (
  SELECT number, length, first, array_to_string(words[first : first + length - 1], ' ') AS content
  FROM doc, (SELECT DISTINCT length FROM win) AS lengths, unnest(range(1, len(words) - length + 2)) AS places(first)
),
hit AS (SELECT number, spot.length, first, item FROM spot JOIN win USING (length, content)),
covered AS (
  SELECT number, count(DISTINCT place) AS n_hit
  FROM (SELECT DISTINCT number, first, length FROM hit), unnest(range(first, first + length)) AS places(place)
  GROUP BY number
),
met AS (
  SELECT number, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT number, item FROM hit) GROUP BY number
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (number) LEFT JOIN met USING (number)
""",
}
