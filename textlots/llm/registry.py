"""The registered corpus queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlots.llm import (
    decontaminate, divergence, language, licenses, mixing, pii, quality, sharding, simhash, sql, substrings, token_files,
    tokens, vector_codes,
)
from textlots.llm.common import documents, settled, table
from textlots.session import work_dir

TOKEN_LIMIT = 512


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.personal_data(documents(spark, sf_dir))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("bigint")

    return rows.select(
        "doc_id",
        *[number(at).alias(f"n_{kind}") for at, kind in enumerate(pii.KINDS)],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("found")).alias("spans"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(documents(spark, sf_dir), table(spark, sf_dir, "labels")).drop("text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file."""
    from public_tokenizers import path

    return str(path(name))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(documents(spark, sf_dir), tokenizer_file())
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = work_dir(spark, "slot-map")
    sizes = settled(sharding.slot_sizes(docs))
    sharding.store_map(sharding.rebalanced(sizes), folder)
    return sharding.placed(docs, sharding.load_map(spark, folder), sizes).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-ids")
    token_files.write_token_files(documents(spark, sf_dir), folder, tokenizer_file())
    return token_files.documents_of(token_files.read_segments(spark, folder))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(documents(spark, sf_dir)).drop("kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times"
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_sharding": op6_sharding,
    "op7_token_files": op7_token_files,
    "op8_substrings": op8_substrings,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_licenses": op12_licenses,
    "op13_divergence": op13_divergence,
}

SQL = {
    "op1_decontaminate": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i)
  WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (
  SELECT doc_id, i, d.n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
        FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)) d
  JOIN windows USING (n, win)),
counts AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN listed USING (doc_id)
""",
    "op8_substrings": r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) AS n
    FROM docs, unnest(range(1, len(w) - 18)) AS t(i))
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(i, i + 20)) AS t(p)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words
  FROM (SELECT doc_id, p, w[p] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(p))
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
""",
    "op11_vector_codes": sql.vector_codes_sql(),
    "op12_licenses": sql.license_sql(),
    "op13_divergence": sql.divergence_sql(),
}
