"""The operators of this subpackage over their whole tables, with SQL counterparts where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counting, exact, language, leaks, near, packing, passages, prefixes, ranking, records, scoring, substrings, variants
from .common import documents


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(documents(spark, sf_dir))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir))


def binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stored_tokens(documents(spark, sf_dir)).drop("ids")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(documents(spark, sf_dir))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def digest(df: DataFrame) -> DataFrame:
    return df.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def word_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(passages.without_repeated_passages(documents(spark, sf_dir)))


def byte_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(substrings.without_repeated_strings(documents(spark, sf_dir)))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(documents(spark, sf_dir))


def ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored_documents(documents(spark, sf_dir))


def prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = prefixes.decoded(prefixes.encoded(documents(spark, sf_dir)))
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def word_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_language_id": languages,
    "op2_bagminhash": near_duplicates,
    "op3_ppm_scores": ppm_scores,
    "op4_suffix_automata": word_passages,
    "op5_minimum_bin_slack": packed,
    "op6_heap_token_counts": token_counts,
    "op7_exact_dedup": exact_copies,
    "op8_binary_records": binary_records,
    "op9_benchmark_leaks": benchmark_leaks,
    "op10_radix_substrings": byte_strings,
    "op11_prefix_bpe": prefix_tokens,
    "op12_spelling_variants": word_variants,
    "op13_ranked_search": ranked_documents,
}

ORACLES = {
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op13_ranked_search": r"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ),
        docs AS (SELECT doc_id, terms, len(terms) AS size FROM texts WHERE len(terms) > 0),
        stats AS (SELECT count(*) AS all_docs, CAST(sum(size) AS BIGINT) AS all_terms FROM docs),
        postings AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, size, unnest(terms) AS term FROM docs) GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, stats GROUP BY term
        ),
        items AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)
        ),
        asked AS (SELECT item_id, term, count(*) AS repeats FROM items GROUP BY ALL),
        scores AS (
            SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * size * all_docs) // all_terms)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN postings USING (term), stats GROUP BY item_id, doc_id
        ),
        best AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best WHERE rank <= 10
    """,
}
