"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, importance, lattice, minhash, packing, pages, secrets, substrings, token_files, toxicity
from .common import table

#: Vocabulary files are read where they lie; public_tokenizers is the module that names them.
PACK_FILE, BINARY_FILE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, per_cent=85, r=2, m=6)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(PACK_FILE))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("clean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BINARY_FILE))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": f"""
            WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
            b AS (SELECT item_id, {_W} AS w FROM benchmark),
            g AS (SELECT item_id, unnest(list_transform(range(0, greatest(len(w) - 10, 0) + 1), lambda i: w[i + 1 : i + 10])) AS g FROM b WHERE len(w) > 0),
            sizes AS (SELECT DISTINCT len(g) AS n FROM g),
            p AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS b, w FROM d, sizes WHERE len(w) >= n),
            h AS (SELECT DISTINCT p.doc_id, p.b, p.n, g.item_id FROM p JOIN g ON g.g = p.w[p.b + 1 : p.b + p.n]),
            c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(b, b + n)) AS x FROM h) GROUP BY 1),
            i AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY 1)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
                   CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
                   coalesce(n_hit > 0, false) AS contaminated
            FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    }
