"""A training corpus from ``documents``: each stage's rows are written and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import decontaminate, minhash, packing, secrets, toxicity
from rasterloom.llm.common import table, written
from rasterloom.llm.queries import PACK_FILE, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is scored 0.5 or more for toxicity, each by its own text whatever its doc_id.

    Null and empty texts, and all rows where there are no labels of both kinds, stay.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, 0.8): that of the smallest doc_id.

    Of rows that repeat a kept doc_id and its text one stays; a doc_id that comes again with
    another text is another document. Null, empty and wordless texts are in no group and
    stay, as do rows with a null doc_id.
    """
    return minhash.clean(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a window of ten words of a benchmark item, or a whole shorter item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts <SECRET> for every secret found, row by row whatever its doc_id; n_chars follows the text, other rows stay as they are."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2048 tokens, every source in its share; null and empty texts are their end token."""
    return packing.pack(docs, tokenizer_path(PACK_FILE))


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack)]

#: Trained models, hashing and tokenisation have no SQL form; tests/llm/test_pipeline.py holds run() and its stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return written(stage(spark, docs, sf_dir), name)
