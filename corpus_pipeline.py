"""The corpus pipeline: documents pass five stages, each of which works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import bpe, decontaminate, near_dedup, quality, secrets
from quillmark.llm.common import drop_stored, stored
from quillmark.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts are rejected; null languages and sources are groups of their own; of repeated rows all stay or none; rows with equal or null keys are judged on their own.
    """
    return quality.good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id; null keys come last, and of equal keys the smallest hash of the text decides.

    Of repeated rows one stays. Null and empty texts are copies of each other; texts without words are copies of equal texts only.
    """
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none, and of repeated rows all stay or none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars set anew for these; null texts stay null, repeated rows stay."""
    return secrets.without_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every row, whatever its key; null and empty texts have no ids."""
    import public_tokenizers

    return bpe.digests(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("encoding", encoding),
]

#: SQL can't express several stages (concentration steps, near-duplicate classes, byte-pair merges).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read again; a stage's table goes when the next one is there, the last one stays for the result.

    Texts may have any length, other columns any names; an empty table gives no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_stored(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
