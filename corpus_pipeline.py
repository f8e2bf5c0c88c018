"""Corpus pipeline over ``documents``: language ID, line dedup, near-dedup, decontamination, tokenisation.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents; the last returns one row of token figures for each document that is left.  Between stages the rows are
written to the shared folder and read again, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, decontam, langid, line_dedup, near_copies
from quillstone.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return langid.accepted(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all texts but the first that holds them; n_chars follows the text.

    Documents of equal text count as one and leave equal, so that the next stage still knows them as copies.
    """
    out = line_dedup.deduplicated(docs, copies_alike=True)
    length = F.when(F.col("dropped_lines").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles of Jaccard similarity 0.8 or more."""
    return near_copies.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with the benchmark go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    import public_tokenizers

    return bpe.result(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The trained language model and the shingles' hash can't be expressed in SQL; tests/llm/ holds a brute-force version.
ORACLE_SQL = None
