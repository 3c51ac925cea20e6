"""The corpus pipeline: raw documents to token files in five stages.

Toxic documents go, one document of each near-duplicate component stays, documents with benchmark items go, sources are
mixed to their target weights, and what is left is written as token files. Each stage reads what the one before wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfpace.llm import decontaminate, jaccard_join, mixing, token_files, toxicity
from shelfpace.llm.staging import new_folder, stage

MIX_SHARE = 0.9  # of the tokens that reach the mixing stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIX_SHARE)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    token_files.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", to_token_files),
]

# The model, the tokenizer and the wavelet files have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
