"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfpace.llm import chat_format, decontaminate, fill_middle, jaccard_join, mixing, periodic_runs, pii, pitman_yor, quality_rules, suffix_dedup, token_counts, token_files, toxicity
from shelfpace.llm.staging import new_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and learned verdict for all documents."""
    return quality_rules.quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_join.near_duplicates(_table(spark, folder, "documents"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations, and of one whose texts hold control strings, read back from their windows."""
    turn = F.col("id")
    role = F.when(turn == 0, "user").otherwise("assistant")
    injected = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(injected)
    return chat_format.digests(chat_format.chat_windows(rows))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated passages taken out of all documents."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, folder, "documents")))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents mixed to the target weights, up to two epochs of a leaf."""
    return mixing.choose(_table(spark, folder, "documents"), epochs=2)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return decontaminate.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(pii.find_personal_data(_table(spark, folder, "documents")))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of all documents."""
    docs = _table(spark, folder, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, folder, "labels")))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, read back."""
    path = new_folder(spark, "token-files")
    token_files.write_token_files(_table(spark, folder, "documents"), path, _tokenizer("word_bpe_49k.json"))
    return token_files.read_documents(spark, path)


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.token_counts(_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"))


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents reordered for filling in the middle, and rebuilt."""
    return fill_middle.digest(fill_middle.fill_in_middle(_table(spark, folder, "documents")))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which are made to repeat."""
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(_table(spark, folder, "documents"))))


def op13_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a model of four fifths of them."""
    held_out = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 1
    scored = pitman_yor.score_texts(_table(spark, folder, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_jaccard_join, op3_chat_format, op4_suffix_dedup, op5_mixing, op6_decontamination, op7_pii, op8_toxicity, op9_token_files, op10_token_counts, op11_fill_middle, op12_periodic_runs, op13_pitman_yor)}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE}
