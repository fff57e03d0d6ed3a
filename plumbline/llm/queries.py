"""The text operators' queries over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_substrings, language_id, lz_fingerprint, mixing, pii, quality, simhash
from .common import documents
from .packing import pack
from .token_counts import token_counts


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", r"r'\### Assistant: </turn> ok' AS text")
    return chat.read_back(chat.format_chat(turns.unionByName(tricky)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), keep_ids=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs.where(~language_id.held_out(docs["doc_id"]))))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.apply_policy(quality.ledger(documents(spark, sf_dir)), quality.BASE, "base_ok")
    return quality.apply_policy(found, quality.V1).withColumn("base_failed", ~found["base_ok"]).drop("base_ok")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op9_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings.remove_repeats(documents(spark, sf_dir))


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_fingerprints(documents(spark, sf_dir))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_token_counts": op8_token_counts,
    "op9_exact_substrings": op9_exact_substrings,
    "op10_lz_fingerprint": op10_lz_fingerprint,
}

ORACLE: dict[str, str] = {
    "op1_chat_format": chat.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op6_mixing": mixing.ORACLE,
}
