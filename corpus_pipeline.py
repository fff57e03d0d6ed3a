"""A corpus from raw documents to packed sequences: each stage takes what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the
columns of documents. A document in none of the learned languages goes, of near-duplicates one stays, personal data is
redacted in the text, sources are repeated or thinned to their targets, and what is left is packed. Stages take null texts,
sources and ids, repeated rows and empty tables as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import language_id, mixing, packing, pii, simhash
from plumbline.llm.common import documents, removed, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is written in a language of the labelled rows; without any label nothing is kept."""
    model = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])))
    return language_id.accept(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the least id."""
    return simhash.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with the kind in brackets where personal data stood."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a document as often as its source's target takes it: not at all, once, or several times."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the language model, the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again for the next. A stage's folder is
    taken away when the next has been written; the last is what the result reads, so it stays."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if last:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
