"""A training corpus from documents: five stages, each one of the operators of ``findsieve.llm``.

Every stage gets what the one before it kept, written as Parquet in between.  All but the last return the columns
of documents, whatever further columns there are and whatever they are called; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findsieve.llm import mixing, ngram_join, packing, pii, toxicity
from findsieve.llm.common import cut, named, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels of those still there, doesn't reject.

    Null and empty texts stay unless most labelled rows are toxic; equal texts fare alike.
    """
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, that with the least id; null texts and those without words all stay."""
    return ngram_join.keep_one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; null texts stay null."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budgets of their leaves take them, in whole; those without words are never taken.

    Null languages and sources count as empty ones.  Where a budget ends among rows of one id and size, any of them are taken.
    """
    names = docs.columns
    row = F.struct(*[named(c) for c in names])
    tokens = mixing.token_count(F.col("text"))
    rows = docs.select(
        row.alias("row"), "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), tokens.alias("tokens")
    ).withColumn("domain", mixing.domain_of(F.col("tokens")))
    return mixing.mix(rows).select(*[F.col("row")[c].alias(c) for c in names])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens; repeated rows are packed each for itself."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_one_of_each),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hashes and tokens are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
