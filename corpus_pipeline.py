"""The corpus pipeline: raw documents to packed training sequences.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents; the last returns the packed pieces. run() writes each stage's result as Parquet in the
shared folder and reads it again as the next one's input.

Models are trained inside the stages, on bounded samples of the documents that reach them. Defined cases are those of the
operators: an empty table passes through as an empty one, a null text is not toxic, has no language (so it goes at the
language stage), rows that are repeated are copies of each other (one stays), very long texts are taken whole, ties are
settled by the smallest id, and columns beyond those of documents are carried along until packing.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from loglake.llm import jaccard, language, packing, secrets, toxicity
from loglake.llm.common import settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain finds toxic."""
    return toxicity.accept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letters or resemble no known language."""
    return language.accept(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links (five-word shingles, similarity 0.8 or more) connect."""
    return jaccard.representatives(docs, jaccard.PIPELINE)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With a mark in place of every secret."""
    return secrets.redact(docs, secrets.default_words())


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of a fixed window: a row for each piece."""
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_tokens),
]

#: The trained classifiers and the tokenizer are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, name, functools.partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
