"""The corpus pipeline: stages applied in turn to ``documents``, each one's rows written and read
again as the next one's input. Every stage but the last returns the columns it was given.

Null and empty texts pass all stages (they score the toxicity model's base, are near duplicates of
nothing, hold no benchmark words) until the mix, which takes no document without words. Repeated
rows are one group of copies. Empty tables give empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beatloom.llm import decontamination, jaccard, mixing, token_output, toxicity
from beatloom.llm.common import stored
from beatloom.llm.queries import vocabulary
from beatloom.sources.tables import table


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels, does not reject."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of every group of copies and near copies."""
    return jaccard.first_documents(docs, n=5, num=80)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than stray words of the benchmark."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weighted fair queues send them within the budget."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: one row per document."""
    return token_output.encoded(docs, vocabulary())


STAGES = [
    ("toxicity", civil),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", untested),
    ("mixing sources to target weights", mix),
    ("token-ID output", tokens),
]

# A trained classifier and a tokenizer decide the rows; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
