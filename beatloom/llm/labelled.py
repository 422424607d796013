"""Training rows for the classifiers: a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.llm.common import bounded_sample, stored

FOLDS, HELD_OUT = 5, 0
SAMPLE_ROWS = 12_000


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0. A null
    id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of about ``rows`` labelled documents outside the held-out fold, never more
    than twice as many. Only their ids are broadcast, so no text is shuffled before the
    sample is taken. Of documents that share an id one is taken; of labels that differ the larger."""
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = bounded_sample(ids, "doc_id", rows, ids.count()).collect()  # at most 2 * rows pairs
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "_id long, label int")
    found = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    return stored(found.groupBy("_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("r")).select("r.text", "r.label"), "training-rows")
