"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int) -> DataFrame:
    """(doc_id, label, text) of at most per_class labelled rows of each class, lowest hashes first, one row for
    each doc_id: of rows that share one the least text counts, and labels that disagree about one don't count.
    The sample's ids are bounded, so they are broadcast and only the sample's texts are shuffled."""
    y = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where(train & F.col("label").isin(0, 1))
    known = y.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    picked = None
    for c in (0, 1):
        some = known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionAll(some)
    ids = F.broadcast(written(picked, f"{label}-ids"))  # at most two per_class rows
    found = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id")
    return written(found.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "label", "text"), f"{label}-train")
