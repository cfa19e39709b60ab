"""Labelled documents for the classifiers: folds, and bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fold_labels(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """``doc_id, y`` of the rows to learn from: labelled 0 or 1 and outside the held-out fold.  A doc_id labelled both ways counts as 1."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    return rows.where(remainder(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(rows: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label, those with the smallest hash of doc_id: a bounded, repeatable sample."""
    h = F.xxhash64("doc_id")
    return rows.where("y = 1").orderBy(h, "doc_id").limit(per_class).unionAll(rows.where("y = 0").orderBy(h, "doc_id").limit(per_class))
