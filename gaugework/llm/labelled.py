"""Labelled documents to fit a small model on: all, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _usable(labels: DataFrame, label: str, usable: Column | None) -> DataFrame:
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
    )
    if usable is not None:
        rows = rows.filter(usable)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most_per_class: int, usable: Column | None = None,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, text, label`` and the columns ``also`` of at most ``most_per_class`` documents of label 0 and of 1.

    The documents with the smallest hash of their id are taken, so reruns agree.  Rows
    without id or label are left out; of several labels of an id the largest counts, of
    several texts of an id the smallest.  The taken ids are few by that bound, so they
    are broadcast and only their texts move.
    """
    rows = _usable(labels, label, usable)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # each class on its own: a bounded top k in every task, then among what those sent
    first, second = (rows.filter(F.col("label") == k).orderBy(*order).limit(most_per_class) for k in (0, 1))
    taken = first.union(second)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *also)
    return (
        texts.join(F.broadcast(taken), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), *[F.min(c).alias(c) for c in also])
    )


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, label`` and the columns ``also`` of every labelled document, one row per id.

    Rows without id or label are left out; of several labels of an id the largest counts,
    of several texts of an id the smallest.
    """
    rows = _usable(labels, label, usable)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *also)
    return texts.join(rows, "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").alias("label"), *[F.min(c).alias(c) for c in also]
    )


def held_out(modulus: int, rest: int) -> Column:
    """True for documents whose labels must not be learned from; a null id is not held out."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(key % modulus == rest, F.lit(False))
