"""Bounded samples of labelled documents, and who is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Characters of the labelled texts of a class.
CLASS_CHARS = 16_000_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def known(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, y): every labelled id outside the held-out fold, once. An id labelled twice takes the
    larger label; null ids and labels other than 0 and 1 don't count."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int, chars: int = CLASS_CHARS) -> DataFrame:
    """(doc_id, text, y): at most ``per_class`` labelled ids of each class, those whose hashed id
    is smallest, and of them as many as have ``chars`` characters together at most (one at least).
    An id whose rows differ has the smallest text. The ids are at most twice ``per_class``, so
    they are broadcast, and so few rows are ordered in one task."""
    ids = known(labels, label, folds, held).withColumn("turn", F.xxhash64(F.col("doc_id").cast("string")))
    some = [ids.where(F.col("y") == y).orderBy("turn", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = some[0].unionByName(some[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "turn", "y").agg(F.min("text").alias("text"))
    before = F.sum(F.length(F.coalesce("text", F.lit("")))).over(W.partitionBy("y").orderBy("turn", "doc_id"))
    place = F.row_number().over(W.partitionBy("y").orderBy("turn", "doc_id"))
    return texts.withColumns({"before": before, "place": place}).where((F.col("before") <= chars) | (F.col("place") == 1)).select("doc_id", "text", "y")
