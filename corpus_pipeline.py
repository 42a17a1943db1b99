"""The corpus pipeline: quality, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.llm import jaccard, lines, mixing, packing, quality
from inkwright.llm.shared import spread, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half, by a fit to this stage's documents.

    Null and empty texts have the score of the prior; equal rows stay or go together; without
    labels all stay; an empty table gives none; further columns are left out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs.select(COLUMNS), *quality.fit(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of 30 words or more; n_chars follows the text. A
    document that was nothing but repeats stays, with an empty text; a null text stays null; rows
    equal in id and text lose the same lines; further columns are left out."""
    out = lines.dedup_lines(docs.select(COLUMNS))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked texts the document with the smallest id (ties: the smaller hash of
    its text); rows that repeat an id and its text are kept once, texts without words (null ones
    too) are one class, a null id comes first; further columns are left out."""
    row = F.struct("doc_id", lines.document_key(F.col("doc_id"), F.col("text")).alias("key"))
    found = jaccard.near_duplicates(docs.select(row.alias("doc_id"), "text"))
    chosen = found.where(F.col("doc_id") == F.col("class_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    keep = written(chosen.select(F.col("doc_id").alias("keep"), "rows"), "keep")
    named = docs.select(*COLUMNS, row.alias("row"))
    once = lambda some: named.join(some, F.col("row") == F.col("keep"), "left_semi")
    out, repeated = once(keep.where("rows = 1")).select(COLUMNS), keep.where("rows > 1")
    if repeated.isEmpty():
        return out
    return out.unionByName(once(repeated).dropDuplicates(["row"]).select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, by weights of the text alone: a score of
    the first stage isn't a column of documents. A null source is one of its own; texts without
    words come as often as complete epochs; equal rows take turns; further columns are left out."""
    return mixing.mixed_documents(docs.select(COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in bins. Null and empty texts are pieces of 0 words; a null source
    is one of its own; copies lie in different bins; only id, text and source are read."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Learned scores, hashing to tries and sequential packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
