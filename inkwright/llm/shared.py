"""Tables that outlive executors, and Arrow batch sizes.

``written`` cuts lineage by writing a Parquet table into the folder that all executors
share (``spark.checkpoint.dir``); a lost executor costs a rerun of the tasks that read
it, never of what came before. Each table is computed once, compressed, and is read with
column pruning and a known size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.session import ship

_own: dict[str, str] = {}

#: Rows of an Arrow batch that carries texts: some MB at a few KB a text.
BATCH_ROWS = 512
#: Equal rows that one task puts out again.
CHUNK = 4096
#: A table of fewer bytes may lie in one part of a file, which one task reads alone.
SMALL = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder of our own (local
    mode) or one in the warehouse, which executors share too."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _own:
        local = spark.conf.get("spark.master", "local").startswith("local[") or spark.conf.get("spark.master", "") == "local"
        _own[key] = tempfile.mkdtemp(prefix="inkwright-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_inkwright"
    return _own[key]


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` after one round trip through a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwright/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores; any other as it is."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has; Spark takes upper and lower case as equal."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def counted(df: DataFrame, name: str = "rows") -> DataFrame:
    """Equal rows as one row with their number, summed in each task before they are shuffled."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(name))


def expanded(df: DataFrame, count: str, turn: str) -> DataFrame:
    """Every row of ``df`` ``count`` times, with the number ``turn`` from 0. Rows that come very
    often are dealt out in chunks first, so no task makes more than CHUNK of one row."""
    each = df.where(F.col(count) <= CHUNK).withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    often = df.where(F.col(count) > CHUNK)
    (chunk,) = free_names(df, "chunk")
    often = often.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / CHUNK)))).repartition(*often.columns, chunk)
    first = F.col(chunk) * CHUNK
    often = often.withColumn(turn, F.explode(F.sequence(first, F.least(first + CHUNK, F.col(count)) - 1))).drop(chunk)
    return each.unionByName(often)


def small_batches(spark: SparkSession) -> None:
    """Before Python runs: workers find the package, and Arrow batches of texts are small, as a
    batch of long texts must fit a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
