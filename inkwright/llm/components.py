"""Connected components by alternating stars, as tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.llm.shared import written


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)`` but the roots themselves; the root is the
    smallest node of its component.

    Large stars point all greater neighbours of a node at its smallest one, small stars its
    smaller neighbours; when neither changes anything each component is one star. Minima are
    aggregated before they are shuffled and written before they are joined, so a node with very
    many neighbours is split like any skewed join. Nothing is collected but a count and a hash."""
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(),
        "edges",
    )
    was = _print(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "x"), "low")
        large = written(both.join(low, F.col("u") == F.col("x")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"), "low")
        small = large.join(low, F.col("u") == F.col("x")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = _print(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
