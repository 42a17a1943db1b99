"""Run-length coded bitmaps, kept as runs: the fold over byte pairs, offsets, sampling, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The length of a 0xFF run, and its length where a layer is blank all over.
LONG, LONG_BLANK = 0x4000, 0x400

# Colour codes as red, green, blue, alpha; any other code is clear white.
PALETTE = {
    0x61: (0, 0, 0, 255),
    0x62: (0, 0, 0, 0),
    0x63: (128, 128, 128, 255),
    0x64: (169, 169, 169, 255),
    0x65: (255, 255, 255, 255),
    0x66: (0, 0, 0, 255),
    0x67: (128, 128, 128, 255),
    0x68: (169, 169, 169, 255),
    0x9D: (128, 128, 128, 255),
    0xC9: (169, 169, 169, 255),
    0x9E: (128, 128, 128, 255),
    0xCA: (169, 169, 169, 255),
}
UNKNOWN = (255, 255, 255, 0)


def fold(pairs: DataFrame, by: list[str], pixels: Column, blank: bool = False) -> DataFrame:
    """Runs (``by``, idx, code, len) of a bitmap's byte pairs (``by``, idx, code, n).

    A length byte with its high bit set is held back: with the next pair's equal code it is the
    upper part of one length, else it stands alone. So a pair is joined to the one before if that
    could be held and wasn't joined itself: in a row of pairs that could be joined, every second
    one is, counted from the first. What is held at the end is the largest of its eight sizes
    that fits the rest of ``pixels``. One sort a bitmap, and no array grows."""
    order = W.partitionBy(*by).orderBy("idx")
    upto, whole = order.rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy(*by)
    run = lambda code, n: F.array(F.struct(code.cast("int").alias("code"), n.cast("long").alias("len")))
    upper = lambda n: F.shiftleft((n.bitwiseAND(127) + 1).cast("long"), 7)
    none = F.array().cast("array<struct<code:int,len:bigint>>")
    code, n, high = F.col("code"), F.col("n"), (F.col("n") >= 128) & (F.col("n") != 255)
    rows = pairs.select(*by, "idx", "code", "n", F.row_number().over(order).alias("_at"), F.lag("code").over(order).alias("_code"), F.lag("n").over(order).alias("_n"), F.lead("n").over(order).isNull().alias("_last"))
    rows = rows.withColumn("_could", F.coalesce((F.col("_n") >= 128) & (F.col("_n") != 255) & (F.col("_code") == code), F.lit(False)))
    rows = rows.withColumn("_joins", F.col("_could") & ((F.col("_at") - F.max(F.when(~F.col("_could"), F.col("_at"))).over(upto)) % 2 == 1))
    rows = rows.withColumn("_held", high & ~F.col("_joins"))
    before = F.when(F.coalesce(F.lag("_held").over(order), F.lit(False)), run(F.col("_code"), upper(F.col("_n")))).otherwise(none)
    alone = F.when(n == 255, run(code, F.lit(LONG_BLANK if blank else LONG))).when(n >= 128, none).otherwise(run(code, n + 1))
    rows = rows.withColumn("_runs", F.when(F.col("_joins"), run(code, n + 1 + upper(F.col("_n")))).otherwise(F.concat(before, alone)))
    gap = pixels - F.sum(F.aggregate("_runs", F.lit(0).cast("long"), lambda a, r: a + r["len"])).over(whole)
    sizes = F.transform(F.sequence(F.lit(7), F.lit(0)), lambda i: F.call_function("shiftleft", (n.bitwiseAND(127) + 1).cast("long"), i))
    fits = F.get(F.filter(sizes, lambda s: s <= F.col("_gap")), F.lit(0))
    tail = F.when(F.col("_held") & F.col("_last") & fits.isNotNull(), run(code, fits)).otherwise(none)
    found = rows.withColumn("_gap", gap).select(*by, "_at", F.posexplode(F.concat("_runs", tail)).alias("_place", "_run"))
    return found.select(*by, (F.row_number().over(W.partitionBy(*by).orderBy("_at", "_place")) - 1).alias("idx"), "_run.code", "_run.len")


def offsets(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs (idx, len) with the place where each starts."""
    return runs.withColumn("start", F.coalesce(F.sum("len").over(W.partitionBy(*by).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))


def sampled(runs: DataFrame, width: int, factor: int) -> DataFrame:
    """The pixels of every ``factor``-th row and column, as rows (x, y, code) of the smaller image,
    straight from the runs: only the places that are kept are ever made, by arithmetic."""
    start, end = F.col("start"), F.col("start") + F.col("len") - 1
    up = lambda c: F.ceil(c / factor)
    between = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    row = lambda p: F.floor(p / width)
    rows = runs.where("len > 0").withColumn("y", F.explode(between(up(row(start)), F.floor(row(end) / factor))))
    first = F.when(F.col("y") * factor == row(start), start % width).otherwise(F.lit(0))
    last = F.when(F.col("y") * factor == row(end), end % width).otherwise(F.lit(width - 1))
    return rows.withColumn("x", F.explode(between(up(first), F.floor(last / factor))))


def topmost(rows: DataFrame, by: list[str], priority: str) -> DataFrame:
    """For each pixel the row of the first layer that has ink there."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(priority))).where("_rank = 1").drop("_rank")


def rgba(code: Column) -> Column:
    """array<int> of a code's red, green, blue and alpha."""
    table = F.create_map(*[x for k, v in PALETTE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.array(*map(F.lit, UNKNOWN)))


def grid(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells (``by``, col, row) with the first column and the last row of their document's grid."""
    whole = W.partitionBy(*by)
    return cells.withColumns({"left_col": F.min("col").over(whole), "last_row": F.max("row").over(whole)})


def tile_cell(tid: Column) -> tuple[Column, Column]:
    """Column and row of a tile id."""
    return F.floor(tid / 4096), tid % 4096
