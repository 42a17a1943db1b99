"""Filters and names of strokes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pen and grey numbers, and what marks records that aren't ink.
PENS = {10: "needlePoint", 16: "inkPen", 11: "marker", 5: "marker", 15: "calligraphy"}
GREYS = {48: 157, 49: 158, 80: 201, 81: 202}
ERASER, LASSO_CLASS, LASSO_PEN = 255, -5, 4
LINK_BOX, RECT, STAR = "0000", "0001", "fiveStarsSignal"


def _named(names: dict, key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key.cast("int")), other)


def pen_name(pen: Column, kind: Column) -> Column:
    return F.when(kind == STAR, "unknown").otherwise(_named(PENS, pen, F.lit("unknown")))


def grey_level(colour: Column) -> Column:
    return _named(GREYS, colour, colour.cast("int"))


def is_ink(kind: Column, record_class: Column, pen: Column) -> Column:
    """Neither a link's box nor a lasso. Erasers are ink here."""
    return (kind != LINK_BOX) & (record_class != LASSO_CLASS) & (pen != LASSO_PEN)


def is_drawn(trail_status: Column, eraser: Column, rect: Column) -> Column:
    """Without a trail status; erasers and rectangles whatever theirs."""
    return (F.coalesce(trail_status, F.lit(0)) == 0) | eraser | rect


def ink(records: DataFrame, include_erasers: bool = False) -> DataFrame:
    """Records (pen, colour, record_class, kind, trail_status) that are ink, with names and flags."""
    eraser = F.col("colour") == ERASER
    out = records.where(is_ink(F.col("kind"), F.col("record_class"), F.col("pen")))
    out = out if include_erasers else out.where(~eraser)
    return out.withColumns({"is_eraser": eraser, "is_rect": F.col("kind") == RECT, "is_star": F.col("kind") == STAR, "pen_name": pen_name(F.col("pen"), F.col("kind")), "grey": grey_level(F.col("colour"))})


def live(strokes: DataFrame) -> DataFrame:
    return strokes.where(is_drawn(F.col("trail_status"), F.col("is_eraser"), F.col("is_rect")))


def live_count(heads: Column) -> Column:
    """How many of an array of records are live ink, erasers left out."""
    return F.size(F.filter(heads, lambda r: is_ink(r["kind"], r["record_class"], r["pen"]) & (r["colour"] != ERASER) & is_drawn(r["trail_status"], F.lit(False), r["kind"] == RECT)))
