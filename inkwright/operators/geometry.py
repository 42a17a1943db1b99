"""Geometry of strokes: sums over ordered points, matches, and drawing order.

Points are rows (``by`` columns, idx, x, y); an order column makes every result independent of
how rows are dealt. Theta joins keep an equi-key (the page) so they plan as hash or merge joins."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Title match in pixels, share of points inside, grey steps, white, fill shares.
TITLE_PIXELS, INSIDE, SAME_GREY, WHITE = 2, 0.8, 16, 250
FILL_LEAST, FILL_SOLID = 0.15, 0.5


def bounds(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def path_length(points: DataFrame, by: list[str]) -> DataFrame:
    """The sum of distances between consecutive points; 0 for one point."""
    order = W.partitionBy(*by).orderBy("idx")
    step = F.hypot((F.col("x") - F.lag("x").over(order)).cast("double"), (F.col("y") - F.lag("y").over(order)).cast("double"))
    return points.withColumn("_step", F.coalesce(step, F.lit(0.0))).groupBy(*by).agg(F.sum("_step").alias("length"))


def ring_area(points: DataFrame, by: list[str]) -> DataFrame:
    """The signed area of the closed ring, twice (whole for whole coordinates)."""
    order, whole = W.partitionBy(*by).orderBy("idx"), W.partitionBy(*by).orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in ("x", "y"))
    return points.withColumn("_cross", F.col("x") * ny - nx * F.col("y")).groupBy(*by).agg(F.sum("_cross").alias("area2"))


def outline(points: DataFrame, by: list[str]) -> DataFrame:
    """``path_length`` and ``ring_area`` of the same points, sorted once: (``by``, length, area2)."""
    order, whole = W.partitionBy(*by).orderBy("idx"), W.partitionBy(*by).orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    step = F.hypot((F.col("x") - F.lag("x").over(order)).cast("double"), (F.col("y") - F.lag("y").over(order)).cast("double"))
    nx, ny = (F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in ("x", "y"))
    both = points.select(*by, F.coalesce(step, F.lit(0.0)).alias("_step"), (F.col("x") * ny - nx * F.col("y")).alias("_cross"))
    return both.groupBy(*by).agg(F.sum("_step").alias("length"), F.sum("_cross").alias("area2"))


def render_width(thickness: Column, area: Column, length: Column) -> Column:
    """The width of a round pen whose outline has this area along this length; without an area
    the nominal width, a hundredth of the thickness."""
    drawn = (F.sqrt(length * length + F.lit(math.pi) * area) - length) / F.lit(math.pi / 2)
    return F.when(area > 0, drawn).otherwise(thickness / F.lit(100.0))


def commonest(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first, of those the least."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_seen"))
    best = W.partitionBy(*by).orderBy(F.col("n").desc(), F.col("_seen").asc_nulls_last(), F.col(value).asc_nulls_last())
    return counted.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(*by, value, "n")


def first_seen(rows: DataFrame, value: str, order: Column) -> DataFrame:
    """The distinct values with where each was seen first: ordering by ``seen`` keeps their order."""
    return rows.groupBy(value).agg(F.min(order).alias("seen"))


def same_rect(one: list[Column], other: list[Column], tolerance: int = TITLE_PIXELS) -> Column:
    """Whether x, y, w and h all differ by the tolerance at most."""
    return reduce(and_, (F.abs(a - b) <= tolerance for a, b in zip(one, other, strict=True)))


def within(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the point lies in the box, edges included."""
    return x.between(x0, x1) & y.between(y0, y1)


def match_rects(strokes: DataFrame, titles: DataFrame, page: list[str], tolerance: int = TITLE_PIXELS) -> DataFrame:
    """Each stroke's first title (by ``ordinal``) whose x, y, w and h all differ by the tolerance at
    most; null without one. Titles carry their sides as t_x, t_y, t_w, t_h."""
    near = same_rect([F.col(side) for side in "xywh"], [F.col(f"t_{side}") for side in "xywh"], tolerance)
    found = strokes.join(titles, page, "inner").where(near)
    first = found.groupBy(*page, "stroke_id").agg(F.min_by("title_id", "ordinal").alias("title_id"))
    return strokes.join(first, [*page, "stroke_id"], "left").select(*page, "stroke_id", "title_id")


def contained(points: DataFrame, rects: DataFrame, page: list[str], share: float = INSIDE) -> DataFrame:
    """Each path's first rectangle (by rect_idx) that holds the share of its points, edges included."""
    inside = within(F.col("x"), F.col("y"), *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    counted = points.join(rects, page).groupBy(*page, "path_id", "rect_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(inside.cast("long")).alias("inside"))
    return counted.where(F.try_divide(F.col("inside").cast("double"), F.col("n")) >= share).groupBy(*page, "path_id").agg(F.min("rect_idx").alias("rect_idx"))


def overlap(mine: Mapping[str, Column], other: Mapping[str, Column]) -> Column:
    """Whether two boxes (x0, y0, x1, y1) share a point, edges included."""
    return reduce(and_, ((mine[f"{c}0"] <= other[f"{c}1"]) & (other[f"{c}0"] <= mine[f"{c}1"]) for c in "xy"))


def washes_over(mine: Mapping[str, Column], other: Mapping[str, Column]) -> Column:
    """Whether a stroke (idx, grey, box) lies as a highlighter on the other: later, lighter by more
    than 16 steps but not near-white, and overlapping."""
    return (mine["grey"] < WHITE) & (other["idx"] < mine["idx"]) & (other["grey"] + SAME_GREY < mine["grey"]) & overlap(mine, other)


def highlighters(strokes: DataFrame, page: list[str]) -> DataFrame:
    """Strokes (idx, grey, x0, y0, x1, y1) that lie as a highlighter on some other of their page."""
    of = lambda side: {c: F.col(f"{side}.{c}") for c in ("idx", "grey", "x0", "y0", "x1", "y1")}
    same = reduce(and_, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in page))
    return strokes.alias("a").join(strokes.alias("b"), same & washes_over(of("a"), of("b")), "left_semi")


def draw_order(primitives: DataFrame, page: list[str], bucket: Column) -> DataFrame:
    """Primitives numbered in drawing order: by bucket, then by stroke index."""
    return primitives.withColumn("bucket", bucket).withColumn("z", F.row_number().over(W.partitionBy(*page).orderBy("bucket", "idx")))


def fill_kind(share: Column) -> Column:
    return F.when(share < FILL_LEAST, "skip").when(share >= FILL_SOLID, "solid").otherwise("hatch")


def to_page(raw_x: Column, raw_y: Column, screen_height: Column, page_w: Column, page_h: Column) -> tuple[Column, Column]:
    """Pen coordinates as page pixels: x runs from the right edge."""
    scale = screen_height / page_h
    return page_w - raw_x / scale, raw_y / scale


def agreement(ratio: Column) -> Column:
    return F.when(ratio.between(0.9, 1.1), "match").when(ratio.between(0.75, 1.25), "near").otherwise("differs")
