"""SVG pages as strings, built from expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.functions.text import js_number, two_places, xml

# Markup whose attributes renderers rely on.
HEAD = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" '
ROUND = 'stroke-linecap="round" stroke-linejoin="round"'


def _path(points: Column) -> Column:
    steps = F.transform(points, lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), two_places(p["x"]), F.lit(","), two_places(p["y"])))
    return F.array_join(steps, " ")


def open_path(points: Column, colour: Column, width: Column) -> Column:
    """An array of points as an open line with round ends."""
    return F.concat(F.lit('<path d="'), _path(points), F.lit('" fill="none" stroke="'), colour, F.lit('" stroke-width="'), width, F.lit(f'" {ROUND}/>'))


def stroked_path(points: DataFrame, by: list[str], colour: Column, width: Column) -> DataFrame:
    """Points (``by``, idx, x, y) as one ``element`` each: an open line with round ends."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "x", "y")))
    d = points.groupBy(*by).agg(ordered.alias("_points"))
    return d.select(*by, open_path(F.col("_points"), colour, width).alias("element"))


def rect(x: Column, y: Column, w: Column, h: Column, fill: Column) -> Column:
    parts = [F.lit('<rect x="'), two_places(x), F.lit('" y="'), two_places(y), F.lit('" width="'), two_places(w), F.lit('" height="'), two_places(h), F.lit('" fill="'), fill, F.lit('"/>')]
    return F.concat(*parts)


def filled_path(rings: Column, colour: Column) -> Column:
    """Rings (arrays of points) as one closed, filled path."""
    return F.concat(F.lit('<path d="'), F.array_join(F.transform(rings, lambda r: F.concat(_path(r), F.lit(" Z"))), " "), F.lit('" fill="'), colour, F.lit('"/>'))


def hatch_id(colour: Column) -> Column:
    return F.concat(F.lit("hatch-"), F.regexp_replace(colour, "[^a-zA-Z0-9]", "-"))


def hatch(colour: Column) -> Column:
    """The pattern of a hatched heading: white with slanted lines."""
    body = '" patternUnits="userSpaceOnUse" width="10" height="10" patternTransform="rotate(45)"><rect width="10" height="10" fill="white"/><line x1="0" y1="0" x2="0" y2="10" stroke="'
    return F.concat(F.lit('<pattern id="'), hatch_id(colour), F.lit(body), colour, F.lit('" stroke-width="5"/></pattern>'))


def primitive(it: Column) -> Column:
    """What is drawn of one stroke (kind, colour, width, fill, points, rings)."""
    p0, p1 = F.get(it["points"], F.lit(0)), F.get(it["points"], F.lit(1))
    paint = F.when(it["fill"] == "hatch", F.concat(F.lit("url(#"), hatch_id(it["colour"]), F.lit(")"))).otherwise(it["colour"])
    box = rect(F.least(p0["x"], p1["x"]), F.least(p0["y"], p1["y"]), F.abs(p1["x"] - p0["x"]), F.abs(p1["y"] - p0["y"]), paint)
    line = open_path(it["points"], it["colour"], js_number(it["width"]))
    return F.when(it["kind"] == "rect", box).when(it["kind"] == "filledPath", filled_path(it["rings"], it["colour"])).otherwise(line)


def word(label: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """An invisible word, anchored at the lower edge of its box."""
    parts = [F.lit('<text x="'), js_number(x), F.lit('" y="'), js_number(y + h), F.lit('" font-size="'), js_number(h), F.lit('" textLength="'), js_number(w), F.lit('" lengthAdjust="spacingAndGlyphs" fill="transparent">'), xml(label), F.lit("</text>")]
    return F.concat(*parts)


def page(elements: DataFrame, by: list[str], width: int, height: int, dpi: int | None = None) -> DataFrame:
    """Elements (``by``, z, element) of each page in order, as one document."""
    size = lambda n: f"{n / dpi:g}in" if dpi else str(n)
    parts = F.array_sort(F.collect_list(F.struct("z", "element")))
    body = F.array_join(F.transform(parts, lambda e: e["element"]), "")
    head = f'{HEAD}width="{size(width)}" height="{size(height)}" viewBox="0 0 {width} {height}">'
    return elements.groupBy(*by).agg(F.concat(F.lit(head), body, F.lit("</svg>")).alias("svg"))
