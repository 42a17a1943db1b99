"""How much ink pages have, and how that agrees with another export of the same pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.functions.text import two_places
from inkwright.operators.geometry import agreement
from inkwright.plans import notebook

# Fixed value: what erasers draw; it is no ink, while nearly white ink is.
WHITE = "rgb(255,255,255)"


def _ink(it: Column) -> Column:
    """Of rectangles and outlines the area, of lines length times width."""
    p, q = F.get(it["points"], F.lit(0)), F.get(it["points"], F.lit(1))
    box = F.abs(p["x"] - q["x"]) * F.abs(p["y"] - q["y"])
    drawn = F.when(it["kind"] == "filledPath", notebook.area(it["rings"])).otherwise(notebook.length(it["points"]) * it["width"])
    return F.when(it["kind"] == "rect", box).when(it["colour"] == WHITE, F.lit(0.0)).otherwise(drawn)


def ink_areas(notes: DataFrame) -> DataFrame:
    """(note_id, page_no, ink): the area of what is drawn of each page's strokes, overlaps counted twice."""
    total = F.aggregate(F.transform("primitives", _ink), F.lit(0.0), lambda a, v: a + v)
    return notebook.vector_pages(notes).select(*notebook.PAGE, total.alias("ink"))


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pages that both exports (note_id, page_no, ink) have, with what their ratio says and its tone."""
    both = ours.join(theirs.select(*notebook.PAGE, F.col("ink").alias("other")), notebook.PAGE)
    ratio = F.try_divide("ink", "other")
    none, lost = (F.col("other") <= 0) & (F.col("ink") <= 0), F.col("other") <= 0
    tone = agreement(ratio)
    said = F.when(none, "no ink either side").when(lost, "the other draws nothing").otherwise(F.concat(two_places(ratio), F.lit(" times the other's ink")))
    return both.select(*notebook.PAGE, "ink", "other", said.alias("said"), F.when(none, "none").when(lost, "differs").otherwise(tone).alias("tone"))


def listed_first(rows: DataFrame, name: str, listed: list[str]) -> DataFrame:
    """Rows with ``rank`` to order them by: names of the list in its order, then all others as one."""
    place = F.array_position(F.array(*map(F.lit, listed)), F.col(name))
    return rows.withColumn("rank", F.when(place > 0, place).otherwise(F.lit(len(listed) + 1).cast("long")))
