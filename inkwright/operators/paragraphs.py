"""Recognized text: words of elements, visual lines, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkwright.functions.text import repair

# What makes one line, what makes a new paragraph, and how many lines set the scale.
SAME_LINE, NEW_PARAGRAPH, RECENT = 0.5, 1.0, 3

WORDS = "array<struct<label:string,`bounding-box`:struct<x:double,y:double,width:double,height:double>>>"
SIDES = (
    ("x", F.array_min, lambda w: w["bounding-box"]["x"]),
    ("top", F.array_min, lambda w: w["bounding-box"]["y"]),
    ("bottom", F.array_max, lambda w: w["bounding-box"]["y"] + w["bounding-box"]["height"]),
)


def visual_lines(fragments: DataFrame, page: list[str]) -> DataFrame:
    """Fragments (``page`` columns, ordinal, x, top, bottom, text) that share a visual line become
    one row: text by x, least x and top, greatest bottom. A fragment starts a line unless its top
    lies less than half the lower of the two heights below that of the fragment before it."""
    order = W.partitionBy(*page).orderBy("top", "ordinal")
    height = F.col("bottom") - F.col("top")
    joins = F.col("top") - F.lag("top").over(order) < SAME_LINE * F.least(F.lag(height).over(order), height)
    numbered = fragments.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("line_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    words = F.array_sort(F.collect_list(F.struct("x", "top", "ordinal", "text")))
    return numbered.groupBy(*page, "line_no").agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"),
        F.min("x").alias("x"),
        F.min("top").alias("top"),
        F.max("bottom").alias("bottom"),
        F.count(F.lit(1)).alias("fragments"),
    )


def paragraphs(lines: DataFrame, page: list[str]) -> DataFrame:
    """Lines (``page`` columns, line_no, top, bottom, text) joined to one text a page: an empty line
    between two lines whose gap exceeds the mean height of up to three lines before it, else a space."""
    order = W.partitionBy(*page).orderBy("top", "line_no")
    scale = F.avg(F.col("bottom") - F.col("top")).over(order.rowsBetween(-RECENT, -1))
    gap = F.col("top") - F.lag("bottom").over(order)
    lead = F.when(F.lag("top").over(order).isNull(), "").when(gap > NEW_PARAGRAPH * scale, "\n\n").otherwise(" ")
    parts = F.array_sort(F.collect_list(F.struct("_at", "_said")))
    return (
        lines.withColumn("_at", F.row_number().over(order))
        .withColumn("_said", F.concat(lead, "text"))
        .withColumn("_break", (lead == "\n\n").cast("long"))
        .groupBy(*page)
        .agg(F.array_join(F.transform(parts, lambda p: p["_said"]), "").alias("text"), (F.sum("_break") + 1).alias("paragraphs"), F.count(F.lit(1)).alias("lines"))
    )


def joined(elements: DataFrame, page: list[str], separator: str = "\n") -> DataFrame:
    """Texts (``page`` columns, ordinal, text) of each page joined in order."""
    said = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return elements.groupBy(*page).agg(F.array_join(F.transform(said, lambda w: w["text"]), separator).alias("text"), F.count(F.lit(1)).alias("n"))


def page_lines(elements: Column) -> Column:
    """The lines of a page's text elements: array<struct<ordinal, text, x, top, bottom>>. A label is
    cut at line feeds and its words at words that are a line feed without a box; if these don't
    agree in number, the element is one line. Lines without text or boxes drop out."""
    line_of = lambda words, text, ordinal: F.struct(ordinal.cast("long").alias("ordinal"), F.trim(text).alias("text"), *(agg(F.transform(words, side)).alias(n) for n, agg, side in SIDES))

    def lines(e: Column, at: Column) -> Column:
        words = F.coalesce(e["words"], F.array().cast(WORDS))
        label = F.coalesce(repair(e["label"]), e["label"])
        is_mark = lambda w: (w["label"] == "\n") & w["bounding-box"].isNull()
        boxed = lambda some: F.filter(some, lambda w: w["bounding-box"].isNotNull())
        marks = F.filter(F.transform(words, lambda w, i: F.when(is_mark(w), i + 1)), lambda i: i.isNotNull())
        cuts = F.concat(F.array(F.lit(0)), marks, F.array(F.size(words) + 1))  # places, from 1, around each line
        parts = F.split(label, "\n")
        each = F.transform(parts, lambda text, i: line_of(boxed(F.slice(words, F.get(cuts, i) + 1, F.get(cuts, i + 1) - F.get(cuts, i) - 1)), text, at.cast("long") * 100000 + i))
        whole = F.array(line_of(boxed(words), F.regexp_replace(label, "\n", " "), at.cast("long") * 100000))
        return F.when(F.size(marks) + 1 == F.size(parts), each).otherwise(whole)

    text = F.filter(elements, lambda e: (e["type"] == "Text") & e["label"].isNotNull())
    return F.filter(F.flatten(F.transform(text, lines)), lambda x: (x["text"] != "") & x["top"].isNotNull())
