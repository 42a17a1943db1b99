"""Mixing sources to target weights: Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws ``u`` from its id and text and gets the exponential key ``-ln(u) / weight``;
the smallest keys of a source come first, so a document's chance grows with its quality weight.
The weight is an expression over the document's columns; ``quality_weight`` reads the text, and
``mix`` takes any other, such as a joined column of classifier scores.
A source's target is met by complete epochs over all its documents first, then by the
documents whose running size reaches the rest of the budget.

A source may hold a third of all rows, so running sums are two-level: keys are cut into
ranges, ranges are summed, and only the sums are scanned per source. A range is a step of
ln(key): whatever the weights, the logarithm of an exponential number has a density of 1/e at
most (a weight only shifts it), so with R steps to a unit no range expects more than 0.37 / R of
a source's documents. R is the rows of the source over ``max(500, their square root)``. Rows that
are equal in id, source, key and size are one row with a number, so they can't crowd a range.

Edges: a null text has size 0 and weight 1; a null source is a source of its own, last; ties
of keys go by doc_id and size, and equal rows are interchangeable; a null or repeated id draws
again for each of its texts; an empty table gives an empty table; a document without words
comes as often as its source's complete epochs; sources without a single word have target 0;
only doc_id, text, source and what the weight names are read, and other columns pass through
``mixed_documents`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkwright.llm.shared import counted, expanded, free_names, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Characters that speak against running prose; their share lowers a document's weight.
NOISE = "!$%&*#|=<>{}[]~^_0123456789"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 for noise only up to 1 for none; 1 for empty texts."""
    clean = F.length(F.translate(text, NOISE, ""))
    return F.when(F.length(text) > 0, F.lit(0.25) + F.lit(0.75) * clean / F.length(text)).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, text: Column, weight: Column) -> Column:
    drawn = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))
    digits = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long")
    return -F.ln((digits + F.lit(0.5)) / F.lit(float(2**52))) / weight


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources(source, source_size, n)`` with targets. One row a source, so windows over all
    of them stay small. A source is capped if its cap is below its share of what the sources
    with lower caps per weight leave; that is the fixed point of resharing step by step."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_cap = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place").asc())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = (
        sources.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (turn + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("above", F.sum("weight").over(by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("above") < (F.col("total") - F.col("spent")) * F.col("weight"))
        .withColumn("rest", F.col("total") - F.min(F.when(~F.col("capped"), F.col("spent"))).over(everything))
        .withColumn("shared", F.max(F.when(~F.col("capped"), F.col("above"))).over(everything))
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("rest")).cast("double") / F.col("shared"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0).cast("long"))
    return (
        ranked.withColumn("target", target)
        .withColumn("epochs", whole)
        .withColumn("part", F.when(F.col("epochs") >= max_epochs, 0.0).otherwise(F.col("target") - F.col("epochs") * F.col("source_size")))
        .withColumn("ranges", F.col("n") / F.greatest(F.lit(500.0), F.sqrt(F.col("n").cast("double"))))
        .select("source", "source_size", "n", "target", "epochs", "part", "ranges")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, weight: Column | None = None) -> DataFrame:
    """Rows of ``docs`` as (doc_id, source, size, key, source_size, target, epochs, part, copies, taken)."""
    return expanded(_placed(docs, weights, max_epochs, weight), "rows", "turn").select(
        "doc_id", "source", "size", "key", "source_size", "target", "epochs", "part",
        _copies(F.col("turn")).alias("copies"), (F.col("size") * _copies(F.col("turn"))).alias("taken"),
    )


def _copies(turn: Column) -> Column:
    """Complete epochs, and one more where the middle of the document lies within the budget's rest."""
    start = F.col("before") + F.col("inside") + turn * F.col("size")
    return F.col("epochs") + F.when((F.col("part") > 0) & (start + F.col("size") / 2.0 <= F.col("part")), 1).otherwise(0)


def _placed(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, weight: Column | None) -> DataFrame:
    """Different rows (doc_id, source, size, key) with their number ``rows``, their source's target, and
    the words ahead of the first of them: in earlier ranges (``before``) and in its own (``inside``)."""
    weight = quality_weight(F.col("text")) if weight is None else weight
    sized = written(
        counted(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), sampling_key(F.col("doc_id"), F.col("text"), weight).alias("key"))),
        "sizes",
    )
    words = F.col("size") * F.col("rows")
    sources = sized.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum("rows").alias("n"))
    targets = written(source_targets(sources, weights, max_epochs).withColumnRenamed("source", "t_source"), "targets")
    placed = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("range", F.floor(F.ln("key") * F.col("ranges")))
        .select("doc_id", "source", "size", "key", "rows", "source_size", "target", "epochs", "part", "range")
    )
    sums = placed.groupBy("source", "range").agg(F.sum(words).alias("range_size"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = written(
        sums.select(F.col("source").alias("s_source"), F.col("range").alias("s_range"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("before")),
        "ranges",
    )
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("inside", F.coalesce(F.sum(words).over(within), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, weight: Column | None = None) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Texts aren't shuffled: a source's decision
    is its epochs and the last key taken, and a document's key comes from its own row. Only where the
    budget ends among equal rows are those numbered, in a second pass, so that ``many`` of them go."""
    weight = quality_weight(F.col("text")) if weight is None else weight
    placed = _placed(docs, weights, max_epochs, weight)
    more = _copies(F.lit(0).cast("long")) > F.col("epochs")
    room = F.floor((F.col("part") - F.col("before") - F.col("inside") - F.col("size") / 2.0) / F.greatest(F.col("size"), F.lit(1))) + 1
    many = F.when(F.col("size") > 0, F.least(F.col("rows"), room)).otherwise(F.col("rows"))
    last = F.max(F.when(more, F.struct("key", "doc_id", "size", many.alias("many"), "rows")))
    cuts = placed.groupBy(F.col("source").alias("source")).agg(F.first("epochs").alias("epochs"), last.alias("last"))
    a, b, c, d = free_names(docs, "t_source", "t_epochs", "t_last", "t_time")
    cuts = written(cuts.select(F.col("source").alias(a), F.col("epochs").alias(b), F.col("last").alias(c)), "cuts")
    key = F.struct(sampling_key(F.col("doc_id"), F.col("text"), weight).alias("key"), F.col("doc_id"), size_of(F.col("text")).alias("size"))
    cut = F.struct(F.col(c)["key"].alias("key"), F.col(c)["doc_id"].alias("doc_id"), F.col(c)["size"].alias("size"))
    known = docs.join(cuts, F.col("source").eqNullSafe(F.col(a)))
    out = known.withColumn(d, F.col(b) + F.when(F.col(c).isNotNull() & (key <= cut), 1).otherwise(0))
    ends_within = F.col(c)["many"] < F.col(c)["rows"]
    if not cuts.where(ends_within).isEmpty():
        part = F.coalesce(ends_within & key.eqNullSafe(cut), F.lit(False))
        turn = F.row_number().over(W.partitionBy(a).orderBy("doc_id"))
        out = out.where(~part).unionByName(known.where(part).withColumn(d, F.col(b) + F.when(turn <= F.col(c)["many"], 1).otherwise(0)))
    return out.withColumn(d, F.explode(F.array_repeat(F.lit(0), F.col(d).cast("int")))).select(*[F.col(f"`{x}`") for x in docs.columns])
