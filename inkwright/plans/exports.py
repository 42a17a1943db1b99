"""Queries that write notebook files from the star schema, read them back and export them.

Suppliers are the pages of their nation's notebook, customers of that nation its strokes, titles
and words; or customers are pages themselves. Every number is a rule over a key, so SQL can say
what a page shows: black rows above ``b1``, grey ones down to ``b2``, and nothing below.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkwright.functions.text import mark_key, page_of_key
from inkwright.operators import render
from inkwright.plans import comparison, notebook
from inkwright.plans.queries import query
from inkwright.session import ship, table
from inkwright.sources import container, png, stroke_log, tiles, writer

WIDE, HIGH = 1404, 1872
BLACK, GREY, CLEAR = 0x61, 0x9D, 0x62


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, p, k): customers on the pages that their nation's suppliers are."""
    many = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("k")).join(many, "n").select("n", (F.col("k") % F.col("c") + 1).alias("p"), "k")


def _pick(values: tuple, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pages(spark: SparkSession, sf_dir: str, words: bool = True) -> DataFrame:
    """Pages as ``writer.PAGES`` wants them: layers, strokes, titles, words."""
    k = F.col("k")
    x0, y0, dx = 100 + k * 37 % 1000 + F.lit(0.5) * (k % 2), 100 + k * 53 % 1500, 40 + k % 200
    dy = F.when(k % 3 == 0, 0).otherwise(k % 60)
    side = 1 + k % 2  # pens count in pixels or in halves of them
    pen = lambda p: _xy((WIDE - p["x"]) * side, p["y"] * side)
    long = (k % 19 == 0) & (k % 11 != 0)
    zigzag = F.transform(F.sequence(F.lit(0), F.lit(129)), lambda j: _xy(100 + 8 * j, F.when((j % 2 == 0) == (k % 38 != 0), 1850).otherwise(50)))
    points = F.transform(F.when(long, zigzag).otherwise(F.array(_xy(x0, y0), _xy(x0 + dx, y0 + dy))), pen)
    ring = F.slice(F.array(_xy(x0, y0), _xy(x0 + dx, y0), _xy(x0 + dx, y0 + 6), _xy(x0, y0 + 6)), 1, F.when(k % 14 == 0, 2).otherwise(4))
    more = F.array(_xy(x0, y0), _xy(x0 + 10, y0), _xy(x0, y0 + 10))
    none = F.array().cast(f"array<array<{writer.POINT}>>")
    rings = F.concat(F.when(k % 7 == 0, F.array(ring)).otherwise(none), F.when(k % 21 == 0, F.array(more)).otherwise(none))
    kind = F.when(k % 17 == 0, "0000").when(k % 11 == 0, "0001").otherwise("others")
    stroke = F.struct(
        points.alias("points"), _pick((10, 16, 11, 5, 15, 7), k).alias("pen"), _pick((0, 48, 80, 255, 0), F.floor(k / 6)).alias("colour"), (400 + k % 3 * 50).cast("int").alias("thickness"),
        F.when(k % 13 == 0, -5).otherwise(5000).alias("record_class"), kind.alias("kind"), F.when(k % 5 == 0, -2).otherwise(0).alias("status"), (side * HIGH).cast("int").alias("screen"), rings.alias("rings"),
    )
    rect = F.concat_ws(",", *(c.cast("long").cast("string") for c in (100 + k * 37 % 1000, y0, dx, dy)))
    values = F.create_map(F.lit("TITLERECT"), rect, F.lit("TITLESTYLE"), F.when(k % 44 == 0, "1000000").otherwise("1157254"))
    title = F.struct(F.lit("TITLE").alias("kind"), mark_key(F.col("p"), k).alias("key"), values.alias("values"), F.lit(None).cast("binary").alias("body"))
    word = F.struct(F.concat(F.lit("é<"), k.cast("string"), F.lit('&"')).alias("label"), *((c * 10).cast("double").alias(n) for c, n in ((k % 12, "x"), (k % 14, "y"), (1 + k % 3, "w"), (F.lit(1), "h"))))
    spread = _spread(spark, sf_dir).select("n", "p", "k", stroke.alias("stroke"), F.when((kind == "0001") & (k % 22 == 0), title).alias("title"), F.when((k % 4 == 0) & F.lit(words), word).alias("word"))
    of = lambda name: F.filter(F.transform(F.col("found"), lambda r: r[name]), lambda v: v.isNotNull()).alias(f"{name}s")
    drawn = spread.groupBy("n", "p").agg(F.array_sort(F.collect_list(F.struct("k", "stroke", "title", "word")), lambda a, b: (a["k"] - b["k"]).cast("int")).alias("found")).select("n", "p", of("stroke"), of("title"), of("word"))
    nation, s = W.partitionBy("s_nationkey"), F.col("s_suppkey")
    b1 = (300 + s * 91 % 700).cast("int")
    run = lambda code, n: F.struct(F.lit(code).alias("code"), n.cast("int").alias("len"))
    layer = lambda name, *runs: F.struct(F.lit(name).alias("name"), F.array(*runs).alias("runs"))
    rest = lambda y: run(CLEAR, (HIGH - y) * WIDE)
    layers = F.array(layer("MAINLAYER", run(BLACK, b1 * WIDE), rest(b1)), layer("LAYER1", run(CLEAR, (b1 - 100) * WIDE), run(GREY, F.lit(500 * WIDE)), rest(b1 + 400)), layer("BGLAYER", run(CLEAR, F.lit(WIDE * HIGH))))
    pages = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.row_number().over(nation.orderBy("s_suppkey")).cast("long").alias("p"), layers.alias("layers"))
    header = F.create_map(F.lit("APPLY_EQUIPMENT"), F.lit("N6"))
    some = lambda name: F.coalesce(F.col(name), F.array())
    return pages.join(drawn, ["n", "p"], "left").select(
        F.col("n").cast("string").alias("note_id"), F.col("p").cast("int").alias("page_no"), header.alias("header"), F.create_map(F.lit("LAYERSEQ"), F.lit("MAINLAYER,LAYER1,BGLAYER")).alias("values"),
        "layers", some("strokes").alias("strokes"), some("titles").alias("marks"), some("words").alias("words"),
    )


def _notes(spark: SparkSession, sf_dir: str, words: bool = True) -> DataFrame:
    return container.notes(writer.notes(_pages(spark, sf_dir, words)))


PAGES_SQL = """g AS (SELECT s_nationkey AS n, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS p, count(*) OVER (PARTITION BY s_nationkey) AS c,
  (300 + s_suppkey * 91 % 700)::BIGINT AS b1, (700 + s_suppkey * 91 % 700)::BIGINT AS b2 FROM supplier)"""
RECORDS_SQL = f"""{PAGES_SQL},
r AS (SELECT g.n, g.p, c_custkey AS k, row_number() OVER (PARTITION BY g.n, g.p ORDER BY c_custkey) - 1 AS idx, b1, b2,
  [10, 16, 11, 5, 15, 7][(c_custkey % 6 + 1)::INT] AS pen, [0, 48, 80, 255, 0][(c_custkey // 6 % 5 + 1)::INT] AS colour, 400 + c_custkey % 3 * 50 AS thick, c_custkey % 13 = 0 AS lasso,
  CASE WHEN c_custkey % 17 = 0 THEN '0000' WHEN c_custkey % 11 = 0 THEN '0001' ELSE 'others' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN -2 ELSE 0 END AS status,
  100 + c_custkey * 37 % 1000 AS xi, (100 + c_custkey * 37 % 1000 + 0.5::DOUBLE * (c_custkey % 2))::DOUBLE AS x0, 100 + c_custkey * 53 % 1500 AS y0, 40 + c_custkey % 200 AS dx,
  CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 60 END AS dy, c_custkey % 19 = 0 AND c_custkey % 11 <> 0 AS zig
  FROM customer JOIN g ON g.n = c_nationkey AND g.p = c_custkey % g.c + 1),
j AS (SELECT *, unnest(range(CASE WHEN zig THEN 130 ELSE 2 END)) AS j FROM r),
pt AS (SELECT *, (CASE WHEN zig THEN 100 + 8 * j ELSE x0 + j * dx END)::DOUBLE AS x, (CASE WHEN zig THEN CASE WHEN (j % 2 = 0) = (k % 38 <> 0) THEN 1850 ELSE 50 END ELSE y0 + j * dy END)::DOUBLE AS y FROM j)"""
DRAWN_SQL = f"""{RECORDS_SQL},
ink AS (SELECT *, CASE colour WHEN 48 THEN 157 WHEN 80 THEN 201 ELSE colour END AS own, kind = '0001' AND colour <> 255 AS two FROM r WHERE NOT lasso AND kind <> '0000'),
t AS (SELECT n, p, k AS tk, xi AS tx, y0 AS ty, dx AS tw, dy AS th, CASE WHEN k % 44 = 0 THEN 0 ELSE 157 END AS back, CASE WHEN k % 44 = 0 THEN 0 ELSE 254 END AS fore FROM r WHERE kind = '0001' AND k % 22 = 0),
tm AS (SELECT n, p, idx, back, fore FROM ink JOIN t USING (n, p) WHERE two AND abs(x0 - tx) <= 2 AND abs(y0 - ty) <= 2 AND abs(dx - tw) <= 2 AND abs(dy - th) <= 2
  QUALIFY row_number() OVER (PARTITION BY n, p, idx ORDER BY tk) = 1),
dots AS (SELECT n, p, idx, j, x, y, floor(y + 0.5::DOUBLE) AS yi, CASE WHEN floor(y + 0.5::DOUBLE) < b1 THEN 0 WHEN floor(y + 0.5::DOUBLE) < b2 THEN 128 END AS grey FROM pt),
un AS (SELECT n, p, idx, grey AS under FROM (SELECT n, p, idx, grey, count(*) AS c, min(j) AS f FROM dots WHERE grey IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n, p, idx ORDER BY c DESC, f) = 1),
rs AS (SELECT *, greatest(0, least(y0 + dy, b2 - 1) - y0 + 1) AS inked, greatest(0, least(y0 + dy, b1 - 1) - y0 + 1) AS dark FROM ink),
st AS (SELECT rs.*, back, fore, under, CASE WHEN two THEN CASE WHEN back IS NOT NULL THEN CASE WHEN back = 0 AND fore = 0 THEN 'hatch' ELSE 'solid' END
    WHEN inked::DOUBLE / (dy + 1) < 0.15 THEN 'skip' WHEN inked::DOUBLE / (dy + 1) >= 0.5 THEN 'solid' ELSE 'hatch' END END AS fill,
  CASE WHEN inked = 0 OR dark >= inked - dark THEN 0 ELSE 128 END AS fill_grey FROM rs LEFT JOIN tm USING (n, p, idx) LEFT JOIN un USING (n, p, idx)),
rx AS (SELECT n, p, idx AS ri, floor(x0) AS ax, y0 AS ay, least(1403, ceil(x0 + dx)) AS bx, least(1871, y0 + dy) AS by_, fore AS rf FROM st WHERE two AND fill <> 'skip'),
lb AS (SELECT n, p, idx, ri, rf FROM dots JOIN rx USING (n, p) GROUP BY n, p, idx, ri, rf HAVING avg(CASE WHEN x BETWEEN ax AND bx AND y BETWEEN ay AND by_ THEN 1.0::DOUBLE ELSE 0 END) >= 0.8
  QUALIFY row_number() OVER (PARTITION BY n, p, idx ORDER BY ri) = 1),
sh AS (SELECT st.*, CASE WHEN two THEN coalesce(back, fill_grey) WHEN colour = 255 THEN own ELSE coalesce(CASE WHEN ri IS NOT NULL THEN coalesce(rf, under) END, own) END AS shown FROM st LEFT JOIN lb USING (n, p, idx)),
pr AS (SELECT sh.n, sh.p, sh.idx, avg(CASE WHEN (shown <= 48 AND yi - rad < b1) OR (abs(128 - shown) <= 48 AND yi + rad >= b1 AND yi - rad < b2) THEN 1.0::DOUBLE ELSE 0 END) AS there
  FROM (SELECT *, greatest(1, floor(thick / 200.0::DOUBLE + 0.5::DOUBLE)) + 1 AS rad FROM sh) sh JOIN dots ON dots.n = sh.n AND dots.p = sh.p AND dots.idx = sh.idx AND j % (CASE WHEN zig THEN 2 ELSE 1 END) = 0 GROUP BY ALL),
ds AS (SELECT sh.*, CASE WHEN two THEN CASE WHEN fill = 'skip' THEN 'skip' ELSE 'rect' END WHEN colour <> 255 AND (status <> 0 OR there < 0.05) THEN 'skip' ELSE 'path' END AS shape FROM sh JOIN pr USING (n, p, idx)),
bx AS (SELECT n, p, idx, shown, min(x) AS u0, max(x) AS u1, min(y) AS v0, max(y) AS v1 FROM ds JOIN pt USING (n, p, idx) WHERE shape = 'path' GROUP BY ALL),
hi AS (SELECT DISTINCT a.n, a.p, a.idx FROM bx a JOIN bx o ON a.n = o.n AND a.p = o.p AND o.idx < a.idx AND o.shown + 16 < a.shown AND a.shown < 250 AND a.u0 <= o.u1 AND o.u0 <= a.u1 AND a.v0 <= o.v1 AND o.v0 <= a.v1),
ln AS (SELECT n, p, idx, count(*) AS n_points, sum(sqrt((x - px) ** 2 + (y - py) ** 2)) AS length FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pt WINDOW w AS (PARTITION BY n, p, idx ORDER BY j)) GROUP BY ALL),
dr AS (SELECT ds.*, n_points, length, (CASE WHEN k % 7 = 0 AND k % 14 <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 21 = 0 THEN 1 ELSE 0 END)::INT AS rings,
  CASE WHEN k % 7 = 0 AND k % 14 <> 0 THEN dx * 6 ELSE 0 END + CASE WHEN k % 21 = 0 THEN 50 ELSE 0 END AS area, CASE WHEN shape = 'rect' THEN 0 WHEN pen IN (11, 5) AND hi.idx IS NOT NULL THEN 1 ELSE 2 END AS bucket
  FROM ds JOIN ln USING (n, p, idx) LEFT JOIN hi USING (n, p, idx) WHERE shape <> 'skip'),
pm AS (SELECT *, row_number() OVER (PARTITION BY n, p ORDER BY bucket, idx) AS z, CASE WHEN shape = 'rect' THEN 'rect' WHEN rings > 0 THEN 'filledPath' ELSE 'strokedPath' END AS drawn, 'rgb(' || shown || ',' || shown || ',' || shown || ')' AS paint FROM dr)"""


@query(f"WITH {RECORDS_SQL} SELECT n::VARCHAR AS note_id, p::INT AS page_no, idx::INT AS stroke_idx, pen::BIGINT AS pen, colour::BIGINT AS colour, thick::BIGINT AS thickness, kind, status::INT AS trail_status, count(*)::INT AS n_points, sum(x) AS sum_x, sum(y) AS sum_y, (CASE WHEN k % 7 = 0 THEN CASE WHEN k % 14 = 0 THEN 2 ELSE 4 END ELSE 0 END + CASE WHEN k % 21 = 0 THEN 3 ELSE 0 END)::INT AS ring_points FROM pt GROUP BY n, p, idx, k, pen, colour, thick, kind, status")
def stroke_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of stroke logs with their points in page pixels and their outlines."""
    total = lambda side: F.aggregate(F.transform("points", lambda p: p[side]), F.lit(0.0), lambda a, v: a + v)
    found = stroke_log.strokes(container.pages(_notes(spark, sf_dir)))
    return found.select("note_id", "page_no", "stroke_idx", "pen", "colour", "thickness", "kind", "trail_status", F.size("points").alias("n_points"), total("x").alias("sum_x"), total("y").alias("sum_y"), F.size(F.flatten("contour")).alias("ring_points"))


@query(f"""WITH {DRAWN_SQL}, e AS (SELECT n, p, idx, arg_min(x, j) AS first_x, arg_min(y, j) AS first_y, arg_max(x, j) AS last_x, arg_max(y, j) AS last_y FROM pt GROUP BY ALL)
SELECT n::VARCHAR AS note_id, p::INT AS page_no, z::INT AS z, drawn AS kind, paint AS colour, CASE WHEN shape = 'rect' OR two THEN fill END AS fill, n_points::INT AS n_points, rings AS n_rings, first_x, first_y, last_x, last_y,
  round(CASE WHEN area > 0 THEN (sqrt(length * length + pi() * area) - length) / (pi() / 2) ELSE thick / 100.0::DOUBLE END, 6) AS width FROM pm JOIN e USING (n, p, idx)""")
def page_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn of each page's strokes: headings, label colours, hidden strokes, highlighters, order, widths."""
    at = lambda i, side: F.element_at("points", i)[side]
    found = notebook.vector_primitives(_notes(spark, sf_dir))
    return found.select("note_id", "page_no", "z", "kind", "colour", "fill", F.size("points").alias("n_points"), F.size("rings").alias("n_rings"), at(1, "x").alias("first_x"), at(1, "y").alias("first_y"), at(-1, "x").alias("last_x"), at(-1, "y").alias("last_y"), F.round("width", 6).alias("width"))


@query(f"WITH {DRAWN_SQL} SELECT g.n::VARCHAR AS note_id, g.p::INT AS page_no, max(shape) IS NOT NULL AS use_vector FROM g LEFT JOIN dr ON dr.n = g.n AND dr.p = g.p GROUP BY g.n, g.p")
def vector_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's strokes can stand for its ink."""
    return notebook.vector_pages(_notes(spark, sf_dir)).select("note_id", "page_no", "use_vector")


INK_SQL = "k_ AS (SELECT n, p, sum(CASE drawn WHEN 'rect' THEN dx * dy WHEN 'filledPath' THEN CASE WHEN shown = 255 THEN 0 ELSE area END ELSE CASE WHEN shown = 255 THEN 0 ELSE length * (thick / 100.0::DOUBLE) END END)::DOUBLE AS ink FROM pm GROUP BY ALL)"


@query(f"WITH {DRAWN_SQL}, {INK_SQL} SELECT g.n::VARCHAR AS note_id, g.p::INT AS page_no, round(coalesce(ink, 0), 4) AS ink FROM g LEFT JOIN k_ USING (n, p)")
def ink_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much ink the strokes of a page draw."""
    return comparison.ink_areas(_notes(spark, sf_dir)).withColumn("ink", F.round("ink", 4))


@query(f"""WITH {DRAWN_SQL}, {INK_SQL}, b AS (SELECT g.n, g.p, coalesce(ink, 0) AS ink, coalesce(ink, 0) * [0.0, 1.0, 1.25, 0.5, 0.82][(g.p % 5 + 1)::INT]::DOUBLE AS other FROM g LEFT JOIN k_ USING (n, p) WHERE g.p % 7 <> 0)
SELECT n::VARCHAR AS note_id, p::INT AS page_no, CASE WHEN other <= 0 AND ink <= 0 THEN 'no ink either side' WHEN other <= 0 THEN 'the other draws nothing' ELSE ['', '1.00', '0.80', '2.00', '1.22'][(p % 5 + 1)::INT] || ' times the other''s ink' END AS said,
  CASE WHEN other <= 0 AND ink <= 0 THEN 'none' WHEN other <= 0 OR p % 5 = 3 THEN 'differs' WHEN p % 5 = 1 THEN 'match' ELSE 'near' END AS tone FROM b""")
def ink_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against another export that has a part of their ink; some pages aren't there."""
    ours = comparison.ink_areas(_notes(spark, sf_dir)).withColumn("ink", F.round("ink", 4))
    other = F.round(F.col("ink") * _pick((0.0, 1.0, 1.25, 0.5, 0.82), F.col("page_no")), 4)
    return comparison.compared(ours, ours.where(F.col("page_no") % 7 != 0).withColumn("ink", other)).select("note_id", "page_no", "said", "tone")


@query("SELECT n_name, row_number() OVER (ORDER BY CASE n_name WHEN 'NATION_7' THEN 1 WHEN 'NATION_3' THEN 2 ELSE 3 END, n_name)::INT AS place FROM nation")
def listed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a list first, in its order, then the others by name."""
    found = comparison.listed_first(table(spark, sf_dir, "nation"), "n_name", ["NATION_7", "NATION_3"])
    return found.select("n_name", F.row_number().over(W.orderBy("rank", "n_name")).alias("place"))


WORDS_SQL = "w AS (SELECT n, p, k, 'é<' || k || '&\"' AS label, k % 12 * 10 AS x, k % 14 * 10 AS y, (1 + k % 3) * 10 AS w, 10 AS h FROM r WHERE k % 4 = 0)"
NUMBER = "regexp_replace(({})::DOUBLE::VARCHAR, '[.]0$', '')"
SCALE = "(1404.0::DOUBLE * 11.9::DOUBLE / 1404.0::DOUBLE)"


@query(f"""WITH {DRAWN_SQL}, {WORDS_SQL},
d AS (SELECT n, p, idx, string_agg(CASE WHEN j = 0 THEN 'M' ELSE 'L' END || format('{{:.2f}}', x) || ',' || format('{{:.2f}}', y), ' ' ORDER BY j) AS d FROM pt GROUP BY ALL),
q AS (SELECT *, 'M' || format('{{:.2f}}', x0) || ',' || format('{{:.2f}}', y0::DOUBLE) || ' L' AS head FROM pm),
o AS (SELECT n, p, idx, concat_ws(' ', CASE WHEN k % 7 = 0 AND k % 14 <> 0 THEN head || format('{{:.2f}},{{:.2f}} L{{:.2f}},{{:.2f}} L{{:.2f}},{{:.2f}} Z', x0 + dx, y0::DOUBLE, x0 + dx, y0 + 6.0::DOUBLE, x0, y0 + 6.0::DOUBLE) END,
  CASE WHEN k % 21 = 0 THEN head || format('{{:.2f}},{{:.2f}} L{{:.2f}},{{:.2f}} Z', x0 + 10, y0::DOUBLE, x0, y0 + 10.0::DOUBLE) END) AS o FROM q),
e AS (SELECT n, p, z, CASE drawn WHEN 'rect' THEN '<rect x="' || format('{{:.2f}}', x0) || '" y="' || format('{{:.2f}}', y0::DOUBLE) || '" width="' || format('{{:.2f}}', dx::DOUBLE) || '" height="' || format('{{:.2f}}', dy::DOUBLE) || '" fill="' || CASE WHEN fill = 'hatch' THEN 'url(#hatch-rgb-' || shown || '-' || shown || '-' || shown || '-)' ELSE paint END || '"/>'
  WHEN 'filledPath' THEN '<path d="' || o || '" fill="' || paint || '"/>'
  ELSE '<path d="' || d || '" fill="none" stroke="' || paint || '" stroke-width="' || {NUMBER.format("thick / 100.0::DOUBLE")} || '" stroke-linecap="round" stroke-linejoin="round"/>' END AS e FROM pm JOIN d USING (n, p, idx) JOIN o USING (n, p, idx)),
hx AS (SELECT n, p, shown, min(z) AS z FROM pm WHERE drawn = 'rect' AND fill = 'hatch' GROUP BY ALL),
hs AS (SELECT n, p, string_agg('<pattern id="hatch-rgb-' || shown || '-' || shown || '-' || shown || '-" patternUnits="userSpaceOnUse" width="10" height="10" patternTransform="rotate(45)"><rect width="10" height="10" fill="white"/><line x1="0" y1="0" x2="0" y2="10" stroke="rgb(' || shown || ',' || shown || ',' || shown || ')" stroke-width="5"/></pattern>', '' ORDER BY z) AS h FROM hx GROUP BY ALL),
es AS (SELECT n, p, string_agg(e, '' ORDER BY z) AS es FROM e GROUP BY ALL),
ws AS (SELECT n, p, string_agg('<text x="' || {NUMBER.format(f"x * {SCALE}")} || '" y="' || {NUMBER.format(f"y * {SCALE} + h * {SCALE}")} || '" font-size="' || {NUMBER.format(f"h * {SCALE}")} || '" textLength="' || {NUMBER.format(f"w * {SCALE}")} || '" lengthAdjust="spacingAndGlyphs" fill="transparent">é&lt;' || k || '&amp;&quot;</text>', '' ORDER BY k) AS ws FROM w GROUP BY ALL)
SELECT g.n::VARCHAR AS note_id, out_no, '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" width="4.68in" height="6.24in" viewBox="0 0 1404 1872">' || coalesce('<defs>' || h || '</defs>', '') || '<image x="0" y="0" width="1404" height="1872" xlink:href="data:image/png;base64,"/>' || coalesce(es, '') || coalesce(ws, '') || '</svg>' AS svg
FROM g JOIN (SELECT unnest([1, 2, 3])::INT AS out_no, unnest([2, 1, 2]) AS p) USING (p) LEFT JOIN hs USING (n, p) LEFT JOIN es USING (n, p) LEFT JOIN ws USING (n, p)""")
def svg_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second, the first and again the second page of every notebook as SVG; images are left out here."""
    found = notebook.svg_pages(_notes(spark, sf_dir), [2, 1, 2], dpi=300, vector_ink=True)
    return found.select("note_id", "out_no", F.regexp_replace("svg", 'base64,[^"]*', "base64,").alias("svg"))


def _pdf_pages(batches):
    """What stands on each page of PDF documents."""
    for batch in batches:
        out = []
        for note, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            objects = dict(re.findall(rb"(\d+) 0 obj\n(.*?)\nendobj", data, re.S))
            content = lambda no: zlib.decompress(objects[no].split(b"stream\n", 1)[1].rsplit(b"\nendstream", 1)[0])  # noqa: E731, B023
            for no, kid in enumerate(re.findall(rb"(\d+) 0 R", re.search(rb"/Kids \[(.*?)\]", objects[b"2"])[1]), 1):
                page = objects[kid]
                ops = content(re.search(rb"/Contents (\d+) 0 R", page)[1])
                image = re.search(rb"/Im (\d+) 0 R", page)
                red = None if image is None else int(np.frombuffer(content(image[1]), np.uint8)[::3].sum(dtype=np.int64))
                said = [re.sub(rb"\\([\\()])", rb"\1", w).decode("cp1252") for w in re.findall(rb"Tm \((.*?)\) Tj", ops)]
                box = re.search(rb"/MediaBox \[0 0 (\S+ \S+)\]", page)[1].decode()
                out.append((note, no, box, red, ops.count(b" re f"), ops.count(b" h f"), ops.count(b" 1 J 1 j "), "|".join(said)))
        names = {"note_id": pa.string(), "page_no": pa.int32(), "box": pa.string(), "red": pa.int64(), "rects": pa.int64(), "filled": pa.int64(), "stroked": pa.int64(), "words": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, names.values(), strict=True)], names=list(names))


PDF_PAGES = "note_id string, page_no int, box string, red bigint, rects bigint, filled bigint, stroked bigint, words string"
PDF_SQL = f"""ws AS (SELECT n, p, string_agg(label, '|' ORDER BY k) AS words FROM w GROUP BY ALL),
es AS (SELECT n, p, count(*) FILTER (drawn = 'rect') AS rects, count(*) FILTER (drawn = 'filledPath') AS filled, count(*) FILTER (drawn = 'strokedPath') AS stroked FROM pm GROUP BY ALL)"""


@query(f"""WITH {DRAWN_SQL}, {WORDS_SQL}, {PDF_SQL}
SELECT g.n::VARCHAR AS note_id, g.p::INT AS page_no, '336.960 449.280' AS box, (1404 * CASE WHEN rects IS NOT NULL THEN 255 * 1872 ELSE 128 * (b2 - b1) + 255 * (1872 - b2) END)::BIGINT AS red,
  coalesce(rects, 0) AS rects, coalesce(filled, 0) AS filled, coalesce(stroked, 0) AS stroked, coalesce(words, '') AS words FROM g LEFT JOIN es USING (n, p) LEFT JOIN ws USING (n, p)""")
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks as PDF with vector ink, read again: images on white, shapes, searchable words."""
    return notebook.pdf_documents(_notes(spark, sf_dir), vector_ink=True).mapInArrow(_pdf_pages, PDF_PAGES)


@query(f"""WITH {RECORDS_SQL}, {WORDS_SQL}, ws AS (SELECT n, p, string_agg(label, '|' ORDER BY k) AS words FROM w GROUP BY ALL)
SELECT g.n::VARCHAR AS note_id, g.p::INT AS page_no, '336.960 449.280' AS box, NULL::BIGINT AS red, 0::BIGINT AS rects, 0::BIGINT AS filled, 0::BIGINT AS stroked, coalesce(words, '') AS words FROM g LEFT JOIN ws USING (n, p)""")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks as PDF with their words alone."""
    return notebook.pdf_documents(_notes(spark, sf_dir), text_only=True).mapInArrow(_pdf_pages, PDF_PAGES)


def _counted(batches):
    """How many pixels of pages are black, grey and clear; pixels of one page are held at a time."""

    def count(data):
        x = png.decode(data.as_py())
        full = x[..., 3] == 255
        return *(int((full & (x[..., 0] == grey)).sum()) for grey in (0, 128)), int((x[..., 3] == 0).sum())

    for batch in batches:
        found = np.array([count(x) for x in batch.column(2)], np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found.T)], names=["note_id", "page_no", "black", "grey", "clear"])


def _images(pages: DataFrame) -> DataFrame:
    ship(pages.sparkSession)
    return pages.select("note_id", "page_no", "png").mapInArrow(_counted, "note_id string, page_no int, black bigint, grey bigint, clear bigint")


@query(f"WITH {PAGES_SQL} SELECT n::VARCHAR AS note_id, p::INT AS page_no, 1404 * b1 AS black, 1404 * (b2 - b1) AS grey, 1404 * (1872 - b2) AS clear FROM g")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages drawn from their layers, as PNG files that are read again."""
    return _images(notebook.drawn_pages(_notes(spark, sf_dir, False)))


@query(f"WITH {PAGES_SQL} SELECT n::VARCHAR AS note_id, p::INT AS page_no, 351 * ((b1 + 3) // 4) AS black, 351 * ((b2 + 3) // 4 - (b1 + 3) // 4) AS grey, 351 * (468 - (b2 + 3) // 4) AS clear FROM g")
def page_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth row and column of pages, straight from their runs."""
    return _images(render.page_pngs(container.pages(_notes(spark, sf_dir, False)), scale=4))


@query(f"WITH {PAGES_SQL} SELECT n::VARCHAR AS note_id, p::INT AS page_no, 0::BIGINT AS black, 0::BIGINT AS grey, (702 * 936)::BIGINT AS clear FROM g WHERE p = 1")
def clear_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages without their ink layers, every fourth pixel enlarged to twice its size."""
    pages = notebook.picked(container.pages(_notes(spark, sf_dir, False)), [1]).withColumn("raster_ink", F.lit(False))
    return _images(render.page_pngs(pages, scale=4, upscale=2))


# Customers as pages of their nation's notebook


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without ink: headers, page data, layer lists, marks, words."""
    k, p, n = F.col("k"), F.col("p"), F.col("n")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long").alias("p"), F.col("c_custkey").alias("k"))
    text = lambda c: c.cast("string")
    header = F.when(n % 3 == 0, F.create_map(F.lit("DEVICE_DPI"), F.lit("226"))).when(n % 3 == 1, F.create_map(F.lit("APPLY_EQUIPMENT"), F.lit("N5"))).otherwise(F.create_map(F.lit("APPLY_EQUIPMENT"), F.lit("A5X")))
    page_id = F.when(p % 7 == 0, "0").when(p % 7 == 1, "none").otherwise(F.concat(F.lit("Q"), text(p % 7)))
    info = F.concat(F.lit('[{"layerId"#'), text(k % 4), F.lit(',"name"#"L'), text(k), F.lit('","isVisible"#'), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}"), F.when(k % 5 == 0, ',{"isDeleted"#true}').otherwise(""), F.lit("]"))
    said = F.create_map(F.lit("PAGEID"), page_id, F.lit("LAYERINFO"), info)
    crosswise = (n % 4 == 0) | ((n % 4 == 1) & (p == 1))
    values = F.map_concat(said, F.when(crosswise, F.create_map(F.lit("ORIENTATION"), F.when(p % 2 == 0, "1090").otherwise("1270"))).otherwise(F.create_map().cast("map<string,string>")))
    key = mark_key(p, k)

    def mark(kind, values, body):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), values.cast("map<string,string>").alias("values"), body.cast("binary").alias("body"))

    target = F.when(k % 10 == 0, "0").when(k % 10 == 1, "none").otherwise(F.concat(F.lit("Q"), text(k % 10)))
    where = F.regexp_replace(F.base64(F.concat(F.lit("/dir/n"), text(k), F.lit(".note")).cast("binary")), "\\s", "")
    style = F.when(k % 12 == 0, F.create_map()).otherwise(F.create_map(F.lit("TITLESTYLE"), F.lit("1157254")))
    found = [
        F.when(k % 8 == 0, mark("KEYWORD", F.create_map(), F.concat(F.lit(" key"), text(k), F.lit("\0 \0")))),
        F.when(k % 6 == 0, mark("TITLE", F.map_concat(F.create_map(F.lit("TITLERECT"), F.concat(text(k % 100), F.lit(",2,3,4"))), style.cast("map<string,string>")), F.repeat(F.lit("t"), (1 + k % 20).cast("int")))),
        F.when(k % 9 == 0, mark("LINKO", F.create_map(F.lit("LINKFILE"), where, F.lit("PAGEID"), target), F.lit(None))),
    ]
    cover = F.when(n % 5 == 0, F.array(F.lit(0), F.lit(10))).when(n % 5 == 1, F.array(F.lit(None).cast("int"), F.lit(7))).when(n % 5 == 2, F.array(F.lit(5), F.lit(9)))
    word = F.struct(F.concat(F.lit("w"), text(k)).alias("label"), *(c.cast("double").alias(name) for c, name in ((k % 50, "x"), (k % 70, "y"), (5 + k % 10, "w"), (F.lit(3), "h"))))
    return rows.select(text(n).alias("note_id"), p.cast("int").alias("page_no"), header.alias("header"), values.alias("values"), F.array(word).alias("words"), F.filter(F.array(*found), lambda m: m.isNotNull()).alias("marks"), cover.alias("cover"))


LEDGER_SQL = """l AS (SELECT c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p, c_custkey AS k, CASE c_nationkey % 3 WHEN 0 THEN '0' WHEN 1 THEN 'N5' ELSE 'A5X' END AS device FROM customer),
i AS (SELECT *, CASE p % 7 WHEN 0 THEN '0' WHEN 1 THEN 'none' ELSE 'Q' || p % 7 END AS id FROM l)"""


def _ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.notes(writer.notes(_ledger(spark, sf_dir)))


@query(f"""WITH {LEDGER_SQL}, s AS (SELECT n, device, string_agg(id, ',' ORDER BY p) AS ids, count(*)::INT AS pages, CASE device WHEN 'N5' THEN 1920 ELSE 1404 END AS w, CASE device WHEN 'N5' THEN 2560 ELSE 1872 END AS h FROM i GROUP BY ALL)
SELECT n::VARCHAR AS note_id, '20230015' AS version, device AS equipment, '0' AS module, CASE WHEN n % 3 = 0 THEN '226' ELSE '0' END AS dpi, pages, ids,
  (CASE WHEN n % 4 = 0 OR (n % 4 = 1 AND pages = 1) THEN h ELSE w END)::INT AS page_w, (CASE WHEN n % 4 = 0 OR (n % 4 = 1 AND pages = 1) THEN w ELSE h END)::INT AS page_h, (CASE n % 5 WHEN 1 THEN 7 WHEN 2 THEN 5 END)::INT AS cover FROM s""")
def note_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks with their sizes, pages in the order of their numbers, headers with defaults, covers."""
    value = lambda name: F.col("header")[name]
    ids = F.array_join(F.transform("pages", lambda p: p["page_id"]), ",")
    return _ledgers(spark, sf_dir).where("error IS NULL").select("note_id", "version", "equipment", value("MODULE_LABEL").alias("module"), value("DEVICE_DPI").alias("dpi"), F.size("pages").alias("pages"), ids.alias("ids"), "page_w", "page_h", F.length("cover").alias("cover"))


@query(f"""WITH {LEDGER_SQL} SELECT n::VARCHAR AS note_id, p::INT AS page_no, 0 AS ordinal, (k % 4)::INT AS layer_id, 'L' || k AS name, k % 2 = 0 AS visible, false AS deleted FROM l
UNION ALL SELECT n::VARCHAR, p::INT, 1, 0, 'Main layer', false, true FROM l WHERE k % 5 = 0""")
def layer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages say of their layers, with defaults where they are silent."""
    found = container.layer_infos(container.pages(_ledgers(spark, sf_dir)))
    return found.select("note_id", "page_no", "ordinal", "layer_id", "name", F.col("isVisible").alias("visible"), F.col("isDeleted").alias("deleted"))


@query(f"""WITH {LEDGER_SQL}, f AS (SELECT n, id, min(p) AS go FROM i WHERE id NOT IN ('0', 'none') GROUP BY ALL),
x AS (SELECT *, CASE k % 10 WHEN 0 THEN '0' WHEN 1 THEN 'none' ELSE 'Q' || k % 10 END AS goal FROM l WHERE k % 9 = 0)
SELECT 'link' AS kind, x.n::VARCHAR AS note_id, p::INT AS page_no, 'n' || k || coalesce('#Page ' || go, '') AS text, NULL::INT AS bytes FROM x LEFT JOIN f ON f.n = x.n AND f.id = x.goal
UNION ALL SELECT 'keyword', n::VARCHAR, p::INT, 'key' || k, (6 + length('' || k) + 1)::INT FROM l WHERE k % 8 = 0
UNION ALL SELECT 'title', n::VARCHAR, p::INT, k % 100 || ',2,3,4 ' || CASE WHEN k % 12 = 0 THEN '1000254' ELSE '1157254' END, (1 + k % 20)::INT FROM l WHERE k % 6 = 0""")
def note_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the first page of the id they name, keywords, titles."""
    notes = _ledgers(spark, sf_dir)
    size = F.length("bitmap").alias("bytes")
    page = page_of_key(F.col("key")).alias("page_no")
    links = container.links(notes).select(F.lit("link").alias("kind"), "note_id", page, "text", F.lit(None).cast("int").alias("bytes"))
    keywords = container.keywords(notes).select(F.lit("keyword"), "note_id", "page_no", "text", size)
    said = F.concat_ws(" ", F.col("values")["TITLERECT"], F.col("values")["TITLESTYLE"])
    return links.union(keywords).union(container.titles(notes).select(F.lit("title"), "note_id", "page_no", said, size))


@query(f"""WITH {LEDGER_SQL}, s AS (SELECT n, count(*) AS pages FROM l GROUP BY n),
z AS (SELECT l.*, CASE WHEN (n % 4 = 0 OR (n % 4 = 1 AND pages = 1)) THEN CASE device WHEN 'N5' THEN 2560.0 ELSE 1872.0 END ELSE CASE device WHEN 'N5' THEN 1920.0 ELSE 1404.0 END END::DOUBLE AS wide FROM l JOIN s USING (n)),
y AS (SELECT *, wide * 11.9::DOUBLE / CASE device WHEN 'A5X' THEN 1920.0::DOUBLE ELSE wide END AS scale FROM z)
SELECT n::VARCHAR AS note_id, p::INT AS page_no, 'w' || k AS label, round(k % 50 * scale, 6) AS x, round(k % 70 * scale, 6) AS y, round((5 + k % 10) * scale, 6) AS w, round(3 * scale, 6) AS h FROM y""")
def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognized words with their boxes in pixels: the recognition canvas follows the device."""
    pages = notebook.pages_with_titles(_ledgers(spark, sf_dir))
    rows = pages.select("note_id", "page_no", F.explode(notebook.page_words()).alias("w")).select("note_id", "page_no", "w.*")
    return rows.select("note_id", "page_no", "label", *(F.round(c, 6).alias(c) for c in "xywh"))


@query("""WITH k AS (SELECT s_suppkey AS k FROM supplier)
SELECT k::VARCHAR AS doc_id, (CASE WHEN k % 4 <> 0 THEN k % 50 END)::INT AS fmt_ver, CASE WHEN k % 3 <> 0 THEN k * 0.5::DOUBLE END AS view_x, CASE WHEN k % 3 <> 0 THEN 1.25::DOUBLE END AS view_scale,
  CASE WHEN k % 5 <> 0 THEN (100 + k)::DOUBLE END AS wide, CASE WHEN k % 2 = 0 THEN (1 + k % 7)::INT END AS thumbnail,
  CASE WHEN k % 6 = 0 THEN 'surface_2,surface_1' WHEN k % 6 = 1 THEN 'surface_1' WHEN k % 6 = 2 THEN '' ELSE 'surface_1,surface_2' END AS surfaces FROM k""")
def tile_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions, views, sizes, previews and surfaces, from the bottom up, of tile databases."""
    ship(spark)

    def make(batches):
        for batch in batches:
            made = []
            for k in batch.column(0).to_pylist():
                config = {"fmt_ver": b"none" if k % 4 == 0 else b"%dx" % (k % 50), "vp.x": b"%.1fpx" % (k * 0.5), "vp.y": b"-1e1", "surface.width": b" %d" % (100 + k), "surface.height": b"7", "thumbnail": b"t" * (1 + k % 7) if k % 2 == 0 else b""}
                config |= {"vp.scale": b"1.25"} if k % 3 else {}
                if k % 5 == 0:
                    del config["surface.height"]
                listed = {0: [(2, "surface_1"), (1, "surface_2")], 1: [(1, "surface_1"), (None, "surface_9"), (3, None)], 2: []}.get(k % 6)
                config |= {} if listed is None else {"ls": writer.proto(listed)}
                made.append(writer.tile_file(config, {"surface_1": {0: b"a"}, "surface_2": {}}))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    docs = tiles.documents(table(spark, sf_dir, "supplier").select("s_suppkey").mapInArrow(make, "path string, content binary"))
    return docs.where("error IS NULL").select("doc_id", "fmt_ver", F.col("viewport.x").alias("view_x"), F.col("viewport.scale").alias("view_scale"), F.col("canvas.width").alias("wide"), F.length("thumbnail").alias("thumbnail"), F.array_join(tiles.bottom_up(), ",").alias("surfaces"))
