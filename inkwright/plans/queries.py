"""Queries over the star-schema tables.

The tables hold no notebooks: each adapter names columns of theirs as what an operator reads
(rows of an order as the points of a stroke, events as lines of a page), so these queries
exercise the operators' semantics at any size. Every one has an independent SQL form.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkwright.functions import text as T
from inkwright.operators import geometry as G
from inkwright.operators import paragraphs as P
from inkwright.operators import render
from inkwright.operators import runs as R
from inkwright.operators import strokes as S
from inkwright.plans import notebook
from inkwright.session import ship, table
from inkwright.sources import container, png, tiles, writer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query and its SQL under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
POINTS_SQL = """p AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS idx,
  l_partkey % 400 AS x, l_suppkey * 7 % 300 AS y FROM lineitem)"""
EVENTS_SQL = """f AS (SELECT user_id AS page, event_id AS ordinal, event_type AS text, floor(epoch(ts) / 60)::BIGINT AS top,
  floor(epoch(ts) / 60)::BIGINT + floor(value * 20)::BIGINT + 1 AS bottom, event_id % 500 AS x FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an order as the points of a path."""
    idx = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), idx.alias("idx"), (F.col("l_partkey") % 400).alias("x"), (F.col("l_suppkey") * 7 % 300).alias("y"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as pieces of a page: the minute is the top, the value the height."""
    days = F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")  # free of time zones
    top = days * 1440 + F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("text"), top.alias("top"), (top + F.floor(F.col("value") * 20) + 1).alias("bottom"), (F.col("event_id") % 500).alias("x"))


# Metadata

KV_SQL = """t AS (SELECT o_custkey, string_agg('<' || o_orderstatus || '_' || o_orderpriority || ':' || CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'a:b' ELSE o_orderkey::VARCHAR END || '>', '' ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey),
k AS (SELECT o_custkey, unnest(range(len(regexp_extract_all(text, '<([^:<>]+):([^:<>]+)>', 1)))) AS pos, unnest(regexp_extract_all(text, '<([^:<>]+):([^:<>]+)>', 1)) AS key, unnest(regexp_extract_all(text, '<([^:<>]+):([^:<>]+)>', 2)) AS value FROM t)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("_", "o_orderstatus", "o_orderpriority")
    value = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, "a:b").otherwise(F.col("o_orderkey").cast("string"))
    parts = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("<"), key, F.lit(":"), value, F.lit(">")).alias("said"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(parts, lambda p: p["said"]), "").alias("text"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("o_custkey", F.posexplode(T.key_values(F.col("text"))).alias("pos", "kv")).select("o_custkey", "pos", "kv.key", "kv.value")


@query(f"WITH {KV_SQL} SELECT o_custkey, key, count(*) AS n, string_agg(value, '|' ORDER BY pos) AS vals FROM k GROUP BY o_custkey, key")
def kv_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a text collected by key, repeats in order; empty and colon values vanish."""
    values = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return _pairs(spark, sf_dir).groupBy("o_custkey", "key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(values, lambda v: v["value"]), "|").alias("vals"))


@query(f"""WITH {KV_SQL}, g AS (SELECT o_custkey, key, min(value) AS value FROM k GROUP BY o_custkey, key HAVING count(*) = 1)
SELECT o_custkey, substr(key, 1, instr(key, '_') - 1) AS grp, substr(key, instr(key, '_') + 1) AS name, value FROM g WHERE instr(key, '_') > 1 AND length(key) > instr(key, '_')""")
def kv_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys cut at their first underscore; a key that repeats is dropped entirely."""
    return _texts(spark, sf_dir).select("o_custkey", F.explode(T.nested(F.col("text"))).alias("p")).select("o_custkey", "p.*")


@query("""SELECT n_nationkey, n_nationkey % 5 AS layer_id, n_name AS name, n_nationkey % 2 = 0 AS visible FROM nation""")
def layer_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers written in the container's notation and read again."""
    said = F.format_string('[{"layerId"#%d,"name"#"%s","isVisible"#%s}]', F.col("n_nationkey") % 5, "n_name", F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false"))
    read = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(T.layers(said)).alias("m"))
    return read.select("n_nationkey", F.col("m.layerId").cast("int").alias("layer_id"), F.col("m.name").alias("name"), (F.col("m.isVisible") == "true").alias("visible"))


@query("SELECT p_partkey, (p_partkey % 10000)::INT AS page FROM part")
def page_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the first four digits of a key."""
    key = F.concat(F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lpad(F.col("p_size").cast("string"), 8, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", T.page_of_key(key).alias("page"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def label_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 misread as Latin-1 is repaired to the text it was."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.repair(broken).cast("binary")).alias("digest"))


@query("SELECT user_id::VARCHAR AS note_id, event_id::INT AS page_no, 0 AS elem_idx, 'Text' AS type, event_type AS label, 'k' || (props->>'$.k') AS word, (event_id % 90)::DOUBLE AS x FROM events")
def json_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognized elements and their words, parsed from a page's JSON."""
    k = F.get_json_object("props", "$.k")
    said = F.format_string('[{"type":"Text","label":"%s","words":[{"label":"k%s","bounding-box":{"x":%d,"y":0,"width":1,"height":1}}]}]', "event_type", k, F.col("event_id") % 90)
    pages = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("note_id"), F.col("event_id").cast("int").alias("page_no"), said.alias("elements"))
    first = F.get("words", F.lit(0))
    return container.elements(pages).select("note_id", "page_no", "elem_idx", "type", "label", first["label"].alias("word"), first["box"]["x"].alias("x"))


@query("SELECT conv_id AS page, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")
def text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("page"), F.col("turn").alias("ordinal"), "text")
    return P.joined(said, ["page"]).select("page", F.md5(F.col("text").cast("binary")).alias("digest"), "n")



@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped, (source || '.note') AS file, to_base64(encode(source)) AS encoded FROM documents")
def text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup escapes of whole texts (as digests), file names and base64."""
    path = F.concat(F.lit("/a/b/"), "source", F.lit(".note"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.xml(F.col("text")).cast("binary")).alias("escaped"), F.concat(T.file_name(path), F.lit(".note")).alias("file"), T.data_base64(F.col("source").cast("binary")).alias("encoded"))



# Recognized text

LINES_SQL = f"""{EVENTS_SQL},
g AS (SELECT *, CASE WHEN top - lag(top) OVER w < 0.5 * least(lag(bottom - top) OVER w, bottom - top) THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY page ORDER BY top, ordinal)),
h AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY top, ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS line_no FROM g),
l AS (SELECT page, line_no, string_agg(text, ' ' ORDER BY x, top, ordinal) AS text, min(x) AS x, min(top) AS top, max(bottom) AS bottom, count(*) AS fragments FROM h GROUP BY page, line_no)"""


@query(f"WITH {LINES_SQL} SELECT * FROM l")
def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.visual_lines(fragments(spark, sf_dir), ["page"])


PARAGRAPH_SQL = """a AS (SELECT *, lag(bottom) OVER w AS prev, avg(bottom - top) OVER (PARTITION BY page ORDER BY top, line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS scale FROM l WINDOW w AS (PARTITION BY page ORDER BY top, line_no)),
b AS (SELECT *, CASE WHEN prev IS NULL THEN '' WHEN top - prev > scale THEN chr(10) || chr(10) ELSE ' ' END AS lead FROM a)"""


@query(f"""WITH {LINES_SQL},
{PARAGRAPH_SQL}
SELECT page, string_agg(lead || text, '' ORDER BY top, line_no) AS text, (sum(CASE WHEN length(lead) = 2 THEN 1 ELSE 0 END) + 1)::BIGINT AS paragraphs, count(*) AS lines FROM b GROUP BY page""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments to visual lines to paragraphs, one text a page."""
    return P.paragraphs(visual_lines(spark, sf_dir), ["page"])


# Geometry

@query(f"WITH {POINTS_SQL} SELECT path, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p GROUP BY path")
def stroke_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bounds(points(spark, sf_dir), ["path"])


LENGTH_SQL = f"""{POINTS_SQL}, s AS (SELECT path, idx, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step, x * coalesce(lead(y) OVER w, first_value(y) OVER w) - coalesce(lead(x) OVER w, first_value(x) OVER w) * y AS c FROM p WINDOW w AS (PARTITION BY path ORDER BY idx)),
m AS (SELECT path, sum(step) AS length, sum(c)::BIGINT AS area2 FROM s GROUP BY path)"""


@query(f"WITH {LENGTH_SQL} SELECT path, round(length, 6) AS length FROM m")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.path_length(points(spark, sf_dir), ["path"]).select("path", F.round("length", 6).alias("length"))


@query(f"WITH {LENGTH_SQL} SELECT path, area2 FROM m")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ring_area(points(spark, sf_dir), ["path"])


@query(f"WITH {LENGTH_SQL} SELECT path, round(CASE WHEN area2 = 0 THEN 4.0 ELSE (sqrt(length * length + pi() * abs(area2) / 2) - length) / (pi() / 2) END, 6) AS width FROM m")
def render_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width of a pen from the area and length of its outline."""
    both = G.outline(points(spark, sf_dir), ["path"])
    return both.select("path", F.round(G.render_width(F.lit(400), F.abs("area2") / 2, F.col("length")), 6).alias("width"))



@query("SELECT l_orderkey, l_linenumber, round(1404 - l_partkey / (1872.0::DOUBLE * 8 / 1872.0::DOUBLE), 6) AS x, round(l_suppkey / (1872.0::DOUBLE * 8 / 1872.0::DOUBLE), 6) AS y FROM lineitem")
def to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pen coordinates turned into page pixels."""
    x, y = G.to_page(F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"), F.lit(1872.0 * 8), F.lit(1404.0), F.lit(1872.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS seen FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_suppkey, n FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, seen, l_suppkey) = 1""")
def mode_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest value, of equals the first seen."""
    seen = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return G.commonest(table(spark, sf_dir, "lineitem").withColumn("seen", seen), ["l_partkey"], "l_suppkey", "seen")


@query("""WITH s AS (SELECT c_nationkey AS page, c_custkey AS stroke_id, c_custkey % 40 AS x, c_custkey % 30 AS y, c_custkey % 3 AS w, c_custkey % 4 AS h FROM customer),
t AS (SELECT s_nationkey AS page, s_suppkey AS title_id, s_suppkey % 40 AS x, s_suppkey % 30 AS y, s_suppkey % 3 AS w, s_suppkey % 4 AS h FROM supplier)
SELECT page, stroke_id, (SELECT min(title_id) FROM t WHERE t.page = s.page AND abs(t.x - s.x) <= 2 AND abs(t.y - s.y) <= 2 AND abs(t.w - s.w) <= 2 AND abs(t.h - s.h) <= 2) AS title_id FROM s""")
def rect_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles and titles within two pixels, the first title of each."""
    sides = lambda key, p: [(F.col(key) % m).alias(p + n) for n, m in (("x", 40), ("y", 30), ("w", 3), ("h", 4))]
    strokes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("stroke_id"), *sides("c_custkey", ""))
    titles = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("title_id"), F.col("s_suppkey").alias("ordinal"), *sides("s_suppkey", "t_"))
    return G.match_rects(strokes, titles, ["page"])


@query(f"""WITH {POINTS_SQL}, r AS (SELECT i // 2 AS page, i % 2 AS rect_idx, i % 2 * 40 + i // 2 % 7 AS lo, 300 + i % 2 * 100 AS hi FROM (SELECT unnest(range(200)) AS i)),
c AS (SELECT path, rect_idx, avg(CASE WHEN x BETWEEN lo AND hi AND y BETWEEN 20 AND 280 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM p JOIN r ON path % 100 = page GROUP BY path, rect_idx)
SELECT path % 100 AS page, path AS path_id, min(rect_idx)::INT AS rect_idx FROM c WHERE share >= 0.8 GROUP BY path""")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a page's two rectangles that holds four fifths of a path's points."""
    i = F.col("id")
    rects = spark.range(200).select(F.floor(i / 2).alias("page"), (i % 2).cast("int").alias("rect_idx"), (i % 2 * 40 + F.floor(i / 2) % 7).alias("x0"), (i % 2 * 100 + 300).alias("x1"), F.lit(20).alias("y0"), F.lit(280).alias("y1"))
    p = points(spark, sf_dir).select((F.col("path") % 100).alias("page"), F.col("path").alias("path_id"), "x", "y")
    return G.contained(p, rects, ["page"]).select("page", "path_id", "rect_idx")


STROKES_SQL = """s AS (SELECT o_custkey AS page, o_orderkey AS idx, (o_orderkey * 37 % 256)::INT AS grey, o_orderkey % 90 AS x0, o_orderkey % 90 + o_orderkey % 25 AS x1, o_orderkey % 70 AS y0, o_orderkey % 70 + o_orderkey % 35 AS y1 FROM orders)"""
DARKER = "EXISTS (SELECT 1 FROM s b WHERE b.page = s.page AND b.idx < s.idx AND b.grey + 16 < s.grey AND s.grey < 250 AND s.x0 <= b.x1 AND b.x0 <= s.x1 AND s.y0 <= b.y1 AND b.y0 <= s.y1)"


def _strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), k.alias("idx"), (k * 37 % 256).cast("int").alias("grey"), (k % 90).alias("x0"), (k % 90 + k % 25).alias("x1"), (k % 70).alias("y0"), (k % 70 + k % 35).alias("y1"))


@query(f"WITH {STROKES_SQL} SELECT page, idx, grey FROM s WHERE {DARKER}")
def highlighter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes that pass over a darker, earlier one."""
    return G.highlighters(_strokes(spark, sf_dir), ["page"]).select("page", "idx", "grey")


@query(f"""WITH {STROKES_SQL}, b AS (SELECT page, idx, CASE WHEN idx % 9 = 0 THEN 0 WHEN {DARKER} THEN 1 ELSE 2 END AS bucket FROM s)
SELECT page, idx, bucket, row_number() OVER (PARTITION BY page ORDER BY bucket, idx)::INT AS z FROM b""")
def draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles, then highlighters, then ink; within each as recorded."""
    strokes = _strokes(spark, sf_dir)
    high = G.highlighters(strokes, ["page"]).select("page", "idx", F.lit(True).alias("high"))
    bucket = F.when(F.col("idx") % 9 == 0, 0).when(F.col("high"), 1).otherwise(2)
    return G.draw_order(strokes.join(high, ["page", "idx"], "left"), ["page"], bucket).select("page", "idx", "bucket", "z")


@query("SELECT o_orderkey, CASE WHEN share < 0.15 THEN 'skip' WHEN share >= 0.5 THEN 'solid' ELSE 'hatch' END AS fill, CASE WHEN share + 0.5 BETWEEN 0.9 AND 1.1 THEN 'match' WHEN share + 0.5 BETWEEN 0.75 AND 1.25 THEN 'near' ELSE 'differs' END AS label FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS share FROM orders)")
def fill_and_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = (F.col("o_orderkey") % 100) / F.lit(100.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", G.fill_kind(share).alias("fill"), G.agreement(share + 0.5).alias("label"))


# Strokes

@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [10, 16, 11, 5, 15, 4, 7][(l_partkey % 7 + 1)::INT] AS pen, [0, 48, 49, 80, 81, 255, 157][(l_suppkey % 7 + 1)::INT] AS colour,
  CASE WHEN l_partkey % 13 = 0 THEN -5 ELSE 5000 END AS record_class, ['others', '0001', '0000', 'straightLine', 'fiveStarsSignal'][(l_orderkey % 5 + 1)::INT] AS kind, [0, -2, 0, -99, -16][(l_partkey % 5 + 1)::INT] AS trail FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN kind = 'fiveStarsSignal' THEN 'unknown' ELSE CASE pen WHEN 10 THEN 'needlePoint' WHEN 16 THEN 'inkPen' WHEN 11 THEN 'marker' WHEN 5 THEN 'marker' WHEN 15 THEN 'calligraphy' ELSE 'unknown' END END AS pen_name,
  CASE colour WHEN 48 THEN 157 WHEN 49 THEN 158 WHEN 80 THEN 201 WHEN 81 THEN 202 ELSE colour END AS grey, kind = '0001' AS is_rect FROM r
WHERE kind <> '0000' AND record_class <> -5 AND pen <> 4 AND colour <> 255 AND (trail = 0 OR kind = '0001')""")
def live_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are ink and still drawn, with pen names and grey levels."""
    pick = lambda values, key, m: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % m + 1).cast("int"))
    records = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        pick([10, 16, 11, 5, 15, 4, 7], "l_partkey", 7).alias("pen"), pick([0, 48, 49, 80, 81, 255, 157], "l_suppkey", 7).alias("colour"),
        F.when(F.col("l_partkey") % 13 == 0, -5).otherwise(5000).alias("record_class"), pick(["others", "0001", "0000", "straightLine", "fiveStarsSignal"], "l_orderkey", 5).alias("kind"),
        pick([0, -2, 0, -99, -16], "l_partkey", 5).alias("trail_status"),
    )
    return S.live(S.ink(records)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pen_name", "grey", "is_rect")


# Runs and tiles

RUNS_SQL = "r AS (SELECT user_id, event_id AS idx, floor(value)::BIGINT % 40 + 1 AS len, 97 + event_id % 5 AS code FROM events), o AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("idx"), (F.floor("value") % 40 + 1).alias("len"), (F.col("event_id") % 5 + 97).alias("code"))


@query(f"WITH {RUNS_SQL} SELECT user_id, idx, len, code, start FROM o")
def run_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.offsets(_runs(spark, sf_dir), ["user_id"])


@query(f"""WITH {RUNS_SQL}, x AS (SELECT user_id, code, unnest(range(start, start + len)) AS p FROM o)
SELECT user_id, code, p % 50 // 3 AS x, p // 50 // 3 AS y FROM x WHERE p % 50 % 3 = 0 AND p // 50 % 3 = 0""")
def run_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row and column of a bitmap 50 wide, from its runs."""
    return R.sampled(R.offsets(_runs(spark, sf_dir), ["user_id"]), 50, 3).select("user_id", "code", "x", "y")


@query("""WITH RECURSIVE n AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS i, (97 + l_partkey % 2)::INT AS code,
  CASE WHEN l_suppkey % 9 = 0 THEN 255 ELSE (l_partkey * 13 % 256)::INT END AS n FROM lineitem),
f(k, i, hc, hn, runs) AS (
  SELECT DISTINCT k, 0::BIGINT, -1, -1, []::STRUCT(code INT, len BIGINT)[] FROM n
  UNION ALL
  SELECT f.k, f.i + 1,
    CASE WHEN f.hc = n.code OR n.n < 128 OR n.n = 255 THEN -1 ELSE n.code END, CASE WHEN f.hc = n.code OR n.n < 128 OR n.n = 255 THEN -1 ELSE n.n END,
    f.runs || CASE WHEN f.hc = n.code THEN [{'code': n.code, 'len': (1 + n.n + ((f.hn & 127) + 1) * 128)::BIGINT}]
      ELSE CASE WHEN f.hc >= 0 THEN [{'code': f.hc, 'len': (((f.hn & 127) + 1) * 128)::BIGINT}] ELSE [] END
        || CASE WHEN n.n = 255 THEN [{'code': n.code, 'len': 16384::BIGINT}] WHEN n.n >= 128 THEN [] ELSE [{'code': n.code, 'len': (n.n + 1)::BIGINT}] END END
  FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
g AS (SELECT *, 20000 - coalesce(list_sum(list_transform(runs, lambda r: r.len)), 0)::BIGINT AS gap FROM l),
h AS (SELECT *, coalesce(list_filter(list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda s: (((hn & 127) + 1) << s)::BIGINT), lambda s: s <= gap)[1], 0) AS tail FROM g)
SELECT k AS l_orderkey, unnest(range(len(all_runs)))::INT AS idx, unnest(all_runs).code AS code, unnest(all_runs).len AS len
FROM (SELECT k, runs || CASE WHEN hc >= 0 AND tail > 0 THEN [{'code': hc, 'len': tail}] ELSE [] END AS all_runs FROM h)""")
def rle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte pairs folded to runs: held lengths, long runs, and the tail cut to 20,000 pixels."""
    idx = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER))
    n = F.when(F.col("l_suppkey") % 9 == 0, 255).otherwise((F.col("l_partkey") * 13 % 256).cast("int"))
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", idx.alias("idx"), (F.col("l_partkey") % 2 + 97).cast("int").alias("code"), n.alias("n"))
    return R.fold(pairs, ["l_orderkey"], F.lit(20000).cast("long"))


@query("SELECT l_orderkey, l_linenumber, tid // 4096 AS col, tid % 4096 AS \"row\", min(tid // 4096) OVER (PARTITION BY l_orderkey) AS left_col, max(tid % 4096) OVER (PARTITION BY l_orderkey) AS last_row FROM (SELECT l_orderkey, l_linenumber, l_partkey % 50 * 4096 + l_suppkey AS tid FROM lineitem)")
def tile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile ids as cells, with the bounds of their document's grid."""
    col, row = R.tile_cell(F.col("l_partkey") % 50 * 4096 + F.col("l_suppkey"))
    return R.grid(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", col.alias("col"), row.alias("row")), ["l_orderkey"])


@query("""SELECT p_partkey, CASE code WHEN 97 THEN 'rgba(0,0,0,255)' WHEN 98 THEN 'rgba(0,0,0,0)' WHEN 99 THEN 'rgba(128,128,128,255)' WHEN 100 THEN 'rgba(169,169,169,255)' WHEN 101 THEN 'rgba(255,255,255,255)' ELSE 'rgba(255,255,255,0)' END AS rgba
FROM (SELECT p_partkey, 97 + p_partkey % 5 + CASE WHEN p_partkey % 11 = 0 THEN 50 ELSE 0 END AS code FROM part) WHERE code NOT IN (157, 158)""")
def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("p_partkey") % 5 + 97 + F.when(F.col("p_partkey") % 11 == 0, 50).otherwise(0)
    return table(spark, sf_dir, "part").where(~code.isin(157, 158)).select("p_partkey", F.concat(F.lit("rgba("), F.array_join(R.rgba(code).cast("array<string>"), ","), F.lit(")")).alias("rgba"))


@query("SELECT user_id, date_trunc('day', ts)::DATE::VARCHAR AS cell, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_type, event_id) = 1")
def first_layer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the layers with ink in a cell the first."""
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("cell"), "event_id", "event_type", F.struct("event_type", "event_id").alias("prio"))
    return R.topmost(rows, ["user_id", "cell"], "prio").drop("prio")


# Lookups, pages, options


@query("SELECT i AS seq, r_regionkey, r_name FROM (SELECT unnest([0, 1, 2, 3]) AS i, unnest([3, 1, 3, 0]) AS k) JOIN region ON r_regionkey = k")
def page_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by a list of numbers, whose order and repeats count."""
    pages = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("page_no"), "r_regionkey", "r_name")
    return notebook.picked(pages, [3, 1, 3, 0]).select((F.col("out_no") - 1).alias("seq"), "r_regionkey", "r_name")



@query("SELECT p_partkey, (p_partkey % 256)::INT AS background, (p_partkey % 2 * 254)::INT AS foreground, p_partkey % 256 = 0 AND p_partkey % 2 = 0 AS hatched FROM part")
def title_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("1"), F.lpad((F.col("p_partkey") % 256).cast("string"), 3, "0"), F.lpad((F.col("p_partkey") % 2 * 254).cast("string"), 3, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", T.title_style(code).alias("s")).select("p_partkey", "s.*")



@query("SELECT o_orderkey, floor((o_orderkey - 500) / 2.0::DOUBLE + 0.5)::BIGINT AS rounded, (o_orderkey * 72 / 300.0::DOUBLE)::DOUBLE AS pt FROM orders")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.js_round((k - 500) / F.lit(2.0)).alias("rounded"), T.points_of_pixels(k, F.lit(300.0)).alias("pt"))


@query("""SELECT l_suppkey, min(l_orderkey * 100 + l_linenumber) AS seen FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_suppkey""")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of the listed groups with where each was first seen."""
    listed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").join(listed, "l_orderkey", "left_semi")
    return G.first_seen(rows, "l_suppkey", F.col("l_orderkey") * 100 + F.col("l_linenumber"))


@query(f"""WITH {POINTS_SQL}, d AS (SELECT path, string_agg(CASE WHEN idx = 1 THEN 'M' ELSE 'L' END || x || '.00,' || y || '.00', ' ' ORDER BY idx) AS d FROM p GROUP BY path),
o AS (SELECT o_custkey, o_orderkey, '<path d="' || d || '" fill="none" stroke="rgb(0,0,0)" stroke-width="4" stroke-linecap="round" stroke-linejoin="round"/>' AS e FROM orders JOIN d ON path = o_orderkey)
SELECT o_custkey AS page, '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" width="400" height="300" viewBox="0 0 400 300">' || string_agg(e, '' ORDER BY o_orderkey) || '</svg>' AS svg FROM o GROUP BY o_custkey""")
def svg_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a page as one SVG text."""
    from inkwright.operators.svg import page, stroked_path

    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("page"))
    paths = stroked_path(points(spark, sf_dir), ["path"], F.lit("rgb(0,0,0)"), F.lit("4"))
    return page(paths.join(owner, "path").select("page", F.col("path").alias("z"), "element"), ["page"], 400, 300)


# Round trips through files


@query(f"""WITH e AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id % 3) AS no FROM events),
{LINES_SQL.replace("user_id AS page", "{'n': user_id, 'p': no} AS page").replace("FROM events", "FROM e")},
{PARAGRAPH_SQL},
t AS (SELECT page, string_agg(lead || text, '' ORDER BY top, line_no) AS text FROM b GROUP BY page),
s AS (SELECT {{'n': user_id, 'p': no}} AS page, sum(CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0 THEN 1 ELSE 0 END)::BIGINT AS live_strokes FROM e GROUP BY ALL)
SELECT page.n::VARCHAR AS note_id, page.p::INT AS page_no, text, live_strokes FROM t JOIN s USING (page)""")
def note_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a notebook file of up to three pages, read back: text and live strokes of each page."""
    e = F.col("event_id")
    colour, kind = F.when(e % 7 == 0, S.ERASER).otherwise(0), F.when(e % 11 == 0, S.LINK_BOX).otherwise("others")
    point = lambda off: F.struct((e % 1000 + off).cast("double").alias("x"), (e % 700).cast("double").alias("y"))
    stroke = F.struct(F.array(point(0), point(9)).alias("points"), colour.alias("colour"), kind.alias("kind"), F.when(e % 5 == 0, -2).otherwise(0).alias("status"))
    f = fragments(spark, sf_dir).withColumnRenamed("ordinal", "event_id")
    number = lambda c: F.col(c).cast("double")
    word = F.struct(F.col("text").alias("label"), number("x").alias("x"), number("top").alias("y"), F.lit(20.0).alias("w"), (number("bottom") - number("top")).alias("h"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", word.alias("word"), stroke.alias("stroke"))))
    pages = f.groupBy(F.col("page").cast("string").alias("note_id"), (e % 3).alias("page_no")).agg(rows.alias("rows"))
    pages = pages.select("note_id", "page_no", F.transform("rows", lambda r: r["word"]).alias("words"), F.transform("rows", lambda r: r["stroke"]).alias("strokes"))
    return notebook.page_summary(container.notes(writer.notes(pages)))


@query("""SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 169 ELSE 255 END AS grey, sum(CASE WHEN l_linenumber = 7 THEN 16384 ELSE 0 END + l_quantity::BIGINT * 5)::BIGINT AS pixels
FROM lineitem GROUP BY ALL""")
def bitmap_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an order as runs of a bitmap: to bytes, decoded, to a PNG and back, pixels counted by grey."""
    code = F.when(F.col("l_returnflag") == "A", 0x61).when(F.col("l_returnflag") == "N", 0x64).otherwise(0x65)
    length = F.when(F.col("l_linenumber") == 7, R.LONG).otherwise(0) + F.col("l_quantity").cast("int") * 5
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*ORDER[:3], code.alias("code"), length.alias("len")))).alias("runs"))
    ship(spark)
    return runs.select("l_orderkey", F.transform("runs", lambda r: F.struct(r["code"].alias("code"), r["len"].alias("len"))).alias("runs")).mapInArrow(_pixels, "l_orderkey bigint, grey int, pixels bigint")


def _pixels(batches):
    for batch in batches:
        out = []
        for order, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            runs = [(r["code"], r["len"]) for r in found]
            image = png.decode(png.encode(render.image(writer.bitmap(runs), sum(n for _, n in runs), 1)))
            n = np.bincount(image[..., 0].ravel(), minlength=256)
            out += [(order, int(g), int(n[g])) for g in np.flatnonzero(n)]
        if out:
            columns = zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["l_orderkey", "grey", "pixels"])


@query("""WITH t AS (SELECT DISTINCT s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS surface, s_suppkey % 8 AS c, s_suppkey // 8 % 5 AS r FROM supplier),
g AS (SELECT s_nationkey, ((max(c) - min(c) + 1) * 2)::INT AS width, ((max(r) - min(r) + 1) * 2)::INT AS height FROM t GROUP BY ALL),
p AS (SELECT s_nationkey, c, r, max(surface) AS top FROM t GROUP BY ALL)
SELECT s_nationkey::VARCHAR AS doc_id, width, height, (sum(top) * 400)::BIGINT AS total FROM p JOIN g USING (s_nationkey) GROUP BY ALL""")
def tiles_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's suppliers as tiles of two surfaces in a tile database: read, stitched, composed, measured."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("path"), F.when(k % 2 == 0, 1).otherwise(2).alias("surface"), ((k % 8) * 4096 + F.floor(k / 8) % 5).alias("tid")).distinct()
    ship(spark)

    def make(rows):
        surfaces = {f"surface_{n}": {int(t): png.encode(np.full((2, 2, 4), n * 100, np.uint8)) for t in part["tid"]} for n, part in rows.groupby("surface")}
        data = writer.tile_file({"fmt_ver": b"1", "ls": writer.proto([(2, "surface_2"), (1, "surface_1")])}, surfaces)
        return rows[["path"]].head(1).assign(content=[data])

    def measured(batches):
        for batch in batches:
            images = [png.decode(x) for x in batch.column(1).to_pylist()]
            sides = [pa.array([i.shape[a] for i in images], pa.int32()) for a in (1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides, pa.array([int(i[..., 0].sum()) for i in images], pa.int64())], names=["doc_id", "width", "height", "total"])

    docs = tiles.documents(rows.groupBy("path").applyInPandas(make, "path string, content binary"))
    return render.document_pngs(docs).mapInArrow(measured, "doc_id string, width int, height int, total bigint")


from inkwright.plans import exports as _exports  # noqa: E402, F401  registers its queries
