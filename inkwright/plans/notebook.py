"""From notebook files to tables and pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkwright.functions.text import data_base64, js_number, page_of_key, repair, title_style
from inkwright.operators import geometry, paragraphs, render, strokes, svg
from inkwright.plans import pdf
from inkwright.session import ship
from inkwright.sources import container, stroke_log

PAGE = ["note_id", "page_no"]

# How a stroke's ink is looked for on the page.
SAMPLES, HIDDEN, MARGIN, NEAR_GREY = 60, 0.05, 1, 48


def page_summary(notes: DataFrame) -> DataFrame:
    """For every page its recognized paragraphs and how many strokes are still drawn. Files are
    decoded once, and only lines of text are shuffled, by page."""
    pages = stroke_log.heads(container.pages(notes).select(*PAGE, "elements", "total_path"))
    lines = paragraphs.page_lines(F.from_json("elements", container.ELEMENTS))
    page = [*PAGE, "live_strokes"]  # the count depends on the page, so it may stand in its key
    rows = pages.select(*PAGE, strokes.live_count(F.col("heads")).cast("long").alias("live_strokes"), F.explode_outer(lines).alias("line")).select(*page, "line.*")
    text = paragraphs.paragraphs(paragraphs.visual_lines(rows, page), page)
    return text.select(*PAGE, F.nullif("text", F.lit("")).alias("text"), "live_strokes")


POINTS = "array<struct<x:double,y:double>>"
TITLE = "struct<x:int,y:int,w:int,h:int,background:int,foreground:int,hatched:boolean>"


def pages_with_titles(notes: DataFrame) -> DataFrame:
    """Pages, each with the ``titles`` (rectangle and style) that its note lists for it; no shuffle."""
    side = lambda m, i: F.get(F.split(m["values"]["TITLERECT"], ","), F.lit(i)).try_cast("int")

    def title(m):
        style = title_style(m["values"]["TITLESTYLE"])
        return F.struct(*(side(m, i) for i in range(4)), style["background"], style["foreground"], style["hatched"]).cast(TITLE)

    found = notes.where("error IS NULL").select("note_id", "page_w", "page_h", "equipment", "marks", F.explode("pages").alias("p"))
    here = F.filter("marks", lambda m: (m["kind"] == "title") & (page_of_key(m["key"]) == F.col("p.page_no")))
    return found.select("note_id", "page_w", "page_h", "equipment", F.transform(here, title).alias("titles"), "p.*")


def picked(pages: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """The pages with these numbers (from 1) in this order, repeats kept, as ``out_no``; all without
    numbers. A number that a note doesn't have gives no page."""
    if numbers is None:
        return pages.withColumn("out_no", F.col("page_no"))
    wanted = F.array(*[F.lit(int(n)) for n in numbers]).cast("array<int>")
    places = F.filter(F.transform(wanted, lambda n, i: F.when(n == F.col("page_no"), (i + 1).cast("int"))), lambda i: i.isNotNull())
    return pages.withColumn("out_no", F.explode(places))


GREY_OF = render.COLOURS[:, 0].astype(np.int16)


def ink_mask(layers: dict[str, bytes | None], w: int, h: int) -> np.ndarray | None:
    """The code of the first ink layer with any ink at each pixel; none without ink layers."""
    out = None
    for name in render.INK_LAYERS:
        if layers.get(name):
            now = render.codes(layers[name], w, h)
            out = now if out is None else np.where(render.INK[out], out, now)
    return out


def _commonest(codes: np.ndarray) -> int:
    """The most frequent grey of inked pixels; of equals the first."""
    greys, first, n = np.unique(GREY_OF[codes], return_index=True, return_counts=True)
    return int(greys[np.lexsort((first, -n))[0]])


def rect_sample(mask: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> tuple[float, int]:
    """The share of a rectangle's pixels with ink, and their commonest grey (of equals the first)."""
    h, w = mask.shape
    part = mask[max(0, int(np.floor(y0))) : min(h - 1, int(np.ceil(y1))) + 1, max(0, int(np.floor(x0))) : min(w - 1, int(np.ceil(x1))) + 1]
    inked = part[render.INK[part]]
    return (len(inked) / part.size, _commonest(inked)) if len(inked) else (0.0, 0)


def presence(mask: np.ndarray, grey: int, x: np.ndarray, y: np.ndarray, thickness: int) -> float:
    """The share of sampled points near which the page has ink of about this grey: in a square around
    each, all squares at once."""
    n = len(x)
    if not n:
        return 1.0
    h, w = mask.shape
    step, r = max(1, n // SAMPLES), max(1, int(np.floor(thickness / 200 + 0.5))) + MARGIN
    cx, cy = np.floor(x[::step] + 0.5).astype(int), np.floor(y[::step] + 0.5).astype(int)
    near, off = render.INK & (abs(GREY_OF - grey) <= NEAR_GREY), np.arange(-r, r + 1)
    px, py = cx[:, None] + off, cy[:, None] + off
    inside = ((py >= 0) & (py < h))[:, :, None] & ((px >= 0) & (px < w))[:, None, :]
    found = near[mask[np.clip(py, 0, h - 1)[:, :, None], np.clip(px, 0, w - 1)[:, None, :]]]
    return float(np.mean((found & inside).any(axis=(1, 2))))


def grey_under(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> int | None:
    """The commonest grey of the ink at the points (of equals the first); none without ink there."""
    h, w = mask.shape
    cx, cy = np.floor(x + 0.5).astype(int), np.floor(y + 0.5).astype(int)
    on = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
    at = mask[cy[on], cx[on]]
    at = at[render.INK[at]]
    return _commonest(at) if len(at) else None


SEEN = f"""array<struct<stroke_idx:int,pen:bigint,colour:bigint,thickness:bigint,record_class:int,kind:string,trail_status:int,points:{POINTS},contour:array<{POINTS}>,
fill_share:double,fill_grey:int,under_grey:int,presences:map<int,double>>>"""
_SEEN = pa.list_(
    pa.struct(
        [f for f in stroke_log.ARROW if f.name not in PAGE]
        + [pa.field("fill_share", pa.float64()), pa.field("fill_grey", pa.int32()), pa.field("under_grey", pa.int32()), pa.field("presences", pa.map_(pa.int32(), pa.float64()))]
    )
)


def _seen_strokes(w: int, h: int, layers: list[dict], log: bytes | None, titles: list[dict]) -> tuple[list[dict], bool]:
    """A page's records with what its pixels show of each, and whether it has ink layers."""
    try:
        mask = ink_mask(dict(zip(render.INK_LAYERS, (x["bitmap"] for x in layers), strict=False)), w, h)
    except ValueError:
        mask = None
    rows = []
    for k, r in stroke_log.records(log) if w > 0 and h > 0 else ():
        row = stroke_log.row("", 0, w, h, k, r) | {"fill_share": None, "fill_grey": None, "under_grey": None, "presences": []}
        if mask is not None:
            x, y = stroke_log.page_points(r, w, h)
            if r["kind"] == strokes.RECT and len(x) >= 2:
                row["fill_share"], row["fill_grey"] = rect_sample(mask, min(x[:2]), min(y[:2]), max(x[:2]), max(y[:2]))
            row["under_grey"] = grey_under(mask, x, y)
            own = strokes.GREYS.get(r["colour"], r["colour"])
            for g in {own, row["under_grey"], *(t["foreground"] for t in titles)} - {None}:
                if g < 256:  # other numbers are no grey; no ink is like them
                    row["presences"].append((g, presence(mask, g, x, y, r["thickness"])))
        rows.append(row)
    return rows, mask is not None


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            page = one.select(["page_w", "page_h", "layers", "total_path", "titles"]).to_pylist()[0]
            rows, masked = _seen_strokes(*page.values())
            kept = [k for k, n in enumerate(one.schema.names) if n not in ("total_path", "titles")]
            rest = [pa.array([page["titles"]], one.schema.field("titles").type), pa.array([rows], _SEEN), pa.array([masked])]
            yield pa.RecordBatch.from_arrays([*(one.column(k) for k in kept), *rest], names=[*(one.schema.names[k] for k in kept), "titles", "strokes", "has_mask"])


PRIMITIVE = f"struct<z:int,kind:string,colour:string,width:double,fill:string,points:{POINTS},rings:array<{POINTS}>>"
PRIMITIVES = f"array<{PRIMITIVE}>"


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row, also where ``f`` uses it for every element of an
    array: a column used there would be put in again and again."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def area(rings: Column) -> Column:
    """The area within rings, of which inner ones run the other way round."""

    def cross(r):
        follows = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
        return F.aggregate(F.zip_with(r, follows, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, c: a + c)

    return F.abs(F.aggregate(F.transform(rings, cross), F.lit(0.0), lambda a, c: a + c)) / 2


def length(points: Column) -> Column:
    """The length of an open line."""
    steps = F.zip_with(points, F.slice(points, 2, F.size(points)), lambda a, b: F.coalesce(F.hypot(b["x"] - a["x"], b["y"] - a["y"]), F.lit(0.0)))
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + s)


def _corners(s: Column) -> tuple[Column, Column, Column, Column]:
    """x, y, w, h of the rectangle between a stroke's first two points."""
    p, q = F.get(s["points"], F.lit(0)), F.get(s["points"], F.lit(1))
    return F.least(p["x"], q["x"]), F.least(p["y"], q["y"]), F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"])


def with_primitives(pages: DataFrame) -> DataFrame:
    """Pages (of ``pages_with_titles``) with ``use_vector`` and ``primitives`` in drawing order.

    A page whose ink layers can't be read draws nothing; one without strokes, or whose strokes all
    turn out hidden, keeps its pixels (``use_vector`` false). Strokes are decoded beside the pixels
    they are compared with; the rest are expressions over the array of a page's strokes, which is
    bounded by the page's stroke log. Nothing is shuffled.
    """
    ship(pages.sparkSession)
    pages = pages.withColumn("total_path", F.coalesce("total_path", F.lit(b"")))
    kept = [f for f in pages.schema.fields if f.name not in ("total_path", "titles")]
    schema = StructType([*kept, StructField("titles", pages.schema["titles"].dataType), *StructType.fromDDL(f"strokes {SEEN}, has_mask boolean")])
    out = pages.mapInArrow(_seen, schema)

    def each(column: str, f, then=lambda c: c) -> None:
        nonlocal out
        out = out.withColumn(column, then(F.transform("strokes", f)))

    masked = F.col("has_mask")
    ink = F.filter("strokes", lambda s: strokes.is_ink(s["kind"], s["record_class"], s["pen"]))
    out = out.withColumn("strokes", ink)
    each("strokes", lambda s: s.withField("two", (s["kind"] == strokes.RECT) & (F.size(s["points"]) >= 2) & (s["colour"] != strokes.ERASER)))

    def titled(s):
        same = F.filter("titles", lambda t: geometry.same_rect(list(_corners(s)), [t["x"], t["y"], t["w"], t["h"]]))
        return s.withField("title", F.when(s["two"], F.get(same, F.lit(0))))

    each("strokes", titled)
    named = lambda s: F.when(s["title"]["hatched"], "hatch").otherwise("solid")
    each("strokes", lambda s: s.withField("fill", F.when(s["two"], F.when(s["title"].isNotNull(), named(s)).otherwise(geometry.fill_kind(s["fill_share"])))))
    each("strokes", lambda s: s.withField("shape", F.when(~masked | F.coalesce(s["fill"] == "skip", F.lit(False)), "skip").when(s["two"], "rect").otherwise("path")))

    # labels on a heading take its text colour, or else the colour of the ink under them
    def box(s):
        x, y, w, h = _corners(s)
        return F.struct(F.greatest(F.lit(0.0), F.floor(x)).alias("x0"), F.greatest(F.lit(0.0), F.floor(y)).alias("y0"), F.least(F.col("page_w") - 1, F.ceil(x + w)).alias("x1"), F.least(F.col("page_h") - 1, F.ceil(y + h)).alias("y1"), s["title"]["foreground"].alias("grey"))

    rects = F.transform(F.filter("strokes", lambda s: s["shape"] == "rect"), box)

    def shown(s, rects):
        inside = lambda r: F.size(F.filter(s["points"], lambda p: geometry.within(p["x"], p["y"], r["x0"], r["y0"], r["x1"], r["y1"])))
        on = F.filter(rects, lambda r: F.try_divide(inside(r).cast("double"), F.size(s["points"])) >= geometry.INSIDE)
        label = F.when(F.size(on) > 0, F.coalesce(F.get(on, F.lit(0))["grey"], s["under_grey"]))
        own = strokes.grey_level(s["colour"])
        grey = F.when(s["two"], F.coalesce(s["title"]["background"], s["fill_grey"])).when((s["colour"] == strokes.ERASER) | (s["shape"] == "skip"), own).otherwise(F.coalesce(label, own))
        return s.withField("shown", grey)

    out = out.withColumn("strokes", _once(rects, lambda found: F.transform("strokes", lambda s: shown(s, found))))

    def kept_shape(s):
        unseen = (F.size(s["points"]) > 0) & (F.coalesce(F.try_element_at(s["presences"], s["shown"]), F.lit(0.0)) < HIDDEN)
        hidden = (s["shape"] == "path") & (s["colour"] != strokes.ERASER) & ((F.coalesce(s["trail_status"], F.lit(0)) != 0) | unseen)
        return s.withField("shape", F.when(hidden, "skip").otherwise(s["shape"]))

    each("strokes", kept_shape)
    out = out.withColumn("use_vector", (F.size("strokes") > 0) & (~masked | F.exists("strokes", lambda s: s["shape"] != "skip")))
    out = out.withColumn("strokes", F.filter("strokes", lambda s: F.col("use_vector") & (s["shape"] != "skip")))
    empty = F.array().cast(f"array<{POINTS}>")
    each("strokes", lambda s: s.withField("rings", F.filter(F.coalesce(s["contour"], empty), lambda r: F.size(r) >= 3)))
    kind = lambda s: F.when(s["shape"] == "rect", "rect").when(F.size(s["rings"]) > 0, "filledPath").when(F.size(s["points"]) > 0, "strokedPath")
    each("strokes", lambda s: s.withField("drawn", kind(s)))

    def outline(s):
        all_points = F.when(F.size(s["points"]) > 0, s["points"]).otherwise(F.flatten(s["contour"]))
        side = lambda f, agg: agg(F.transform(all_points, lambda p: p[f]))
        return F.struct(s["stroke_idx"].alias("idx"), s["shown"].alias("grey"), *(side(f, agg).alias(f"{f}{i}") for f in "xy" for i, agg in enumerate((F.array_min, F.array_max))))

    each("strokes", lambda s: s.withField("box", F.when(s["shape"] == "path", outline(s))))
    boxes = F.filter(F.transform("strokes", lambda s: s["box"]), lambda b: b.isNotNull())

    def primitive(s, boxes):
        high = (strokes.pen_name(s["pen"], s["kind"]) == "marker") & F.exists(boxes, lambda b: geometry.washes_over(s["box"], b))
        bucket = F.when(s["drawn"] == "rect", 0).when(high, 1).otherwise(2)
        paint = F.format_string("rgb(%d,%d,%d)", s["shown"], s["shown"], s["shown"])
        width = geometry.render_width(s["thickness"], area(s["rings"]), length(s["points"]))
        return F.struct(bucket.alias("bucket"), s["stroke_idx"].alias("idx"), F.struct(F.lit(0).alias("z"), s["drawn"].alias("kind"), paint.alias("colour"), width.alias("width"), s["fill"].alias("fill"), s["points"].alias("points"), s["rings"].alias("rings")).alias("it"))

    visible = _once(boxes, lambda found: F.transform(F.filter("strokes", lambda s: s["drawn"].isNotNull()), lambda s: primitive(s, found)))
    ordered = F.array_sort(visible)  # by bucket, then by place in the log
    out = out.withColumn("primitives", F.transform(ordered, lambda v, i: v["it"].withField("z", i + 1)).cast(PRIMITIVES))
    return out.drop("strokes", "titles", "has_mask")


def vector_pages(notes: DataFrame) -> DataFrame:
    """(note_id, page_no, use_vector, primitives in drawing order) of every page."""
    return with_primitives(pages_with_titles(notes).select(*PAGE, "page_w", "page_h", "layers", "total_path", "titles")).select(*PAGE, "use_vector", "primitives")


def vector_primitives(notes: DataFrame) -> DataFrame:
    """What is drawn of each page's strokes, in drawing order: (note_id, page_no, z, kind, colour, width, fill, points, rings)."""
    return vector_pages(notes).select(*PAGE, F.explode("primitives").alias("it")).select(*PAGE, "it.*")


WORDS = "array<struct<label:string,x:double,y:double,w:double,h:double>>"


def page_words(upscale: float = 1) -> Column:
    """The recognized words of a page with their boxes in pixels of the drawn page."""
    canvas = F.when(F.col("equipment").isNull() | F.col("equipment").isin("", "A5X"), 1920.0).otherwise(F.col("page_w"))
    scale = F.rint(F.col("page_w") * F.lit(float(upscale))) * F.lit(11.9) / canvas
    found = F.filter(F.from_json("elements", container.ELEMENTS), lambda e: e["type"] == "Text")
    words = F.flatten(F.transform(found, lambda e: F.coalesce(e["words"], F.array().cast(container.WORDS))))

    def word(w):
        box = w["bounding-box"]
        return F.struct(F.coalesce(repair(w["label"]), w["label"]).alias("label"), *((box[f] * scale).alias(n) for f, n in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))))

    boxed = F.filter(words, lambda w: w["bounding-box"].isNotNull() & (w["label"] != ""))
    return F.coalesce(F.transform(boxed, word), F.array().cast(WORDS))


def _scaled(primitives: Column, upscale: float) -> Column:
    if upscale == 1:
        return primitives
    k = F.lit(float(upscale))
    grown = lambda points: F.transform(points, lambda p: F.struct((p["x"] * k).alias("x"), (p["y"] * k).alias("y")))
    return F.transform(primitives, lambda p: p.withField("width", p["width"] * k).withField("points", grown(p["points"])).withField("rings", F.transform(p["rings"], grown)))


def drawn_pages(notes: DataFrame, numbers: list[int] | None = None, upscale: float = 1, vector_ink: bool = False, images: bool = True) -> DataFrame:
    """The pages an export needs: (note_id, page_no, out_no, w, h, png, error, words, primitives).

    With ``vector_ink`` the pages whose strokes can stand for their ink lose it from the image."""
    pages = picked(pages_with_titles(notes), numbers).select(*PAGE, "out_no", "page_w", "page_h", "equipment", "style", "layer_seq", "layers", "elements", "total_path", "titles")
    if vector_ink:
        pages = with_primitives(pages).withColumn("raster_ink", ~F.col("use_vector"))
    else:
        pages = pages.withColumns({"raster_ink": F.lit(True), "primitives": F.array().cast(PRIMITIVES)})
    size = [F.rint(F.col(c) * F.lit(float(upscale))).cast("int").alias(n) for c, n in (("page_w", "w"), ("page_h", "h"))]
    pages = pages.select(*PAGE, "out_no", "page_w", "page_h", *size, "style", "layer_seq", "layers", "raster_ink", page_words(upscale).alias("words"), _scaled(F.col("primitives"), upscale).alias("primitives"))
    if not images:
        return pages.select(*PAGE, "out_no", "w", "h", F.lit(None).cast("binary").alias("png"), F.lit(None).cast("string").alias("error"), "words", "primitives")
    return render.page_pngs(pages, upscale=upscale).select(*PAGE, "out_no", "w", "h", "png", "error", "words", "primitives")


def svg_pages(notes: DataFrame, numbers: list[int] | None = None, dpi: float | None = None, include_text: bool = True, upscale: float = 1, vector_ink: bool = False) -> DataFrame:
    """(note_id, page_no, out_no, svg): the page's image, its strokes in drawing order, invisible words.

    A page that can't be drawn has no image. ``dpi`` gives sizes in inches, the same at any upscale."""
    pages = drawn_pages(notes, numbers, upscale, vector_ink)
    hatched = F.array_distinct(F.transform(F.filter("primitives", lambda p: (p["kind"] == "rect") & (p["fill"] == "hatch")), lambda p: p["colour"]))
    defs = F.when(F.size(hatched) > 0, F.concat(F.lit("<defs>"), F.array_join(F.transform(hatched, svg.hatch), ""), F.lit("</defs>"))).otherwise("")
    w, h = js_number(F.col("w")), js_number(F.col("h"))
    size = (lambda c: F.concat(js_number(F.col(c) / F.lit(float(dpi) * upscale)), F.lit("in"))) if dpi else (lambda c: js_number(F.col(c)))
    image = F.concat(F.lit('<image x="0" y="0" width="'), w, F.lit('" height="'), h, F.lit('" xlink:href="data:image/png;base64,'), data_base64(F.col("png")), F.lit('"/>'))
    words = F.array_join(F.transform("words", lambda v: svg.word(v["label"], v["x"], v["y"], v["w"], v["h"])), "") if include_text else F.lit("")
    strokes_ = F.array_join(F.transform("primitives", svg.primitive), "")
    head = [F.lit(svg.HEAD + 'width="'), size("w"), F.lit('" height="'), size("h"), F.lit('" viewBox="0 0 '), w, F.lit(" "), h, F.lit('">')]
    return pages.select(*PAGE, "out_no", F.concat(*head, defs, F.coalesce(image, F.lit("")), strokes_, words, F.lit("</svg>")).alias("svg"))


def pdf_documents(notes: DataFrame, numbers: list[int] | None = None, dpi: float = 300, upscale: float = 1, vector_ink: bool = False, text_only: bool = False) -> DataFrame:
    """(note_id, pdf): a searchable document a note; ``text_only`` writes the words alone."""
    pages = drawn_pages(notes, numbers, upscale, vector_ink and not text_only, images=not text_only)
    return pdf.documents(pages.select("note_id", F.col("out_no").alias("page_no"), F.col("w").alias("page_w"), F.col("h").alias("page_h"), "png", "words", "primitives"), dpi)
