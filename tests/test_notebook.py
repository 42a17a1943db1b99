import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwright.operators import geometry, paragraphs, render, runs, strokes, svg
from inkwright.plans import notebook, pdf
from inkwright.sources import container, png, stroke_log, tiles
from inkwright.sources.writer import Note, bitmap, blank, log, proto, rle, stroke, tile_file, word
from inkwright.streaming import frames

W, H = 1404, 1872


def files(spark, **named):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "path string, content binary")


def sample():
    note = Note()
    note.header(APPLY_EQUIPMENT="A5X")
    box = lambda label, y, h=10, x=0: word(label, x, y, 20, h)
    text = [{"type": "Text", "label": "größe zwei".encode().decode("latin-1"), "words": [box("größe", 0), box("zwei", 1, x=30)]}, {"type": "Text", "label": "drei", "words": [box("drei", 100)]}, {"type": "Image", "label": "no", "words": []}]
    ink = [stroke([(10, 10), (200, 10)]), stroke([(10, 50), (90, 50)], status=-2), stroke([(0, 0)], colour=255), stroke([(0, 0)], kind="0000"), stroke([(0, 0)], record_class=-5), stroke([(1, 1), (4, 4)], pen=4)]
    note.page(1, text, ink, {"MAINLAYER": blank(W, H, 0x61), "BGLAYER": blank(W, H)}, PAGEID="P1")
    for n in range(2, 12):
        note.page(n, PAGEID=f"P{n}")
    return note


def test_page_summary(spark):
    rows = notebook.page_summary(container.notes(files(spark, a=sample().bytes()))).orderBy("page_no").collect()
    assert [r["page_no"] for r in rows] == list(range(1, 12))
    assert rows[0]["text"] == "größe zwei\n\ndrei" and rows[0]["live_strokes"] == 1
    assert rows[5]["text"] is None and rows[5]["live_strokes"] == 0


def test_broken_files_become_error_rows(spark):
    lost = Note()
    lost.page(1, drop=("LAYERSEQ",))
    found = {r["note_id"]: r["error"] for r in container.notes(files(spark, good=sample().bytes(), bad=b"nope", short=b"noteSN_FILE_VER_20230015", lost=lost.bytes(), none=b"")).collect()}
    assert found["good"] is None and all(found[k] for k in ("bad", "short", "lost", "none"))


def test_sizes_marks_and_repeats():
    note = Note()
    note.header(APPLY_EQUIPMENT="N5")
    note.page(1, ORIENTATION="1090", PAGEID="A")
    note.footer += [("TITLE_000100100020", note.kv([("TITLERECT", "1,2,3,4"), ("TITLEBITMAP", note.block(b"picture"))]))] * 2
    note.footer.append(("PAGE7", 1))
    note.footer.append(("PAGE7", 2))
    got = container.decode(note.bytes())
    assert (got["page_w"], got["page_h"]) == (2560, 1920)
    assert [m["seq"] for m in got["marks"]] == [0, 1] and got["marks"][1]["bitmap"] == b"picture" and dict(got["marks"][0]["values"])["TITLESTYLE"] == "1000254"
    assert [p["page_no"] for p in got["pages"]] == [1]  # a repeated page key is dropped


def test_keywords_and_titles(spark):
    note = Note()
    note.header()
    note.page(1)
    note.footer.append(("KEYWORD_00010200", note.kv([("KEYWORDSITE", note.block(b" alpha\0\0 "))])))
    note.footer.append(("TITLE_000100100020", note.kv([("TITLERECT", "1,2,3,4")])))
    found = container.notes(files(spark, a=note.bytes(), b=b"junk"))
    (word_,) = container.keywords(found).collect()
    assert (word_["page_no"], word_["text"], bytes(word_["bitmap"])) == (1, "alpha", b" alpha\0\0 ")
    (title,) = container.titles(found).collect()
    assert title["page_no"] == 1 and title["values"]["TITLESTYLE"] == "1000254" and title["bitmap"] is None


def test_links_name_their_page(spark):
    import base64

    note = Note()
    note.header()
    note.page(1, PAGEID="X")
    note.page(2, PAGEID="Y")
    where = base64.b64encode(b"/dir/other.note").decode()
    note.footer.append(("LINKO_0001", note.kv([("LINKFILE", where), ("PAGEID", "Y")])))
    note.footer.append(("LINKO_0002", note.kv([("LINKFILE", where), ("PAGEID", "none")])))
    rows = container.links(container.notes(files(spark, a=note.bytes()))).orderBy("key").collect()
    assert [r["text"] for r in rows] == ["other#Page 2", "other"]


def test_stroke_log_edges():
    one = stroke([(1, 2), (3, 4)], rings=[[(0, 0), (1, 0), (1, 1)]])
    assert list(stroke_log.records(None)) == [] and list(stroke_log.records(b"x" * 100)) == []
    assert [k for k, _ in stroke_log.records(log([one, one]))] == [0, 1]
    assert len(list(stroke_log.records(log([one, one])[:-3]))) == 1  # cut record
    assert len(list(stroke_log.records(log([one, stroke([(1, 1)], screen=0), one])))) == 2
    assert list(stroke_log.records(log([one], count=2_000_000))) == []
    (_, r), = stroke_log.records(log([one]))
    assert r["raw_x"].tolist() == [1, 3] and r["raw_y"].tolist() == [2, 4] and len(r["rings"]) == 1
    (_, r), = stroke_log.records(log([stroke([(1, 2)], rings=[[(0, 0)]], ring_count=2000)]))
    assert r["rings"] is None and len(r["raw_x"]) == 1


def random_pairs(rng, n):
    return [(int(rng.choice([0x61, 0x62, 0x65])), int(rng.choice([3, 127, 128, 200, 254, 255]))) for _ in range(n)]


def test_fold_agrees_with_decoder(spark):
    rng = np.random.RandomState(0)
    cases = [random_pairs(rng, 12) for _ in range(40)]
    rows = [(k, i, c, n) for k, x in enumerate(cases) for i, (c, n) in enumerate(x)]
    got = runs.fold(spark.createDataFrame(rows, "k int, idx int, code int, n int"), ["k"], F.lit(60000).cast("long")).orderBy("k", "idx").collect()
    for k, x in enumerate(cases):
        want = slow_runs(x, 60000)
        assert [(r["code"], r["len"]) for r in got if r["k"] == k] == want == list(zip(*(c.tolist() for c in render.runs_of(rle(x), 60000)), strict=True))


def slow_runs(pairs, pixels):
    """Pair by pair, with one held back."""
    out, held = [], None
    for code, n in pairs:
        if held and held[0] == code:
            out.append((code, 1 + n + (((held[1] & 127) + 1) << 7)))
            held = None
            continue
        if held:
            out.append((held[0], ((held[1] & 127) + 1) << 7))
            held = None
        if n == 255:
            out.append((code, 0x4000))
        elif n >= 128:
            held = code, n
        else:
            out.append((code, n + 1))
    if held:
        gap = pixels - sum(n for _, n in out)
        out += [(held[0], s) for s in [((held[1] & 127) + 1) << i for i in range(7, -1, -1)] if s <= gap][:1]
    return out


def test_small_image_and_scale(spark):
    data = rle([(0x61, 1), (0x65, 1)] * 2 + [(0x65, 1), (0x61, 1)] * 2)
    full = render.codes(data, 4, 4)
    assert (render.codes(data, 4, 4, 2) == full[::2, ::2]).all() and render.codes(data, 4, 4, 2).tolist() == [[0x61, 0x65], [0x65, 0x61]]
    r = [("a", i, n, c) for i, (c, n) in enumerate(zip(*(c.tolist() for c in render.runs_of(data, 16)), strict=True))]
    found = runs.sampled(runs.offsets(spark.createDataFrame(r, "b string, idx int, len long, code int"), ["b"]), 4, 2).collect()
    assert {(x["x"], x["y"]): x["code"] for x in found} == {(x, y): int(full[2 * y, 2 * x]) for x in range(2) for y in range(2)}
    with pytest.raises(ValueError):
        render.codes(data[:-2], 4, 4)
    for bad in (0, 1.5, -1):
        with pytest.raises(ValueError):
            render.page_image({}, [], "0", 4, 4, bad)


def test_pixels():
    px = np.array([[[0, 0, 0, 0], [255, 0, 0, 255], [0, 0, 0, 128]]], np.uint8)
    flat = render.on_white(px)
    assert flat[0, 0].tolist() == [255] * 4 and flat[0, 1].tolist() == [255, 0, 0, 255] and 100 < flat[0, 2, 0] < 155
    rng = np.random.RandomState(1)
    x = rng.randint(0, 256, (5, 7, 4), dtype=np.uint8)
    assert (png.decode(png.encode(x)) == x).all()
    assert render.enlarged(x, 2).shape == (10, 14, 4) and (render.enlarged(x, 1) == np.where(x[..., 3:] > 0, x, np.array([0, 0, 0, 0], np.uint8)))[..., 3].all()
    with pytest.raises(ValueError):
        render.enlarged(x, float("nan"))
    clear = np.array([[[255, 255, 255, 0]]], np.uint8)
    assert (render.over(clear, px[:, :1]) == clear).all()  # an unknown colour covers with transparency


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.RandomState(kind)
    px = rng.randint(0, 256, (4, 5, 3), dtype=np.uint8).astype(int)
    rows, before = [], np.zeros(15, int)
    for y in range(4):
        now = px[y].ravel()
        left, corner = np.concatenate([[0] * 3, now[:-3]]), np.concatenate([[0] * 3, before[:-3]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0, left, before, (left + before) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((now - guess) & 255).astype(np.uint8).tobytes())
        before = now
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + bytes(4)
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (png.decode(data)[..., :3] == px).all()


def chunked(w, h, bits, kind, rows, *more):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + bytes(4)
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0)) + b"".join(chunk(n, d) for n, d in more) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_depths():
    grey = png.decode(chunked(3, 1, 2, 0, bytes([0, 0b00011100]), (b"tRNS", b"\0\1")))
    assert grey[0].tolist() == [[0, 0, 0, 255], [85, 85, 85, 0], [255, 255, 255, 255]]
    named = png.decode(chunked(3, 1, 4, 3, bytes([0, 0x01, 0x10]), (b"PLTE", bytes([1, 2, 3, 4, 5, 6])), (b"tRNS", b"\x07")))
    assert named[0].tolist() == [[1, 2, 3, 7], [4, 5, 6, 255], [4, 5, 6, 255]]
    deep = png.decode(chunked(1, 1, 16, 2, bytes([0, 9, 1, 8, 2, 7, 3])))
    assert deep[0].tolist() == [[9, 8, 7, 255]]
    good = png.encode(np.zeros((2, 2, 4), np.uint8))
    for bad in (b"", good[:30], good[:50], chunked(1, 1, 8, 3, b"\0\0"), chunked(1, 1, 8, 9, b"\0\0")):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_tiles(spark):
    tile = lambda v: png.encode(np.full((2, 2, 4), v, np.uint8))
    data = tile_file({"fmt_ver": b"3", "ls": proto([(1, "surface_2"), (None, "surface_1"), (3, None)])}, {"surface_1": {4096 + 1: tile(10)}, "surface_2": {4096 * 2 + 1: tile(20)}, "surface_9": {0: tile(30)}, "other": {}})
    docs = tiles.documents(files(spark, a=data, b=b"junk"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert rows["b"]["error"] and rows["a"]["fmt_ver"] == 3 and len(rows["a"]["tiles"]) == 3
    assert [(r["surface"]) for r in tiles.order(docs).orderBy("z").collect()] == ["surface_1", "surface_2"]
    (row,) = render.document_pngs(docs).collect()
    got = png.decode(row["png"])
    (one,) = render.document_pngs(docs, ["surface_1", "nowhere"]).collect()
    assert png.decode(one["png"])[2, 2, 0] == 10 and png.decode(one["png"])[2, 4, 0] == 0
    (none,) = render.document_pngs(docs, []).collect()
    assert none["png"] is None and none["error"] is None
    broken = tiles.documents(files(spark, c=tile_file({}, {"surface_1": {5: tile(1)[:40]}}), d=tile_file({}, {"surface_1": {}})))
    assert {r["doc_id"]: (r["png"], bool(r["error"])) for r in render.document_pngs(broken).collect()} == {"c": (None, True), "d": (None, False)}
    assert got.shape == (4, 6, 4) and got[2, 2, 0] == 10 and got[2, 4, 0] == 20 and got[0, 0, 0] == 0


def test_paragraph_example(spark):
    lines = [("p", 1, 0, 10, "alpha bravo charlie"), ("p", 2, 15, 25, "delta echo"), ("p", 3, 30, 40, "foxtrot"), ("p", 4, 45, 55, "golf hotel"), ("p", 5, 80, 90, "india")]
    (row,) = paragraphs.paragraphs(spark.createDataFrame(lines, "page string, line_no int, top int, bottom int, text string"), ["page"]).collect()
    assert row["text"] == "alpha bravo charlie delta echo foxtrot golf hotel\n\nindia"
    # a gap of exactly one height is no break; tops exactly half a height apart are two lines
    (row,) = paragraphs.paragraphs(spark.createDataFrame([("p", 1, 0, 10, "a"), ("p", 2, 20, 30, "b")], "page string, line_no int, top int, bottom int, text string"), ["page"]).collect()
    assert row["text"] == "a b"
    pieces = spark.createDataFrame([("p", 1, 5, 0, 10, "b"), ("p", 2, 0, 4, 14, "a"), ("p", 3, 0, 9, 19, "c")], "page string, ordinal int, x int, top int, bottom int, text string")
    assert [r["text"] for r in paragraphs.visual_lines(pieces, ["page"]).orderBy("line_no").collect()] == ["a b", "c"]


CLEAR = 0x62


def painted(boxes):
    """A page's bitmap with boxes (x0, y0, x1, y1, code), edges included."""
    px = np.full((H, W), CLEAR, np.uint8)
    for x0, y0, x1, y1, code in boxes:
        px[y0 : y1 + 1, x0 : x1 + 1] = code
    flat = px.ravel()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(flat)) + 1, [len(flat)]])
    return bitmap([(int(flat[a]), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def drawn_note():
    """Page 1: headings, marker, hidden and erased strokes; 2: ink without strokes; 3: strokes
    without ink layers; 4: strokes that the page doesn't show."""
    note = Note()
    note.header(APPLY_EQUIPMENT="A5X")
    x = lambda v: W - v  # noqa: E731  x runs from the right edge
    ink = [
        stroke([(x(10), 10), (x(100), 10)], colour=0),
        stroke([(x(5), 5), (x(120), 20)], pen=11, colour=201),
        stroke([(x(310), 310), (x(330), 320)], colour=0),  # a heading's label: takes its text colour
        stroke([(x(300), 300), (x(340), 330)], kind="0001"),
        stroke([(x(700), 700), (x(800), 700)], colour=157, status=-3),
        stroke([], rings=[[(0, 0), (10, 0), (10, 10)]], colour=0),
        stroke([(x(50), 900), (x(60), 900)], colour=255),
        stroke([(x(400), 1200), (x(500), 1200)], colour=0),  # nothing of it is on the page
        stroke([(x(600), 600), (x(640), 640)], kind="0001"),  # no title, a quarter inked
        stroke([(x(610), 605), (x(630), 605)], colour=0),  # in it: takes the colour of the ink there
        stroke([(x(600), 1600), (x(640), 1640)], kind="0001"),  # no title, no ink
    ]
    text = [{"type": "Text", "label": "a<b", "words": [word("a<b", 1, 1, 2, 2)]}]
    main = painted([(8, 8, 102, 12, 0x61), (60, 10, 120, 22, 0x64), (305, 305, 335, 325, 0x65), (600, 600, 640, 610, 0x63)])
    note.page(1, text, ink, {"MAINLAYER": main, "BGLAYER": blank(W, H)})
    note.page(2, text, None, {"MAINLAYER": main, "BGLAYER": blank(W, H)})
    note.page(3, None, [stroke([(x(10), 10), (x(100), 10)])], {"BGLAYER": blank(W, H)})
    note.page(4, None, [stroke([(x(10), 1510), (x(100), 1510)])], {"MAINLAYER": main, "BGLAYER": blank(W, H)})
    note.footer.append(("TITLE_000103000300", note.kv([("TITLERECT", "301,300,40,31"), ("TITLESTYLE", "1157254")])))
    return note.bytes()


@pytest.fixture(scope="module")
def drawn(spark):
    return container.notes(files(spark, a=drawn_note()))


def test_lines_of_elements(spark):
    mark = {"label": "\n"}
    two = [word("a", 1, 5, 9, 10), word("b", 20, 4, 9, 10), mark, word("c", 3, 30, 9, 10)]
    text = [
        {"type": "Text", "label": "a b\nc", "words": two},
        {"type": "Text", "label": "a b c\n", "words": two[:2]},  # two parts, no mark: one line
        {"type": "Text", "label": "a\n", "words": [two[0], mark]},  # the second line has nothing
        {"type": "Image", "label": "x", "words": two},
        {"type": "Text", "label": "none"},
        {"type": "Text", "words": two},
    ]
    import json

    found = spark.createDataFrame([(json.dumps(text),), ("[]",), (None,)], "elements string").select(paragraphs.page_lines(F.from_json("elements", container.ELEMENTS)).alias("x")).collect()
    got = [tuple(r) for r in found[0]["x"]]
    assert got == [(0, "a b", 1, 4, 15), (1, "c", 3, 30, 40), (100000, "a b c", 1, 4, 15), (200000, "a", 1, 5, 15)]
    assert found[1]["x"] == [] and found[2]["x"] is None


def test_vector_primitives(drawn):
    rows = notebook.vector_primitives(drawn).where("page_no = 1").orderBy("z").collect()
    assert [(r["kind"], r["colour"], r["fill"]) for r in rows] == [
        ("rect", "rgb(157,157,157)", "solid"),
        ("rect", "rgb(128,128,128)", "hatch"),
        ("strokedPath", "rgb(201,201,201)", None),  # the marker lies under the ink
        ("strokedPath", "rgb(0,0,0)", None),
        ("strokedPath", "rgb(254,254,254)", None),
        ("filledPath", "rgb(0,0,0)", None),
        ("strokedPath", "rgb(255,255,255)", None),
        ("strokedPath", "rgb(128,128,128)", None),
    ]
    assert [r["z"] for r in rows] == list(range(1, 9)) and rows[3]["width"] == 4


def test_pages_that_keep_their_pixels(drawn):
    rows = {r["page_no"]: r for r in notebook.vector_pages(drawn).collect()}
    assert {k: (r["use_vector"], len(r["primitives"])) for k, r in rows.items()} == {1: (True, 8), 2: (False, 0), 3: (True, 0), 4: (False, 0)}
    pages = {r["page_no"]: r for r in notebook.drawn_pages(drawn, vector_ink=True).collect()}
    inked = {k: bool((png.decode(r["png"])[..., 3] > 0).any()) for k, r in pages.items()}
    assert inked == {1: False, 2: True, 3: False, 4: True}
    assert all((png.decode(r["png"])[..., 3] > 0).any() == (r["page_no"] != 3) for r in notebook.drawn_pages(drawn).collect())


def test_svg(drawn):
    import xml.dom.minidom

    rows = notebook.svg_pages(drawn, [2, 1, 2, 9], vector_ink=True).orderBy("out_no").collect()
    assert [(r["out_no"], r["page_no"]) for r in rows] == [(1, 2), (2, 1), (3, 2)]
    page = rows[1]["svg"]
    assert page.startswith("<svg ") and "a&lt;b" in page and page.count("<path") == 6 and page.count("<pattern") == 1
    assert f'viewBox="0 0 {W} {H}"' in page and "M10.00,10.00 L100.00,10.00" in page and 'stroke-width="4"' in page
    xml.dom.minidom.parseString(page)
    (plain,) = notebook.svg_pages(drawn, [1], dpi=100, include_text=False).collect()
    assert "<path" not in plain["svg"] and "<text" not in plain["svg"] and 'width="14.04in"' in plain["svg"]
    (large,) = notebook.svg_pages(drawn, [1], dpi=100, upscale=1.5, vector_ink=True).collect()
    assert 'width="14.04in"' in large["svg"] and 'viewBox="0 0 2106 2808"' in large["svg"] and "M15.00,15.00 L150.00,15.00" in large["svg"] and 'stroke-width="6"' in large["svg"]


def streams(data):
    return [zlib.decompress(s) for s in re.findall(rb"stream\n(.*?)\nendstream", bytes(data), re.S)]


def test_pdf_documents(drawn):
    (row,) = notebook.pdf_documents(drawn, [1, 2], vector_ink=True).collect()
    first = [s for s in streams(row["pdf"]) if b"BT 3 Tr" in s][0]
    assert b"/Im Do" in first and b"(a<b) Tj" in first and first.count(b" re f") == 2 and b"10.00 10.00 m 100.00 10.00 l S" in first
    (row,) = notebook.pdf_documents(drawn, text_only=True).collect()
    assert b"/Im" not in row["pdf"] and bytes(row["pdf"]).count(b"/Type /Page ") == 4 and len(row["pdf"]) < 4000


def test_hatch_stays_in_its_rectangle():
    ops = b" ".join(pdf.hatch_ops(10, 20, 50, 30, b"0 0 0"))
    ends = [tuple(map(float, m)) for m in re.findall(rb"(\S+) (\S+) m (\S+) (\S+) l S", ops)]
    assert len(ends) >= 5 and all(10 <= min(x0, x1) and max(x0, x1) <= 60 and 20 <= y0 < y1 <= 50 and abs((x1 - x0) - (y1 - y0)) < 0.02 for x0, y0, x1, y1 in ends)
    assert pdf.advance("Ab é") == 667 + 556 + 278 + 556


def test_page_options(drawn):
    pages = container.pages(drawn)
    for bad in ({"scale": 0}, {"scale": 1.5}, {"upscale": 0.5}, {"upscale": float("nan")}):
        with pytest.raises(ValueError):
            render.page_pngs(pages, **bad)
    (small,) = render.page_pngs(pages.where("page_no = 2"), scale=10).collect()
    assert png.decode(small["png"]).shape == (188, 141, 4) and small["error"] is None
    assert render.resized(np.arange(24, dtype=np.uint8).reshape(2, 3, 4), 7, 5, 2).shape == (3, 4, 4)


def test_presence_and_samples():
    mask = np.full((50, 50), CLEAR, np.uint8)
    mask[10, 5:40] = 0x61
    line = np.arange(5, 40).astype(float)
    seen = lambda grey, y, x=line: notebook.presence(mask, grey, x, np.full(len(x), y), 400)
    assert seen(0, 10.0) == 1 and seen(0, 40.0) == 0 and seen(0, 13.0) == 1 and seen(0, 14.0) == 0 and seen(48, 10.0) == 1 and seen(49, 10.0) == 0
    assert seen(201, 10.0) == 0 and seen(0, 10.0, line[:0]) == 1 and seen(0, -2.0) == 0 and seen(0, 10.0, line - 30) == pytest.approx(np.mean(line - 30 + 3 >= 5))
    assert notebook.grey_under(mask, line, np.full(35, 10.0)) == 0 and notebook.grey_under(mask, line - 99, np.full(35, 10.0)) is None
    assert notebook.rect_sample(mask, 5, 10, 9, 10) == (1.0, 0) and notebook.rect_sample(mask, 5, 10, 9, 19)[0] == 0.1
    assert (png.decode(png.encode_codes(mask, render.COLOURS)) == render.COLOURS[mask]).all()


@pytest.mark.parametrize(("share", "kind"), [(0.149, "skip"), (0.15, "hatch"), (0.499, "hatch"), (0.5, "solid")])
def test_fill_limits(spark, share, kind):
    assert spark.range(1).select(geometry.fill_kind(F.lit(share))).first()[0] == kind


def test_names(spark):
    got = spark.createDataFrame([(5, 48), (15, 81), (9, 33)], "pen int, colour int").select(strokes.pen_name(F.col("pen"), F.lit("others")), strokes.grey_level(F.col("colour"))).collect()
    assert [tuple(r) for r in got] == [("marker", 157), ("calligraphy", 202), ("unknown", 33)]
    assert spark.range(1).select(svg.hatch(F.lit("rgb(0,0,0)"))).first()[0].startswith('<pattern id="hatch-rgb-0-0-0-"')


def test_pdf(spark):
    words = "array<struct<label:string,x:double,y:double,w:double,h:double>>"
    rows = [("n", 2, 30.0, 40.0, None, [("two", 1.0, 1.0, 5.0, 5.0), ("中", 1.0, 1.0, 5.0, 5.0)]), ("n", 1, 30.0, 40.0, bytearray(png.encode(np.zeros((4, 3, 4), np.uint8))), [("o(n)e", 1.0, 1.0, 5.0, 5.0)])]
    (row,) = pdf.documents(spark.createDataFrame(rows, f"note_id string, page_no int, page_w double, page_h double, png binary, words {words}"), 300).collect()
    data = bytes(row["pdf"])
    at = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[at : at + 4] == b"xref" and b"/Count 2" in data
    for n, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(place) :].startswith(b"%d 0 obj" % n)
    streams = [zlib.decompress(s) for s in re.findall(rb"stream\n(.*?)\nendstream", data, re.S)]
    assert any(b"(o\\(n\\)e) Tj" in s for s in streams) and any(s.count(b"Tj") == 1 and b"(two)" in s for s in streams)


def test_frames(spark, tmp_path):
    part = lambda b: b"--x\r\nContent-Type: image/jpeg\r\nContent-Length: %d\r\n\r\n%s\r\n" % (len(b), b)
    feed = part(b"\xff\xd8\xfe one") + part(b"Content-Length: 3") + part(b"cut short")[:-8]
    assert list(frames.frames(feed)) == [b"\xff\xd8\xfe one", b"Content-Length: 3"]
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.bin").write_bytes(feed)
    stream = frames.read_stream(spark, str(tmp_path / "feed")).writeStream.format("memory").queryName("frames").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("frames").count() == 2


def test_exports_decode_once_and_shuffle_nothing(drawn):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    physical = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    pages = notebook.svg_pages(drawn, vector_ink=True)
    assert "Exchange" not in physical(pages) and physical(pages).count("_decode(") == 1 and physical(pages).count("_seen(") == 1
    summary = notebook.page_summary(drawn)
    assert physical(summary).count("Exchange") == 1 and physical(summary).count("_decode(") == 1 and "Join" not in plan(summary)
