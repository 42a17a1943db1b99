"""Searchable PDF documents from page images and words, by a small writer."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwright.operators import render
from inkwright.session import grouped, ship
from inkwright.sources import png


# The font's advances of characters 32 to 126, in thousandths of its size.
ADVANCES = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
USUAL_ADVANCE = 556
# A hatched heading's lines, in pixels.
HATCH_STEP, HATCH_WIDTH = 10 * 2**0.5, 5


def advance(label: str) -> int:
    """The width of a text in thousandths of the font's size; a letter with an accent is as wide as without."""
    at = (ord(unicodedata.normalize("NFD", c)[0]) - 32 for c in label)
    return sum(ADVANCES[k] if 0 <= k < len(ADVANCES) else USUAL_ADVANCE for k in at)


def _escaped(text: str) -> bytes | None:
    """The text in the font's encoding; none if it doesn't have a character."""
    try:
        return text.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")
    except UnicodeEncodeError:
        return None


def text_ops(words: list[tuple[str, float, float, float, float]], height: float, scale: float) -> bytes:
    """Invisible words (label, x, y, w, h in pixels, from the top), each squeezed to its box; a word
    that the font can't write is left out."""
    out = [b"BT 3 Tr"]
    for label, x, y, w, h in words:
        if (said := _escaped(label)) and h > 0:
            wide = advance(label) * h / 1000
            out.append(b"/F1 %.3f Tf %.3f Tz 1 0 0 1 %.3f %.3f Tm (%s) Tj" % (h * scale, 100 * w / wide if wide else 100, x * scale, height - (y + h) * scale, said))
    return b"\n".join([*out, b"ET"])


def _paint(colour: str) -> bytes:
    m = re.search(r"rgb\((\d+),\s*(\d+),\s*(\d+)\)", colour)
    return b"%.4f %.4f %.4f" % tuple(int(v) / 255 for v in (m.groups() if m else (0, 0, 0)))


def _line(points: list) -> bytes:
    return b" ".join(b"%.2f %.2f %s" % (p["x"], p["y"], b"l" if i else b"m") for i, p in enumerate(points))


def hatch_ops(x: float, y: float, w: float, h: float, paint: bytes) -> list[bytes]:
    """A white rectangle with slanted lines, each cut where it leaves the rectangle."""
    out = [b"1 1 1 rg %.2f %.2f %.2f %.2f re f" % (x, y, w, h), b"%s RG 0 J %d w" % (paint, HATCH_WIDTH)]
    for k in range(int((w + h) // HATCH_STEP) + 1):
        c = x - (y + h) + k * HATCH_STEP
        top, bottom = max(y, x - c), min(y + h, x + w - c)
        if top < bottom:
            out.append(b"%.2f %.2f m %.2f %.2f l S" % (c + top, top, c + bottom, bottom))
    return out


def ink_ops(primitives: list, height: float, scale: float) -> bytes:
    """Strokes in drawing order, in pixels from the top."""
    out = [b"q %.5f 0 0 %.5f 0 %.3f cm" % (scale, -scale, height)]
    for it in primitives:
        paint = _paint(it["colour"])
        if it["kind"] == "rect":
            p, q = it["points"][0], it["points"][1]
            box = min(p["x"], q["x"]), min(p["y"], q["y"]), abs(p["x"] - q["x"]), abs(p["y"] - q["y"])
            out += hatch_ops(*box, paint) if it["fill"] == "hatch" else [b"%s rg %.2f %.2f %.2f %.2f re f" % (paint, *box)]
        elif it["kind"] == "filledPath":
            out.append(b"%s rg %s f" % (paint, b" ".join(_line(ring) + b" h" for ring in it["rings"])))
        else:
            out.append(b"%s RG 1 J 1 j %.3f w %s S" % (paint, it["width"], _line(it["points"])))
    return b"\n".join([*out, b"Q"])


def write(pages: list[tuple[float, float, bytes | None, list, list]], dpi: float = 300) -> bytes:
    """A document of pages (width and height in pixels, PNG or none, words, strokes)."""
    objects: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids, scale = [], 72 / dpi

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(head: bytes, data) -> int:
        packed = zlib.compress(data, png.LEVEL)
        return add(b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (head, len(packed), packed))

    for w, h, image, words, primitives in pages:
        wide, high, ops, extra = w * scale, h * scale, [], b""
        if image is not None:
            flat = np.ascontiguousarray(render.on_white(png.decode(image))[..., :3])
            no = stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8" % (flat.shape[1], flat.shape[0]), flat)
            extra = b"/XObject << /Im %d 0 R >>" % no
            ops.append(b"q %.3f 0 0 %.3f 0 0 cm /Im Do Q" % (wide, high))
        if primitives:
            ops.append(ink_ops(primitives, high, scale))
        ops.append(text_ops(words, high, scale))
        content = stream(b"", b"\n".join(ops))
        kids.append(add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.3f %.3f] /Resources << /Font << /F1 3 0 R >> %s >> /Contents %d 0 R >>" % (wide, high, extra, content)))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.5\n"), []
    for no, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (no, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table)
    return bytes(out)


def documents(pages: DataFrame, dpi: float = 300) -> DataFrame:
    """(note_id, pdf) of rows (note_id, page_no, page_w, page_h, png, words and, if there, primitives):
    a note is one task's group, as its document is one value."""
    ship(pages.sparkSession)

    def make(rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda r: r["page_no"])
        made = [(r["page_w"], r["page_h"], r["png"], [tuple(w.values()) for w in r["words"] or ()], r.get("primitives") or []) for r in found]
        return pa.table({"note_id": [found[0]["note_id"]], "pdf": pa.array([write(made, dpi)], pa.binary())})

    return grouped(pages, "note_id").applyInArrow(make, "note_id string, pdf binary")
