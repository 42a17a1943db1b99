"""Writes the files that the other sources read: containers, stroke logs, bitmaps, tile databases."""

from __future__ import annotations

import base64
import json
import sqlite3
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwright.operators.runs import LONG
from inkwright.session import grouped, ship


def rle(pairs: list[tuple[int, int]]) -> bytes:
    return bytes(x for p in pairs for x in p)


def bitmap(runs: list[tuple[int, int]]) -> bytes:
    """(code, length) runs as byte pairs: long runs, then single lengths."""
    out = []
    for code, left in runs:
        out += [(code, 255)] * (left // LONG)
        left %= LONG
        out += [(code, 127)] * (left // 128)
        if left % 128:
            out.append((code, left % 128 - 1))
    return rle(out)


def blank(width: int, height: int, code: int = 0x62) -> bytes:
    """A layer of one colour."""
    return bitmap([(code, width * height)])


_EMPTY_SECTIONS = b"".join(struct.pack("<I", 2) + bytes(2 * size) for size in (2, 4, 1, 8, 4))


def stroke(points, pen: int = 10, colour: int = 0, thickness: int = 400, record_class: int = 5000, kind: str = "others", status: int = 0, screen: int = 1872, rings=(), ring_count: int | None = None) -> bytes:
    """A pen record of points in the pen's own coordinates; ``ring_count`` may misstate the outline."""
    head = bytearray(208)
    struct.pack_into("<III", head, 0, pen, colour, thickness)
    struct.pack_into("<i", head, 40, record_class)
    head[48 : 48 + len(kind)] = kind.encode()
    struct.pack_into("<I", head, 128, screen)
    flat = [v for x, y in points for v in (y, x)]
    body = [bytes(head), struct.pack("<I", 1), bytes(24), struct.pack(f"<I{len(flat)}I", len(points), *flat), _EMPTY_SECTIONS, struct.pack("<i", status), bytes(48), struct.pack("<I", 0), bytes(10)]
    body.append(struct.pack("<I", len(rings) if ring_count is None else ring_count))
    body += [struct.pack(f"<I{2 * len(ring)}f", len(ring), *(v for p in ring for v in p)) for ring in rings]
    return b"".join([*body, b"tail"])


def log(records: list[bytes], count: int | None = None) -> bytes:
    """A stroke log; ``count`` may misstate how many records follow."""
    return struct.pack("<I", len(records) if count is None else count) + b"".join(struct.pack("<I", len(r)) + r for r in records)


class Note:
    """A container under construction: blocks are written as they come, the footer last."""

    def __init__(self, signature=b"noteSN_FILE_VER_20230015"):
        self.data = bytearray(signature)
        self.footer = []

    def block(self, body):
        at = len(self.data)
        self.data += struct.pack("<I", len(body)) + body
        return at

    def kv(self, pairs):
        return self.block("".join(f"<{k}:{v}>" for k, v in pairs).encode())

    def header(self, **values):
        self.footer.append(("FILE_FEATURE", self.kv(values.items())))

    def page(self, no, elements=None, strokes=None, layers=None, drop=(), **values):
        pairs = {"PAGESTYLE": "style", "LAYERINFO": '[{"layerId"#0,"name"#"Main Layer","isVisible"#true}]', "LAYERSEQ": "MAINLAYER,BGLAYER"} | values
        for name, bitmap in (layers or {}).items():
            pairs[name] = self.kv([("LAYERNAME", name), ("LAYERBITMAP", self.block(bitmap))])
        if elements is not None:
            pairs["RECOGNTEXT"] = self.block(base64.b64encode(json.dumps({"elements": elements}).encode()))
        if strokes is not None:
            pairs["TOTALPATH"] = self.block(log(strokes))
        info = pairs.pop("LAYERINFO")
        # layer info holds colons nowhere, so it can stand in a pair
        self.footer.append((f"PAGE{no}", self.kv([(k, v) for k, v in ({"LAYERINFO": info} | pairs).items() if k not in drop])))

    def bytes(self):
        at = self.kv(self.footer)
        return bytes(self.data) + struct.pack("<I", at)


def word(label: str, x: float, y: float, w: float, h: float) -> dict:
    """A recognized word; labels are UTF-8 bytes taken for Latin-1."""
    return {"label": label.encode().decode("latin-1"), "bounding-box": {"x": x, "y": y, "width": w, "height": h}}


def proto(layers) -> bytes:
    """A list of layers (id, name), either of which may be missing."""
    out = b""
    for i, name in layers:
        body = (b"" if i is None else b"\x08" + bytes([i])) + (b"" if name is None else b"\x12" + bytes([len(name)]) + name.encode())
        out += b"\x0a" + bytes([len(body)]) + body
    return out


def tile_file(config: dict, surfaces: dict[str, dict[int, bytes]]) -> bytes:
    """A tile database of configuration values and the tiles of surfaces, built in memory."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE config (name TEXT, value BLOB)")
    db.executemany("INSERT INTO config VALUES (?, ?)", config.items())
    for name, tiles in surfaces.items():
        db.execute(f"CREATE TABLE {name} (tid INTEGER, tile BLOB)")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?)", tiles.items())
    db.commit()
    data = db.serialize()
    db.close()
    return data


POINT = "struct<x:double,y:double>"
PAGES = f"""note_id string, page_no int, header map<string,string>, values map<string,string>, words array<struct<label:string,x:double,y:double,w:double,h:double>>,
strokes array<struct<points:array<{POINT}>,pen:int,colour:int,thickness:int,record_class:int,kind:string,status:int,screen:int,rings:array<array<{POINT}>>>>,
layers array<struct<name:string,runs:array<struct<code:int,len:int>>>>, marks array<struct<kind:string,key:string,values:map<string,string>,body:binary>>, cover array<int>"""
#: Where a mark's picture or text lies.
BODY = {"KEYWORD": "KEYWORDSITE", "TITLE": "TITLEBITMAP", "LINKO": "LINKBITMAP"}


def _note(rows: pa.Table) -> bytes:
    """A file of a note's pages, of which one at a time is held as Python values."""
    note = Note()
    numbers = rows.column("page_no").to_pylist()
    order = sorted(range(len(numbers)), key=numbers.__getitem__)
    one = lambda i, *names: rows.slice(i, 1).select(names or rows.schema.names).to_pylist()[0]
    first = one(order[0], "header", "cover")
    note.header(**dict(first["header"] or [("APPLY_EQUIPMENT", "A5X")]))
    xy = lambda points: [(p["x"], p["y"]) for p in points]
    for i in sorted(order, key=lambda i: str(numbers[i])):  # in the order of texts: readers have to go by the numbers
        page = one(i)
        text = None if page["words"] is None else [{"type": "Text", "label": v["label"], "words": [v]} for v in (word(x["label"], x["x"], x["y"], x["w"], x["h"]) for x in page["words"])]
        ink = None
        if page["strokes"] is not None:
            given = [{k: v for k, v in s.items() if v is not None and k not in ("points", "rings")} for s in page["strokes"]]
            ink = [stroke([(int(x), int(y)) for x, y in xy(s["points"])], rings=[xy(r) for r in s.get("rings") or ()], **more) for s, more in zip(page["strokes"], given, strict=True)]
        layers = {x["name"]: bitmap([(r["code"], r["len"]) for r in x["runs"]]) for x in page["layers"] or ()}
        note.page(page["page_no"], text, ink, layers, **dict(page["values"] or ()))
    for m in (m for i in order for m in one(i, "marks")["marks"] or ()):
        pairs = dict(m["values"] or ())
        if m["body"] is not None:
            pairs[BODY[m["kind"]]] = note.block(m["body"])
        note.footer.append((f"{m['kind']}_{m['key']}", note.kv(pairs.items())))
    for no, size in enumerate(first["cover"] or ()):  # sizes of the covers; 0 is an address without one
        if size is not None:
            note.footer.append((f"COVER_{no}", note.block(b"c" * size) if size else 0))
    return note.bytes()


def notes(pages: DataFrame) -> DataFrame:
    """Files (path, content) of pages like ``PAGES``; columns that are missing are null. Words become
    text elements of one word; strokes are in pen coordinates, marks come in the pages' order. A
    note is one value, so one task's group."""
    ship(pages.sparkSession)
    kinds = {f.name: f.dataType for f in StructType.fromDDL(PAGES)}
    given = [F.col(n).cast(kinds[n]).alias(n) if n in pages.columns and n != "strokes" else F.col(n) if n in pages.columns else F.lit(None).cast(t).alias(n) for n, t in kinds.items()]

    def make(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        return pa.table({"path": rows.column("note_id")[:1], "content": pa.array([_note(rows)], pa.binary())})

    return grouped(pages.select(*given), "note_id").applyInArrow(make, "path string, content binary")
