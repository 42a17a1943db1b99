"""Tile databases: SQLite files with configuration and PNG tiles of surfaces."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.session import ship


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if not b & 128:
            return value & 0xFFFFFFFF, at


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """Varint and length-delimited fields; any other kind ends the walk."""
    out, at = [], 0
    while at < len(data):
        key, at = varint(data, at)
        value, at = varint(data, at) if key & 7 in (0, 2) else (None, at)
        if value is None:
            break
        if key & 7 == 2:
            value, at = data[at : at + value], at + value
        out.append((key >> 3, value))
    return out


def layer_list(data: bytes | None) -> list[tuple[int, str]] | None:
    """(id, name) of each listed layer; nothing without a list or if it doesn't decode. A layer without
    a name is left out, one without an id has 0."""
    if data is None:
        return None
    try:
        found = []
        for no, body in fields(data):
            if no == 1 and isinstance(body, bytes):
                inner = dict(fields(body))
                if isinstance(inner.get(2), bytes):
                    found.append((inner.get(1, 0), inner[2].decode("utf-8", "replace")))
        return found
    except (IndexError, TypeError):
        return None


def as_bytes(value) -> bytes:
    return b"" if value is None else value if isinstance(value, bytes) else str(value).encode()


NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


def numbers(config: dict[str, bytes], *names: str) -> list[float] | None:
    """The numbers that these values begin with; nothing if one is missing or none."""
    found = [NUMBER.match(config[n].decode("utf-8", "replace")) if n in config else None for n in names]
    return [float(m[1]) for m in found] if all(found) else None


# Where the configuration has the view and the size.
VIEW, SIZE = {"x": "vp.x", "y": "vp.y", "scale": "vp.scale"}, {"width": "surface.width", "height": "surface.height"}

SCHEMA = "doc_id string, error string, fmt_ver int, viewport struct<x:double,y:double,scale:double>, canvas struct<width:double,height:double>, thumbnail binary, layers array<struct<id:bigint,name:string>>, config map<string,binary>, surfaces array<string>, tiles array<struct<surface:string,tid:bigint,png:binary>>"
_ARROW = pa.schema([("doc_id", pa.string()), ("error", pa.string()), ("fmt_ver", pa.int32()), ("viewport", pa.struct([(c, pa.float64()) for c in VIEW])), ("canvas", pa.struct([(c, pa.float64()) for c in SIZE])), ("thumbnail", pa.binary()), ("layers", pa.list_(pa.struct([("id", pa.int64()), ("name", pa.string())]))), ("config", pa.map_(pa.string(), pa.binary())), ("surfaces", pa.list_(pa.string())), ("tiles", pa.list_(pa.struct([("surface", pa.string()), ("tid", pa.int64()), ("png", pa.binary())])))])


def decode(content: bytes) -> dict:
    """Configuration, layers and tiles, read from memory (no file is written)."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        config = {str(k): as_bytes(v) for k, v in db.execute("SELECT name, value FROM config")}
        names = sorted(n for (n,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'") if re.fullmatch(r"surface_\d+", n))
        tiles = [{"surface": n, "tid": t, "png": as_bytes(p)} for n in names for t, p in db.execute(f"SELECT tid, tile FROM {n} ORDER BY tid")]
    finally:
        db.close()
    found = layer_list(config.get("ls"))
    ver = re.match(r"\s*([+-]?\d+)", config.get("fmt_ver", b"").decode("utf-8", "replace"))
    named = lambda names: None if (x := numbers(config, *names.values())) is None else dict(zip(names, x, strict=True))
    return {"fmt_ver": int(ver[1]) if ver else None, "viewport": named(VIEW), "canvas": named(SIZE), "thumbnail": config.get("thumbnail") or None, "layers": None if found is None else [{"id": i, "name": n} for i, n in found], "config": list(config.items()), "surfaces": names, "tiles": tiles}


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                row = {"doc_id": path, "error": None} | decode(content or b"")
            except (sqlite3.Error, ValueError) as e:
                row = {"doc_id": path, "error": f"{type(e).__name__}: {e}"}
            yield pa.RecordBatch.from_pylist([row], _ARROW)


def documents(files: DataFrame) -> DataFrame:
    """Files (path, content) as documents, one row each."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(_decode, SCHEMA)


def tile_rows(docs: DataFrame) -> DataFrame:
    return docs.where("error IS NULL").select("doc_id", F.explode("tiles").alias("t")).select("doc_id", "t.*")


def bottom_up() -> Column:
    """A document's surfaces from the bottom up: the listed layers reversed, and then surfaces that
    aren't listed are left out; without a list all surfaces as they are."""
    listed = F.transform(F.reverse("layers"), lambda x: x["name"])
    return F.when(F.col("layers").isNotNull(), F.filter(listed, lambda n: F.array_contains("surfaces", n))).otherwise(F.col("surfaces"))


def order(docs: DataFrame) -> DataFrame:
    """Surfaces from the bottom up (doc_id, surface, z)."""
    return docs.where("error IS NULL").select("doc_id", F.posexplode(bottom_up()).alias("z", "surface"))
