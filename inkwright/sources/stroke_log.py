"""Stroke logs: the bytes of a page's pen records as rows, by numpy views over each record."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.session import ship

# Places and sizes in a record.
HEAD, MOST_RECORDS, MOST_RINGS = 208, 1_000_000, 1000
PEN, COLOUR, THICKNESS, CLASS, KIND, KIND_SIZE, SCREEN = 0, 4, 8, 40, 48, 52, 128
SKIPPED = (2, 4, 1, 8, 4)
STATUS_SPAN, TAIL_SPAN = 52, 10


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def uint(self) -> int:
        (n,) = struct.unpack_from("<I", self.data, self.at)
        self.at += 4
        return n

    def take(self, kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, count, self.at)
        self.at += out.nbytes
        return out

    def skip(self, count: int) -> None:
        if count < 0 or self.at + count > len(self.data):
            raise ValueError("section past the end")
        self.at += count


def _rings(r: _Reader) -> list[np.ndarray] | None:
    """The outline, or nothing if any of it is inconsistent."""
    try:
        r.skip(4 * r.uint())
        r.skip(TAIL_SPAN)
        n = r.uint()
        if n > MOST_RINGS:
            return None
        return [r.take("<f4", 2 * r.uint()).reshape(-1, 2) for _ in range(n)]
    except (ValueError, struct.error):
        return None


def flat(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a binary column in a row, and where each value begins (nulls are empty)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return b"".join(column.drop_null().to_pylist()), np.concatenate([[0], np.cumsum(sizes)])


def _bodies(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """(log, place, begin, end) of the records' bodies. A length of zero or past the log's end stops the
    walk through a log and keeps what was read."""
    out = []
    for log, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        count = int.from_bytes(data[at : at + 4], "little") if end - at >= HEAD else 0
        at += 4
        for k in range(count if 0 < count <= MOST_RECORDS else 0):
            size = int.from_bytes(data[at : at + 4], "little")
            if at + 4 > end or size == 0 or at + 4 + size > end:
                break
            out.append((log, k, at + 4, at + 4 + size))
            at += 4 + size
    return np.array(out, np.int64).reshape(-1, 4)


_names: dict[bytes, str] = {}


def _name(raw: bytes) -> str:
    if raw not in _names:
        if len(_names) > 1000:
            _names.clear()
        _names[raw] = raw.split(b"\0")[0].decode("utf-8", "replace")
    return _names[raw]


def columns(data: bytes, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The records of logs that lie in a row, a column each: ``log``, ``k``, the head's numbers, ``kind``,
    ``trail_status``, and where points (``points_at``, ``n_points``) and outlines (``rings_at``) lie.
    Sections are passed over for all records at once; a record that doesn't decode is left out."""
    body = _bodies(data, offsets)
    at, end = body[:, 2], body[:, 3]
    held = np.frombuffer(data + bytes(HEAD + 4), np.uint8).astype(np.int64)  # what is read past the end doesn't count

    def uint(pos: np.ndarray) -> np.ndarray:
        pos = np.minimum(pos, len(data))
        return held[pos] | held[pos + 1] << 8 | held[pos + 2] << 16 | held[pos + 3] << 24

    signed = lambda x: np.where(x >= 1 << 31, x - (1 << 32), x)
    screen = uint(at + SCREEN)
    ok = (end - at >= HEAD) & (screen > 0)
    pos = at + HEAD
    found = {}
    for name, size in (("", 24), ("points", 8), *(("", n) for n in SKIPPED)):
        n = uint(pos)
        if name:
            found = {"points_at": pos + 4, "n_points": n}
        ok &= pos + 4 <= end
        pos = pos + 4 + size * n
        ok &= pos <= end
    status = signed(uint(pos))
    ok &= pos + STATUS_SPAN <= end
    out = {"log": body[:, 0], "k": body[:, 1], "pen": uint(at + PEN), "colour": uint(at + COLOUR), "thickness": uint(at + THICKNESS), "record_class": signed(uint(at + CLASS)), "screen_height": screen, "trail_status": status, **found, "rings_at": pos + STATUS_SPAN, "end": end}
    out = {c: v[ok] for c, v in out.items()}
    kinds = [_name(data[a + KIND : a + KIND + KIND_SIZE]) for a in at[ok].tolist()]
    return out | {"kind": np.array(kinds, object)}


def records(data: bytes | None) -> Iterator[tuple[int, dict]]:
    """Records of one log with their places in it."""
    found = columns(data or b"", np.array([0, len(data or b"")]))
    heads_ = [found[c].tolist() for c in ("k", *HEAD_COLUMNS, "points_at", "n_points", "rings_at", "end")]
    for k, pen, colour, thickness, record_class, kind, status, screen, at, n, rings_at, end in zip(*heads_, strict=True):
        yx = np.frombuffer(data, "<u4", 2 * n, at).reshape(-1, 2)
        yield k, {
            "pen": pen, "colour": colour, "thickness": thickness, "record_class": record_class, "screen_height": screen, "trail_status": status,
            "kind": kind, "raw_x": yx[:, 1], "raw_y": yx[:, 0], "rings": _rings(_Reader(data[rings_at:end])),
        }


HEAD_COLUMNS = ("pen", "colour", "thickness", "record_class", "kind", "trail_status", "screen_height")


_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
STROKE = """note_id string, page_no int, stroke_idx int, pen bigint, colour bigint, thickness bigint, record_class int, kind string, trail_status int,
points array<struct<x:double,y:double>>, contour array<array<struct<x:double,y:double>>>"""


def _points(x: np.ndarray, y: np.ndarray) -> list[dict]:
    return [{"x": a, "y": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)]


ARROW = pa.schema([("note_id", pa.string()), ("page_no", pa.int32()), ("stroke_idx", pa.int32()), *((c, pa.int64()) for c in ("pen", "colour", "thickness")), ("record_class", pa.int32()), ("kind", pa.string()), ("trail_status", pa.int32()), ("points", pa.list_(_POINT)), ("contour", pa.list_(pa.list_(_POINT)))])


def page_points(r: dict, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """A record's points in page pixels: x runs from the right edge."""
    scale = r["screen_height"] / h
    return w - r["raw_x"] / scale, r["raw_y"] / scale


def row(note: str, no: int, w: int, h: int, k: int, r: dict) -> dict:
    contour = None if r["rings"] is None else [_points(ring[:, 0].astype(float), ring[:, 1].astype(float)) for ring in r["rings"]]
    same = {c: r[c] for c in ("pen", "colour", "thickness", "record_class", "kind", "trail_status")}
    return same | {"note_id": note, "page_no": no, "stroke_idx": k, "points": _points(*page_points(r, w, h)), "contour": contour}


def _lists(values: pa.Array, sizes: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=None if mask is None else pa.array(mask))


def _struct_points(x: np.ndarray, y: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], names=["x", "y"])


def _outlines(data: bytes, found: dict[str, np.ndarray]) -> pa.Array:
    rings = [_rings(_Reader(data[a:b])) for a, b in zip(found["rings_at"].tolist(), found["end"].tolist(), strict=True)]
    each = [ring for some in rings for ring in some or ()]
    xy = np.concatenate([np.zeros((0, 2)), *each])
    inner = _lists(_struct_points(xy[:, 0], xy[:, 1]), np.array([len(r) for r in each], np.int64))
    return _lists(inner, np.array([len(r or ()) for r in rings], np.int64), np.array([r is None for r in rings], bool))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
        data, offsets = flat(pc.if_else(pc.and_(pc.greater(batch.column(2), 0), pc.greater(batch.column(3), 0)), batch.column(4), None))
        found = columns(data, offsets)
        log, n = found["log"], found["n_points"]
        if not len(log):
            continue
        at = np.repeat(found["points_at"] - 8 * (np.cumsum(n) - n), n) + 8 * np.arange(n.sum())
        raw = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(8)].copy().view("<u4").reshape(-1, 2).astype(np.float64)
        w, h = (np.repeat(side[log].astype(np.float64), n) for side in sides)
        scale = np.repeat(found["screen_height"], n) / h
        points = _lists(_struct_points(w - raw[:, 1] / scale, raw[:, 0] / scale), n)
        heads_ = [pa.array(found[c], t) for c, t in (("pen", pa.int64()), ("colour", pa.int64()), ("thickness", pa.int64()), ("record_class", pa.int32()), ("kind", pa.string()), ("trail_status", pa.int32()))]
        where = pa.array(log)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(found["k"], pa.int32()), *heads_, points, _outlines(data, found)], schema=ARROW)


HEADS = "array<struct<pen:bigint,colour:bigint,record_class:int,kind:string,trail_status:int>>"
_HEADS = pa.list_(pa.struct([("pen", pa.int64()), ("colour", pa.int64()), ("record_class", pa.int32()), ("kind", pa.string()), ("trail_status", pa.int32())]))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = columns(*flat(batch.column(batch.num_columns - 1)))
        each = pa.StructArray.from_arrays([pa.array(found[f.name], f.type) for f in _HEADS.value_type], fields=list(_HEADS.value_type))
        lists = _lists(each, np.bincount(found["log"], minlength=batch.num_rows))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "heads"])


def heads(pages: DataFrame) -> DataFrame:
    """Pages with ``heads``, what their records say beside their points, in place of ``total_path``."""
    ship(pages.sparkSession)
    kept = pages.drop("total_path")
    return pages.select(*kept.columns, "total_path").mapInArrow(_heads, kept.schema.simpleString()[7:-1] + f",heads:{HEADS}")


def strokes(pages: DataFrame) -> DataFrame:
    """All records of pages (note_id, page_no, page_w, page_h, total_path), in page pixels."""
    ship(pages.sparkSession)
    return pages.where(F.col("total_path").isNotNull()).select("note_id", "page_no", "page_w", "page_h", "total_path").mapInArrow(_decode, STROKE)
