"""Pixels: a page's layers to an image, tiles to surfaces. One page or document a call; numpy only."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from inkwright.operators.runs import LONG, LONG_BLANK, PALETTE, UNKNOWN
from inkwright.session import ship
from inkwright.sources import png

BYTES = ("layers", "total_path")
INK_LAYERS = ("MAINLAYER", "LAYER1", "LAYER2", "LAYER3")


def runs_of(data: bytes, pixels: int, blank: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of a bitmap's runs; the fold of ``runs.fold`` over real bytes, for all pairs at once."""
    pairs = np.frombuffer(data, np.uint8, len(data) // 2 * 2).reshape(-1, 2).astype(np.int64)
    code, n = pairs[:, 0], pairs[:, 1]
    if not len(n):
        return code, n
    at = np.arange(len(n))
    high, upper = (n >= 128) & (n != 255), ((n & 127) + 1) << 7
    could = np.zeros(len(n), bool)  # the pair before may be held for this one
    could[1:] = high[:-1] & (code[1:] == code[:-1])
    joins = could & ((at - np.maximum.accumulate(np.where(could, 0, at))) % 2 == 1)
    held = high & ~joins
    alone = np.zeros(len(n), bool)  # what was held stands alone before this pair
    alone[1:] = held[:-1] & ~joins[1:]
    own = np.where(n == 255, LONG_BLANK if blank else LONG, np.where(high, 0, n + 1))
    own[1:] = np.where(joins[1:], 1 + n[1:] + upper[:-1], own[1:])
    before = np.zeros(len(n), np.int64)
    before[1:] = np.where(alone[1:], upper[:-1], 0)
    codes_, lengths = np.stack([np.roll(code, 1), code], 1).ravel(), np.stack([before, own], 1).ravel()
    if held[-1]:
        gap, size = pixels - lengths.sum(), (n[-1] & 127) + 1
        codes_, lengths = np.append(codes_, code[-1]), np.append(lengths, next((size << i for i in range(7, -1, -1) if size << i <= gap), 0))
    return codes_[lengths > 0], lengths[lengths > 0]


def codes(data: bytes, width: int, height: int, factor: int = 1, blank: bool = False) -> np.ndarray:
    """The colour code of every ``factor``-th row and column."""
    code, length = runs_of(data, width * height, blank)
    if length.sum() != width * height:
        raise ValueError(f"{length.sum()} pixels instead of {width * height}")
    if factor == 1:
        return np.repeat(code.astype(np.uint8), length).reshape(height, width)
    kept = (np.arange(0, height, factor)[:, None] * width + np.arange(0, width, factor)).ravel()
    return code.astype(np.uint8)[np.searchsorted(np.cumsum(length), kept, "right")].reshape(-(-height // factor), -(-width // factor))


COLOURS = np.array([PALETTE.get(c, UNKNOWN) for c in range(256)], np.uint8)
#: Codes of ink, and codes that replace what lies below (a pixel with any channel set).
INK, COVERS = COLOURS[:, 3] > 0, COLOURS.any(axis=1)


def image(data: bytes, width: int, height: int, factor: int = 1, blank: bool = False) -> np.ndarray:
    return png.painted(codes(data, width, height, factor, blank), COLOURS)


def over(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``source`` laid over ``target``: a pixel with any channel set replaces what is below."""
    if source.shape != target.shape:
        raise ValueError(f"sizes differ: {source.shape} and {target.shape}")
    return np.where(source.any(axis=2, keepdims=True), source, target)


def on_white(rgba: np.ndarray) -> np.ndarray:
    alpha, whole = rgba[..., 3], np.ascontiguousarray(rgba).view("<u4")[..., 0]
    out = np.where(alpha == 0, np.uint32(0xFFFFFFFF), whole | np.uint32(0xFF000000)).view(np.uint8).reshape(rgba.shape)
    part = (alpha > 0) & (alpha < 255)
    if part.any():
        a = rgba[part][:, 3:] / 255.0
        out[part, :3] = np.floor(rgba[part][:, :3] * a + 255 * (1 - a) + 0.5)
    return out


def enlarged(rgba: np.ndarray, factor: float) -> np.ndarray:
    """Bicubic enlargement of premultiplied colours (kernel parameter -1/2)."""
    if not (factor >= 1 and math.isfinite(factor)):
        raise ValueError("upscale must be a finite number of 1 or more")

    def kernel(t: np.ndarray) -> np.ndarray:
        t = abs(t)
        return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))

    def along(x: np.ndarray) -> np.ndarray:
        n = len(x)
        at = (np.arange(round(n * factor)) + 0.5) / factor - 0.5
        low = np.floor(at).astype(int)
        taps = [(np.clip(low + j, 0, n - 1), kernel(at - (low + j))) for j in (-1, 0, 1, 2)]
        return sum(x[i] * w.astype(np.float32).reshape(-1, *[1] * (x.ndim - 1)) for i, w in taps)

    x = rgba.astype(np.float32)
    x[..., :3] *= x[..., 3:] / 255
    x = along(along(x).swapaxes(0, 1)).swapaxes(0, 1)
    a = np.clip(x[..., 3:], 0, 255)
    x[..., :3] = np.where(a > 0, x[..., :3] * 255 / np.maximum(a, 1e-9), 0)
    x[..., 3:] = a
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def resized(rgba: np.ndarray, width: int, height: int, factor: int) -> np.ndarray:
    """The nearest pixels of an image of any size, at the size of a page reduced by the factor."""
    h, w = math.ceil(height / factor), math.ceil(width / factor)
    return rgba[np.arange(h) * rgba.shape[0] // h][:, np.arange(w) * rgba.shape[1] // w]


def page_layers(layers: dict[str, bytes | None], seq: list[str], style: str, width: int, height: int, factor: int = 1) -> tuple[np.ndarray | None, np.ndarray | None]:
    """A page's layers in their sequence, the last of which lies at the bottom: the codes of those that
    are run-length coded, laid over each other, and the picture below them. Either may be missing."""
    if factor != int(factor) or factor < 1:
        raise ValueError("scale must be a whole number of 1 or more")
    out, below = None, None
    for name in reversed([n for n in seq if layers.get(n)]):
        if name == "BGLAYER" and style.startswith("user_"):
            now = png.decode(layers[name])
            now = resized(now, width, height, factor) if factor > 1 else now
            below = now if out is None and below is None else over(now, below if out is None else _laid(out, below))
            out = None
        else:
            now = codes(layers[name], width, height, factor)
            out = now if out is None else np.where(COVERS[now], now, out)
    return out, below


def _laid(found: np.ndarray, below: np.ndarray | None) -> np.ndarray:
    top = png.painted(found, COLOURS)
    return top if below is None else over(top, below)


def page_image(layers: dict[str, bytes | None], seq: list[str], style: str, width: int, height: int, factor: int = 1) -> np.ndarray | None:
    """A page's pixels; none without layers."""
    found, below = page_layers(layers, seq, style, width, height, factor)
    return below if found is None else _laid(found, below)


def page_png(layers: dict[str, bytes | None], seq: list[str], style: str, width: int, height: int, factor: int = 1, upscale: float = 1) -> bytes | None:
    """A page as a file: of colour numbers where it has no other picture and keeps its size."""
    found, below = page_layers(layers, seq, style, width, height, factor)
    if found is None and below is None:
        return None
    if below is None and upscale == 1:
        return png.encode_codes(found, COLOURS)
    rgba = below if found is None else _laid(found, below)
    return png.encode(rgba if upscale == 1 else enlarged(rgba, upscale))


def _drawn(scale: int, upscale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.select(["page_w", "page_h", "style", "layer_seq", "layers", "raster_ink"]).to_pylist()[0]
                names = (*INK_LAYERS, "BGLAYER")
                found = {n: layer["bitmap"] for n, layer in zip(names, row["layers"], strict=True) if row["raster_ink"] or n == "BGLAYER"}
                data, error = None, None
                try:
                    data = page_png(found, row["layer_seq"], row["style"] or "0", row["page_w"], row["page_h"], scale, upscale)
                except (ValueError, KeyError, IndexError) as e:
                    error = str(e)
                kept = [i for i, n in enumerate(one.schema.names) if n not in BYTES]
                yield pa.RecordBatch.from_arrays([*(one.column(i) for i in kept), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=[*(one.schema.names[i] for i in kept), "png", "error"])

    return run


def page_pngs(pages: DataFrame, scale: int = 1, upscale: float = 1) -> DataFrame:
    """Pages with ``png`` and ``error`` in place of their bytes; a page without layers, or whose
    layers don't decode, has no png. Where a column ``raster_ink`` is false only the background is drawn."""
    if scale != int(scale) or scale < 1:
        raise ValueError("scale must be a whole number of 1 or more")
    if not (upscale >= 1 and math.isfinite(upscale)):
        raise ValueError("upscale must be a finite number of 1 or more")
    ship(pages.sparkSession)
    if "raster_ink" not in pages.columns:
        pages = pages.withColumn("raster_ink", F.lit(True))
    pages = pages.drop("total_path")
    kept = [f for f in pages.schema.fields if f.name not in BYTES]
    return pages.mapInArrow(_drawn(scale, upscale), StructType([*kept, StructField("png", BinaryType()), StructField("error", StringType())]))


def stitch(tiles: dict[int, bytes], grid: tuple[int, int, int, int]) -> np.ndarray | None:
    """Tiles by id on the grid (first column, first row, last column, last row); none without tiles."""
    if not tiles:
        return None
    found = {t: png.decode(data).copy() for t, data in sorted(tiles.items())}
    for tile in found.values():
        tile[tile[..., 3] == 0] = 0
    h, w, _ = next(iter(found.values())).shape
    c0, r0, c1, r1 = grid
    out = np.zeros(((r1 - r0 + 1) * h, (c1 - c0 + 1) * w, 4), np.uint8)
    for t, tile in found.items():
        y, x = (t % 4096 - r0) * h, (t // 4096 - c0) * w
        out[y : y + h, x : x + w] = tile[: out.shape[0] - y, : out.shape[1] - x]
    return out


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            cells = [(t["tid"] // 4096, t["tid"] % 4096) for t in row["tiles"]]
            grid = (*(min(x, default=0) for x in zip(*cells)), *(max(x, default=0) for x in zip(*cells)))  # noqa: B905
            image, error = None, None
            try:
                for name in row["names"]:
                    now = stitch({t["tid"]: t["png"] for t in row["tiles"] if t["surface"] == name}, grid)
                    if now is not None:
                        image = now if image is None else over(now, image)
            except ValueError as e:
                image, error = None, str(e)
            data = None if image is None else png.encode(image)
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]]), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=["doc_id", "png", "error"])


def document_pngs(docs: DataFrame, visible: list[str] | None = None) -> DataFrame:
    """(doc_id, png, error): all surfaces, or the visible ones, from the bottom up on the grid of
    all; no png without any tile. A document is one row, so nothing is shuffled."""
    from inkwright.sources.tiles import bottom_up

    ship(docs.sparkSession)
    names = bottom_up() if visible is None else F.filter(bottom_up(), lambda n: n.isin(visible))
    return docs.where("error IS NULL").select("doc_id", names.alias("names"), "tiles").mapInArrow(_composed, "doc_id string, png binary, error string")
