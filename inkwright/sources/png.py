"""PNG files of 8-bit RGBA images, by zlib and numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The file signature and the channels of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


#: How hard images are packed: pages are mostly of one colour, so more gains little.
LEVEL = 2


def _file(rows: np.ndarray, kind: int, *more: bytes) -> bytes:
    h, w = rows.shape[:2]
    lines = np.zeros((h, 1 + rows[0].size), np.uint8)
    lines[:, 1:] = rows.reshape(h, -1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + b"".join(more) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def encode(rgba: np.ndarray) -> bytes:
    return _file(rgba, 6)


def encode_codes(codes: np.ndarray, colours: np.ndarray) -> bytes:
    """An image of numbers of colours (256 RGBA rows), a byte a pixel."""
    return _file(codes, 3, _chunk(b"PLTE", colours[:, :3].tobytes()), _chunk(b"tRNS", colours[:, 3].tobytes()))


def painted(codes: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """The RGBA pixels of numbers of colours."""
    return np.ascontiguousarray(colours).view(np.uint32).ravel()[codes].view(np.uint8).reshape(*codes.shape, 4)


def _by_neighbours(line: bytes, up: bytes, step: int, paeth: bool) -> bytes:
    """A row whose bytes are differences to the mean, or the nearest in value, of their neighbours."""
    now = bytearray(len(line) + step)  # the first pixel's left neighbour is zero
    for x, (value, b) in enumerate(zip(line, up, strict=True)):
        a = now[x]
        if paeth:
            c = up[x - step] if x >= step else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        else:
            guess = (a + b) >> 1
        now[x + step] = value + guess & 255
    return bytes(now[step:])


def _unfilter(raw: np.ndarray, h: int, stride: int, step: int) -> np.ndarray:
    if not raw[:, 0].any():
        return raw[:, 1:]
    out = np.zeros((h + 1, stride), np.uint8)
    for y in range(h):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int32), out[y].astype(np.int32)
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + up & 255
        elif kind == 1:
            out[y + 1] = (np.cumsum(line.reshape(-1, step), axis=0) & 255).ravel()
        else:
            out[y + 1] = np.frombuffer(_by_neighbours(raw[y, 1:].tobytes(), out[y].tobytes(), step, kind == 4), np.uint8)
    return out[1:]


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) uint8 of a file with channels of 1 to 16 bits, not interlaced."""
    try:
        return _decode(data)
    except (zlib.error, struct.error, KeyError, IndexError, TypeError) as e:
        raise ValueError(f"broken PNG file: {e}") from e


def _samples(rows: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The samples of unfiltered rows, as many bits as they have (the upper 8 of 16)."""
    if bits == 16:
        return rows[:, ::2]
    if bits == 8:
        return rows
    each = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
    return (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, :width]


def _decode(data: bytes) -> np.ndarray:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, palette, clear, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            packed.append(body)
    if head is None or head[6]:
        raise ValueError("not a plain PNG file")
    w, h, bits, kind = head[:4]
    c = CHANNELS[kind]
    stride = -(-w * c * bits // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + stride)
    px = _samples(_unfilter(raw, h, stride, max(1, c * bits // 8)), w * c, bits).reshape(h, w, c)
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        table = np.full((len(palette), 4), 255, np.uint8)
        table[:, :3] = palette
        table[: len(clear), 3] = np.frombuffer(clear, np.uint8)
        return painted(px[..., 0], table)
    full = px if bits >= 8 else px * (255 // ((1 << bits) - 1))
    out[..., :3] = full[..., :3] if c >= 3 else full[..., :1]
    if c in (2, 4):
        out[..., 3] = full[..., -1]
    elif clear:
        one = np.frombuffer(clear, ">u2")
        out[(px == (one >> 8 if bits == 16 else one)).all(axis=2), 3] = 0
    return out
