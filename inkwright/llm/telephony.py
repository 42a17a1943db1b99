"""Media columns: telephony audio.

Bytes are kept losslessly as the 8-bit samples of an 8 kHz WAV file: mu-law (format tag 7), A-law
(tag 6), or blocks of IMA ADPCM (tag 17). Media files are stored as a table and read back.
Reading parses a file, and by its tag expands mu-law or A-law by a table of 256 entries or decodes
ADPCM blocks with numpy across all blocks of a batch (one step a nibble, every block at once).
Mono PCM at twice the rate comes from an integer half-band filter; it is stored as WAV files in a
table, and its digest is taken from what is read there.

Edges: a null text is empty; an empty text is one block of zeros; texts of any length are
taken whole; equal texts give equal values; tables without rows give none; only the named
columns are read. A media value that isn't such a file (no WAV, another tag, no samples, stereo,
an ADPCM file without a whole block) gives nulls; ADPCM bytes after the last whole block count
as payload but give no samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwright.llm.shared import small_batches, written
from inkwright.llm.tokens import pieces

BLOCK = 64
RATE = 8000
MULAW, ALAW, ADPCM, PCM = 7, 6, 17, 1

# Fixed values of the IMA ADPCM format: quantizer steps, and index changes by a nibble's low three bits.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
TURNS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    b = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((b & 0x0F) << 3) + 0x84 << ((b >> 4) & 7)) - 0x84
    return np.where(b & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    b = np.arange(256, dtype=np.int32) ^ 0x55
    part, power = (b & 0x0F) << 4, (b >> 4) & 7
    size = np.where(power == 0, part + 8, (part + 0x108) << np.maximum(power - 1, 0))
    return np.where(b & 0x80, size, -size).astype(np.int16)


_MU, _A = mulaw_table(), alaw_table()
_DELTA = np.array([[(1 - 2 * (n >> 3)) * ((s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)) for n in range(16)] for s in STEPS.tolist()], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, mono: each row of ``blocks`` (uint8) is one block: first sample (int16),
    step index, a reserved byte, then two samples a byte, low nibble first."""
    n, width = blocks.shape
    out = np.empty((n, 1 + 2 * (width - 4)), np.int16)
    level = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[:, 0] = level
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(columns.shape[0]):
        for j, nibble in enumerate((columns[k] & 15, columns[k] >> 4)):
            level += _DELTA[index, nibble]
            np.clip(level, -32768, 32767, out=level)
            index += TURNS[nibble & 7]
            np.clip(index, 0, 88, out=index)
            out[:, 1 + 2 * k + j] = level
    return out


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, and (-1, 9, 9, -1) / 16 of their neighbours goes between."""
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def wav(data: bytes, tag: int, rate: int, bits: int) -> bytes:
    """A mono WAV file; ``bits`` a sample, or 4 for ADPCM, whose blocks have BLOCK bytes."""
    step = max(1, bits // 8) if tag != ADPCM else BLOCK
    head = struct.pack("<4sI4s4sIHHIIHHH4sI", b"RIFF", 38 + len(data) + len(data) % 2, b"WAVE", b"fmt ", 18, tag, 1, rate, rate * step if tag != ADPCM else rate * BLOCK // (1 + 2 * (BLOCK - 4)), step, bits, 0, b"data", len(data))
    return head + data + b"\0" * (len(data) % 2)


def wav_data(stored: bytes) -> tuple[int, int, bytes, int]:
    """Format tag, rate, samples and block size of a mono WAV file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate, block = 12, 0, 0, 0
    while at + 8 <= len(stored):
        name, n = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            if n < 16 or at + 24 > len(stored):
                raise ValueError("no format")
            tag, channels, rate, _, block = struct.unpack_from("<HHIIH", stored, at + 8)
            if channels != 1:
                raise ValueError("not mono")
        elif name == b"data":
            return tag, rate, stored[at + 8 : at + 8 + n], block
        at += 8 + n + n % 2
    raise ValueError("no samples")


def payload(text: bytes) -> bytes:
    """The bytes, filled up with zeros to a positive multiple of the block."""
    return text + b"\0" * (BLOCK - len(text) if not text else -len(text) % BLOCK)


def _encoder(tag: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            for lo, part in pieces(raw, 8 << 20):
                texts = [x or b"" for x in part.to_pylist()]
                media = [wav(payload(x), tag, RATE, 4 if tag == ADPCM else 8) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def encode_media(docs: DataFrame, tag: int = MULAW) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as the samples of a WAV file of that format, stored."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(_encoder(tag), f"doc_id {kind}, n_bytes bigint, media binary"), "media", "zstd")


def _blocks(data: list[bytes], block: int) -> np.ndarray:
    """The samples of all whole blocks, decoded at once."""
    rows = np.frombuffer(b"".join(x[: len(x) // block * block] for x in data), np.uint8).reshape(-1, block)
    out = np.empty((len(rows), 1 + 2 * (block - 4)), np.int16)
    for k in range(0, len(rows), 1 << 13):
        out[k : k + (1 << 13)] = decode_adpcm(rows[k : k + (1 << 13)])
    return out


def linear(found: list[tuple[int, int, bytes, int] | None]) -> list[np.ndarray | None]:
    """The samples of files (see ``wav_data``) by their tags; nothing for those that can't be decoded."""
    out: list[np.ndarray | None] = [None] * len(found)
    coded: dict[int, list[int]] = {}
    for k, x in enumerate(found):
        if x and x[2]:
            tag, _, data, block = x
            if tag in (MULAW, ALAW):
                out[k] = (_MU if tag == MULAW else _A)[np.frombuffer(data, np.uint8)]
            elif tag == ADPCM and block > 4 and len(data) >= block:
                coded.setdefault(block, []).append(k)
    for block, files in coded.items():
        rows = _blocks([found[k][2] for k in files], block)
        ends = np.cumsum([len(found[k][2]) // block for k in files])
        for k, part in zip(files, np.split(rows, ends[:-1]), strict=True):
            out[k] = part.reshape(-1)
    return out


def _features(found: list[tuple[int, int, bytes, int] | None], decoded: list[np.ndarray | None]) -> Iterator[str | None]:
    """What each file's samples say as mu-law, as A-law and as ADPCM blocks of 64 bytes."""
    coded = _blocks([x[2] for x, pcm in zip(found, decoded, strict=True) if pcm is not None], BLOCK)
    power = lambda x: round(float(np.sqrt(np.mean(np.square(x.astype(np.float32)), dtype=np.float64))), 1) if x.size else 0.0
    at = 0
    for x, pcm in zip(found, decoded, strict=True):
        if pcm is None:
            yield None
            continue
        b = np.frombuffer(x[2], np.uint8)
        mu, a, blocks = _MU[b], _A[b], coded[at : at + len(b) // BLOCK]
        at += len(b) // BLOCK
        turns = int(np.count_nonzero((mu[1:] ^ mu[:-1]) < 0))
        yield f"mulaw rms={power(mu)} peak={int(np.abs(mu.astype(np.int32)).max())} turns={turns}; alaw rms={power(a)} crc={zlib.crc32(a.tobytes()):08x}; adpcm rms={power(blocks)} crc={zlib.crc32(blocks.tobytes()):08x}"


def _file(stored: bytes | None) -> tuple[int, int, bytes, int] | None:
    try:
        return wav_data(stored or b"")
    except ValueError:
        return None


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, part in pieces(batch.column(2), 2 << 20):
            stored = part.to_pylist()
            found = [_file(x) for x in stored]
            pcm = linear(found)
            ok = lambda f: [None if p is None else f(x[2]) for x, p in zip(found, pcm, strict=True)]
            columns = [
                batch.column(0).slice(lo, len(stored)),
                batch.column(1).slice(lo, len(stored)),
                pa.array(ok(len), pa.int64()),
                pa.array(ok(lambda x: hashlib.sha256(x).hexdigest()), pa.string()),
                pa.array(ok(lambda x: zlib.crc32(x[-BLOCK:])), pa.int64()),
                pa.array([None if x is None else len(x) for x in stored], pa.int64()),
                pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in stored], pa.string()),
                pa.array(_features(found, pcm), pa.string()),
                pa.array([None if p is None else wav(double_rate(p).astype("<i2", copy=False).tobytes(), PCM, 2 * x[1], 16) for x, p in zip(found, pcm, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of stored files (doc_id, n_bytes, media), and their samples as mono PCM
    WAV files of twice the rate (``pcm``)."""
    small_batches(media.sparkSession)
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm binary")


def store_pcm(read: DataFrame) -> DataFrame:
    """``read_media``'s rows as they are read from a stored table."""
    return written(read, "pcm", "zstd")
