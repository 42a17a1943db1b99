"""Words of UTF-8 texts as numpy arrays, for whole Arrow batches at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, as everywhere in this
package. Nulls count as empty texts. Hashes are 64-bit polynomials over a fixed random
byte table, finished by a multiply-xor mixer, and depend on the word's bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.RandomState(7).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text handled in one go.
PIECE = 1 << 20


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and where each text begins (one more entry than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "").cast(pa.large_binary())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole texts that hold about ``limit`` bytes, or one longer text; with the first row's number."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > limit:
            yield lo, texts.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, texts.slice(lo)


def chars(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters (code points) of ``flat`` texts, and where each text begins."""
    first = (data & 0xC0) != 0x80
    if first.all():
        return data, offsets
    before = np.concatenate([[0], np.cumsum(first)])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return (codes, before[offsets]) if len(codes) == before[-1] else (data, offsets)  # broken UTF-8: its bytes


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 4 * PIECE:  # a giant text: not kept
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    if len(_powers[0]) <= n:
        size = max(PIECE + 1, n + 1)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
    return _powers[0], _powers[1]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes."""
    up, down = _grown(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` within texts: starts, ends, text numbers."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    start, end, doc = spans(~_SPACE[data], offsets)
    return Words(start, end, doc, span_hash(data, start, end))


def shingles(w: Words, n: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, with text numbers, in text order. A text of 1 to n-1
    words has one shingle, of all its words; a text without words has none."""
    count = np.bincount(w.doc, minlength=texts)
    total = len(w.hash)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = np.zeros(total, np.uint64)
    factor = 1
    for j in range(min(n, total)):
        part = w.hash[j:] * np.uint64(factor)
        rolled[: total - j] += part
        factor = factor * _BASE % (1 << 64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    left = (first + count)[w.doc] - np.arange(total)
    whole = left >= n
    short = np.flatnonzero((count > 0) & (count < n))
    doc, h = w.doc[whole], mix(rolled[whole])
    if len(short):
        place = np.uint64(_BASE) ** (np.arange(total) - first[w.doc]).astype(np.uint64)
        weighed = np.concatenate([[np.uint64(0)], np.cumsum(w.hash * place)])
        extra = mix(weighed[first[short] + count[short]] - weighed[first[short]] + count[short].astype(np.uint64))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, extra])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return h, doc
