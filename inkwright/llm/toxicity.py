"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document has the set of its 3- to 6-grams of characters, in lower case. Every n-gram counts:
each is hashed to one of ``2**BITS`` buckets, whatever its frequency. For each bucket the ratio
r = log((p + s P / N) / P) - log((q + s Q / N) / Q) compares in which part of the P toxic and of the Q
other documents it is (N = P + Q, s = SMOOTH); a bucket that no labelled document has gets 0, and one
that few have little. A logistic regression with features r (where
the bucket is present) and an L2 penalty is fitted in numpy by dual coordinate descent: a step
solves one document's dual variable exactly, so there is no rate to choose.

Parameters: the fit takes at most ``per_class`` labelled documents a class, by hashed id, of
``labelled.CLASS_CHARS`` characters together. What is broadcast is one number a bucket.

Edges: null and empty texts score the bias alone; long texts are taken whole; without labels
of both classes every score is 0.5; repeated rows are scored each, and a repeated id is
learned from once; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from inkwright.llm import tokens
from inkwright.llm.labelled import sample
from inkwright.llm.shared import small_batches

SIZES = (3, 4, 5, 6)
PER_CLASS = 2000
BITS = 20
SMOOTH = 50.0
_BASE, _ODD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def gram_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct buckets of each text. The hash of an n-gram is (((1 B + c) B + c') ...) times an
    odd number, and its upper BITS bits are the bucket."""
    codes, offsets = tokens.chars(*tokens.flat(pc.utf8_lower(pc.fill_null(texts, ""))))
    code = codes.astype(np.uint64)
    hashed, key = [], np.ones(len(code) + 1, np.uint64)
    for n in range(1, max(SIZES) + 1):
        key = key[: max(0, len(code) - n + 1)] * np.uint64(_BASE) + code[n - 1 :]
        if n in SIZES:
            hashed.append(((key * np.uint64(_ODD)) >> np.uint64(64 - BITS)).astype(np.int32))
    last = np.empty(1 << BITS, np.int32)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        found = np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(SIZES, hashed, strict=True)])
        place = np.arange(len(found), dtype=np.int32)
        last[found] = place  # of equal buckets one place stays
        yield found[last[found] == place]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, part in tokens.pieces(batch.column(1)):
            each = [_packed(np.sort(f)) for f in gram_sets(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), batch.column(2).slice(lo, len(part)), pa.array(each, pa.binary())], names=["doc_id", "y", "f"])


def _packed(sorted_: np.ndarray) -> bytes:
    """Distinct buckets as their compressed differences, a third of their size."""
    return zlib.compress(np.diff(sorted_, prepend=np.int32(0)).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int32)


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The log-count ratio of every bucket."""
    counts, many = np.zeros((2, 1 << BITS)), np.bincount(y, minlength=2)
    for f, label in zip(rows, y, strict=True):
        counts[label, f] += 1
    other, toxic = (np.log((counts[k] + SMOOTH * many[k] / len(rows)) / max(1, many[k])) for k in (0, 1))
    return toxic - other


def _dual(square: float, z: float, old: float, most: float) -> float:
    """The dual variable a in (0, most) with square (a - old) + z + log(a / (most - a)) = 0, by
    Newton steps on its logit within a shrinking bracket."""
    lo, hi = -z - square * most, -z + square * most
    t = min(max(math.log(old / (most - old)), lo), hi)
    for _ in range(60):
        s = 1 / (1 + math.exp(-min(max(t, -500.0), 500.0)))
        f = square * (most * s - old) + z + t
        lo, hi = (lo, t) if f > 0 else (t, hi)
        step = t - f / (square * most * s * (1 - s) + 1)
        new = step if lo < step < hi else (lo + hi) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return min(max(most / (1 + math.exp(-min(max(t, -500.0), 500.0))), most * 1e-12), most * (1 - 1e-12))


def regress(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, penalty: float = 1.0, passes: int = 25, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights of the features ``r`` and the bias (the weight of a constant feature 1): minimizes the
    log loss of all rows plus penalty / 2 times the squared weights."""
    rng, most = np.random.RandomState(seed), 1.0 / penalty
    w, bias = np.zeros(len(r)), 0.0
    sign = np.where(y > 0, 1.0, -1.0)
    square = [float(np.sum(np.square(r[f], dtype=np.float64))) + 1.0 for f in rows]
    dual = np.full(len(rows), most * 1e-3)
    for f, s, a in zip(rows, sign, dual, strict=True):
        w[f] += s * a * r[f]
        bias += s * a
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, s = rows[i], sign[i]
            v = r[f]
            new = _dual(square[i], s * (float(w[f] @ v) + bias), dual[i], most)
            d = s * (new - dual[i])
            w[f] += d * v
            bias += d
            moved = max(moved, abs(d))
            dual[i] = new
        if moved < 1e-3 * most:
            break
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """For each bucket its weight times its ratio, and the bias."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = sample(docs, labels, label, folds, held, per_class).mapInArrow(_sets, f"doc_id {kind}, y int, f binary").toArrow().sort_by([("doc_id", "ascending")])
    y = found.column("y").to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0
    rows = [_unpacked(x.as_buffer()) for x in found.column("f")]
    del found
    r = ratios(rows, y).astype(np.float32)
    w, bias = regress(rows, r, y)
    return (w * r).astype(np.float32), bias


def _scorer(model, bias: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            for lo, part in tokens.pieces(batch.column(1)):
                z = bias + np.array([weights[f].sum(dtype=np.float64) for f in gram_sets(part)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score): the probability of class 1 of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scorer(spark.sparkContext.broadcast(weights), bias), f"doc_id {kind}, score double")
