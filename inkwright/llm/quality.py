"""Quality classifier: supervised subword embeddings.

Words, pairs of words, and 3- and 4-grams of characters (case kept) are hashed to
``2**17`` vectors. All pairs of a word with itself, next to each other or one or two words
apart, share a vector each, so repetition is seen whatever the word. A document is the mean of its n-grams' vectors; softmax over two classes;
vectors and output are learned together by stochastic gradient descent in numpy.

Scoring uses that the output is linear in the mean: the score difference of every vector is
computed once, and a document's logit is the mean of these numbers over its n-grams. The
broadcast is that array, of fixed size.

Parameters: the fit takes at most ``per_class`` labelled documents of either class, chosen by
hashed id, of ``labelled.CLASS_CHARS`` characters together; the prior of the classes is set back
to that of all labelled ids.

Edges: null and empty texts get the score of the bias alone; long texts are taken whole;
without labels of both classes every score is the prior or 0.5; repeated rows are scored each,
and a repeated id is learned from once; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.llm import tokens
from inkwright.llm.labelled import known, sample
from inkwright.llm.shared import small_batches

BUCKETS = 1 << 17
WIDTH = 8
PER_CLASS = 1500
EPOCHS = 8
#: Few documents are gone over more often, up to so many steps.
LEAST_STEPS = 10_000
RATE = 0.5
_SHIFT = np.uint64(64 - 17)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def families(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: buckets in text order, and each text's first and last-but-one place."""
    texts = len(offsets) - 1
    codes, begin = tokens.chars(data, offsets)
    code = codes.astype(np.uint64)
    for k, n in enumerate((3, 4)):
        key = np.full(max(0, len(code) - n + 1), n, np.uint64)
        for j in range(n):
            key = key * np.uint64(tokens._BASE) + code[j : j + len(key)]
        yield ((key * _ODD[k]) >> _SHIFT).astype(np.int32), begin[:-1], np.maximum(begin[:-1], begin[1:] - n + 1)
    w = tokens.words(data, offsets)
    ends = np.cumsum(np.bincount(w.doc, minlength=texts)) if len(w.doc) else np.zeros(texts, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    yield ((w.hash * _ODD[2]) >> _SHIFT).astype(np.int32), starts, ends
    for gap in (1, 2, 3):
        before, after = w.hash[:-gap], w.hash[gap:]
        pair = (before * _ODD[0] ^ after) * _ODD[3]
        pair[before == after] = _ODD[gap]  # whatever the word
        if gap > 1:
            pair[before != after] = _ODD[0]
        yield (pair >> _SHIFT).astype(np.int32), starts, np.maximum(starts, ends - gap)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, part in tokens.pieces(batch.column(1)):
            data, offsets = tokens.flat(part)
            kinds = list(families(data, offsets))
            ids, counts = [], []
            for d in range(len(part)):
                u, c = np.unique(np.concatenate([x[a[d] : b[d]] for x, a, b in kinds]), return_counts=True)
                ids.append(u.astype("<i4").tobytes())
                counts.append(c.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), batch.column(2).slice(lo, len(part)), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "y", "ids", "counts"])


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output weights and biases; ``bags``: n-grams with counts, and the class, of each document."""
    rng = np.random.RandomState(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    out, bias = np.zeros((2, width), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, counts, y = bags[k]
            eta = rate * (1 - done / steps)
            done += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= eta * np.outer(p, mean)
            bias -= eta * 0.1 * p
            vectors[ids] -= (eta / max(1e-6, float(np.sqrt(share @ share)))) * share[:, None] * back
    return vectors, out, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """A number for each bucket, and the bias: what scoring needs of the model."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample(docs, labels, label, folds, held, per_class).mapInArrow(_bags, f"doc_id {kind}, y int, ids binary, counts binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["ids"], r["counts"]))
    bags = [(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i4"), r["y"]) for r in rows if r["ids"]]
    vectors, out, bias = train(bags, epochs=max(EPOCHS, -(-LEAST_STEPS // max(1, len(bags)))))
    drawn = np.bincount([b[2] for b in bags], minlength=2) + 1.0
    there = {r["y"]: r["n"] for r in known(labels, label, folds, held).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = np.log((there.get(1, 0) + 1.0) / (there.get(0, 0) + 1.0)) - np.log(drawn[1] / drawn[0])
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0] + prior)


def logits(data: np.ndarray, offsets: np.ndarray, model: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for ids, a, b in families(data, offsets):
        sums = np.concatenate([[0.0], np.cumsum(model[ids], dtype=np.float64)])
        a, b = np.minimum(a, len(ids)), np.minimum(b, len(ids))  # the last texts may end before the last full n-gram
        total += sums[b] - sums[a]
        count += b - a
    return bias + total / np.maximum(count, 1)


def _scorer(model, bias: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            for lo, part in tokens.pieces(batch.column(1)):
                z = logits(*tokens.flat(part), table, bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score): the probability of class 1 of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scorer(spark.sparkContext.broadcast(model), bias), f"doc_id {kind}, score double")


def _keeper(model, bias: float, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, floor = model.value, np.log(least / (1 - least))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = np.concatenate([logits(*tokens.flat(part), table, bias) >= floor for _, part in tokens.pieces(texts)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep))

    return run


def kept(docs: DataFrame, model: np.ndarray, bias: float, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, in one pass over them."""
    spark = docs.sparkSession
    small_batches(spark)
    return docs.mapInArrow(_keeper(spark.sparkContext.broadcast(model), bias, least), docs.schema)
