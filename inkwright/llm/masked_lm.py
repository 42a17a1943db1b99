"""Masked pseudo-likelihood: a bidirectional window network over words.

Every word is predicted from the two words before and the two after it. Words are hashed to 2**20
buckets: 32 shapes (length, capital, last and inner characters) of 32,768 hashes each. The 3,584
most frequent buckets are outputs of their own; the others share 512 outputs, 16 to a shape, and
log P(word | neighbours) = log P(output | neighbours) + log P(bucket | output). The network has a
vector for every output at each of the four places, one tanh layer, and a softmax in three steps:
outputs are the leaves of a tree of 8, 16 and 32 branches, in the order of their frequency, and at
each node on the way down the next one is predicted. A document's score is the sum over all its words.

Everything is learned from all documents. They are written once as bucket numbers. Counts of
buckets give outputs, their first biases, and P(bucket | output). Then each of ROUNDS rounds is a
pass of all tasks over all words: a task goes on from the network broadcast to it by stochastic
gradient steps in numpy, and gives back its vectors, weighed by the words that each had a part in.
Their weighed means, summed in bundles of tasks and then of bundles, are the next network. So what
is gathered grows with the number of tasks, while the driver and each group of rows hold a fixed
number of networks (1.5 MB each).

Edges: null and empty texts have 0 words, log-probability 0 and no mean; long texts are taken
whole; a table without words gives uniform probabilities; repeated rows count each; a place before
the first or after the last word is a neighbour of its own; only doc_id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.llm import tokens
from inkwright.llm.shared import small_batches, written

SHAPES, HASHES = 32, 1 << 15
BUCKETS = SHAPES * HASHES
#: Branches of the tree's nodes, level by level.
FORKS = (8, 16, 32)
OUTPUTS = math.prod(FORKS)
SHARED = 16 * SHAPES
OWN = OUTPUTS - SHARED
EDGE = OUTPUTS  # before the first and after the last word
PLACES = (-2, -1, 1, 2)
WIDTH = 16
#: Rows of a network, each with a bias last: a vector for every neighbour at every place, then for the tree's nodes, level by level.
AT_TREE = len(PLACES) * (OUTPUTS + 1)
AT_LEVEL = [AT_TREE + sum(math.prod(FORKS[:j]) for j in range(1, k)) for k in range(1, len(FORKS) + 1)]
ROWS = AT_LEVEL[-1] + OUTPUTS
ROUNDS, STEP_WORDS, RATE = 2, 16_384, 0.2
#: Rows of a network that are summed together, and networks that one group of rows sums.
BLOCK_ROWS, BUNDLE = 1024, 64

_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every word."""
    w = tokens.words(data, offsets)
    size = w.end - w.start
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    shape = np.searchsorted([2, 4, 7], size, "left")
    if len(size):
        first, last = data[w.start], w.end - 1
        shape = shape * 2 + ((first >= 65) & (first <= 90))
        shape = shape * 2 + _LETTER[data[last]]
        shape = shape * 2 + (letters[last] - letters[w.start] < size - 1)
    return (shape * HASHES + (w.hash >> np.uint64(49)).astype(np.int64)).astype(np.int32), w.doc


def neighbours(outputs: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The outputs at PLACES around every word, within its text."""
    out = np.full((len(PLACES), len(outputs)), EDGE, np.int32)
    for k, off in enumerate(PLACES):
        here, there = (slice(off, None), slice(None, -off)) if off > 0 else (slice(None, off), slice(-off, None))
        same = doc[here] == doc[there]
        out[k, there][same] = outputs[here][same]
    return out


def outputs_of(counts: np.ndarray) -> np.ndarray:
    """The output of each bucket: the most frequent have their own (ties: the smaller bucket)."""
    at = np.arange(BUCKETS)
    out = OWN + at // HASHES * (SHARED // SHAPES) + at % (SHARED // SHAPES)
    top = np.lexsort((at, -counts))[:OWN]
    top = top[counts[top] > 0]
    out[top] = np.arange(len(top))
    return out.astype(np.int32)


def inside(counts: np.ndarray, outputs: np.ndarray) -> np.ndarray:
    """log P(bucket | output), with one added to every count."""
    more = counts + 1.0
    return np.log(more / np.bincount(outputs, more, minlength=OUTPUTS)[outputs]).astype(np.float32)


def untrained(counts: np.ndarray, outputs: np.ndarray, seed: int = 0) -> np.ndarray:
    """A network that predicts outputs by their frequency, whatever the neighbours."""
    net = np.zeros((ROWS, WIDTH + 1), np.float32)
    net[:AT_TREE, :WIDTH] = np.random.RandomState(seed).normal(0, 0.3, (AT_TREE, WIDTH))
    each = np.bincount(outputs, counts, minlength=OUTPUTS) + 1.0
    for k, at in enumerate(AT_LEVEL, 1):
        n = math.prod(FORKS[:k])
        net[at : at + n, WIDTH] = np.log(each.reshape(n, -1).sum(1) / each.sum())
    return net


def _sorted(outputs: np.ndarray) -> np.ndarray:
    """The stable order of outputs (EDGE among them); numbers of 16 bits are sorted by digits."""
    return np.argsort(outputs.astype(np.uint16), kind="stable")


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of each column: with words side by side, sums over a node's few branches run along words."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def _hidden(net: np.ndarray, around: np.ndarray) -> np.ndarray:
    """The layer's values, a column a word."""
    vectors = net[:AT_TREE].reshape(len(PLACES), OUTPUTS + 1, WIDTH + 1)
    total = vectors[0].take(around[0], axis=0)
    for k in range(1, len(PLACES)):
        total += vectors[k].take(around[k], axis=0)
    return np.tanh(total.T[:WIDTH])


def _choices(net: np.ndarray, outputs: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """The softmaxes that words in the order of their ``outputs`` take part in: the first of the rows
    chosen from, the words, the probabilities (a column a word), and each word's choice."""
    for k, first in enumerate(AT_LEVEL):
        fork, below = FORKS[k], math.prod(FORKS[k + 1 :])  # outputs under each of a node's branches
        cut = np.searchsorted(outputs, np.arange(math.prod(FORKS[:k]) + 1) * (fork * below))
        digit = outputs // below % fork
        for node in np.flatnonzero(np.diff(cut)).tolist():
            at = slice(cut[node], cut[node + 1])
            rows = net[first + node * fork : first + (node + 1) * fork]
            z = rows[:, :WIDTH] @ h[:, at]
            z += rows[:, WIDTH:]
            yield first + node * fork, at, _softmax(z), digit[at]


def log_probabilities(net: np.ndarray, outputs: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log P(output | neighbours) of every word."""
    out = np.empty(len(outputs))
    for lo in range(0, len(outputs), 1 << 15):
        order = lo + _sorted(outputs[lo : lo + (1 << 15)])
        y, said = outputs[order], np.ones(len(order))
        for _, at, p, choice in _choices(net, y, _hidden(net, around.take(order, axis=1))):
            said[at] *= np.maximum(p[choice, np.arange(len(choice))], 1e-30)
        out[order] = np.log(said)
    return out


def gradient(net: np.ndarray, outputs: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the summed -log P(output | neighbours) of words in the order of their outputs: rows that the
    words have a part in, the gradient of each, and the words."""
    n, h = len(outputs), _hidden(net, around)
    back = np.zeros_like(h)
    tree = np.zeros((ROWS - AT_TREE, WIDTH + 1), np.float32)
    shared = np.zeros(ROWS - AT_TREE, np.int64)
    for first, at, d, choice in _choices(net, outputs, h):
        d[choice, np.arange(len(choice))] -= 1
        own = slice(first - AT_TREE, first - AT_TREE + len(d))
        tree[own, :WIDTH], tree[own, WIDTH], shared[own] = d @ h[:, at].T, d.sum(1), len(choice)
        back[:, at] += net[first : first + len(d), :WIDTH].T @ d
    back *= 1 - h * h
    met = np.flatnonzero(shared)
    rows, grads, words = [AT_TREE + met], [tree[met]], [shared[met]]
    back = np.ascontiguousarray(back.T)
    for k in range(len(PLACES)):
        order = _sorted(around[k])
        cell = around[k][order]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        rows.append(k * (OUTPUTS + 1) + cell[starts])
        grads.append(np.zeros((len(starts), WIDTH + 1), np.float32))
        grads[-1][:, :WIDTH] = np.add.reduceat(back.take(order, axis=0), starts)
        words.append(np.diff(np.append(starts, n)))
    return np.concatenate(rows), np.concatenate(grads), np.concatenate(words)


class Trainer:
    """Stochastic gradient steps from a given network; each row's step shrinks with the gradients
    that it had, and goes by its mean gradient a word."""

    def __init__(self, net: np.ndarray, rate: float = RATE, seed: int = 0):
        self.net, self.rate, self.rng = net.copy(), rate, np.random.RandomState(seed)
        self.words, self.squares = np.zeros(ROWS), np.full(ROWS, 1e-6, np.float32)

    def learn(self, outputs: np.ndarray, around: np.ndarray) -> None:
        order = self.rng.permutation(len(outputs))
        for lo in range(0, len(order), STEP_WORDS):
            some = order[lo : lo + STEP_WORDS]
            some = some[_sorted(outputs[some])]
            rows, grads, words = gradient(self.net, outputs[some], around.take(some, axis=1))
            grads /= np.sqrt(words)[:, None].astype(np.float32)
            self.squares[rows] += np.einsum("ij,ij->i", grads, grads) / (WIDTH + 1)
            self.net[rows] -= self.rate * grads / np.sqrt(self.squares[rows])[:, None]
            self.words[rows] += words


class Model(NamedTuple):
    """Outputs of buckets, log P(bucket | output), and the network."""

    outputs: np.ndarray
    within: np.ndarray
    net: np.ndarray


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, part in tokens.pieces(batch.column(1)):
            bucket, doc = buckets(*tokens.flat(part))
            ends = np.cumsum(np.bincount(doc, minlength=len(part))) if len(doc) else np.zeros(len(part), np.int64)
            each = [x.astype("<i4").tobytes() for x in np.split(bucket, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array(each, pa.binary())], names=["doc_id", "words"])


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the bucket numbers of every text's words, written."""
    small_batches(docs.sparkSession)
    return written(docs.select("doc_id", "text").mapInArrow(_encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words binary"), "words")


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and text numbers of a column of encoded texts."""
    data, offsets = tokens.flat(column)
    return np.frombuffer(data.tobytes(), "<i4"), np.repeat(np.arange(len(column)), np.diff(offsets) // 4)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        counts += np.bincount(_words(batch.column(0))[0], minlength=BUCKETS)
    at = np.flatnonzero(counts)
    for k in range(0, max(1, len(at)), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000]), pa.array(counts[at[k : k + 50_000]])], names=["at", "n"])


def _learner(model, rate: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outputs_by_bucket, _, net = model.value
        task = TaskContext.get().partitionId()
        trainer = Trainer(net, rate, task)
        for batch in batches:
            for _, part in tokens.pieces(batch.column(0)):
                bucket, doc = _words(part)
                outputs = outputs_by_bucket[bucket]
                trainer.learn(outputs, neighbours(outputs, doc))
        if trainer.words.any():
            sums = np.hstack([trainer.net * trainer.words[:, None], trainer.words[:, None]])
            yield from _sums(task, (sums[k : k + BLOCK_ROWS] for k in range(0, ROWS, BLOCK_ROWS)))

    return run


def _sums(task: int, blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, block in enumerate(blocks):
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([k], pa.int32()), pa.array([block.astype("<f8").tobytes()], pa.binary())], names=["task", "block", "sums"])


def _bundle(group: pa.Table) -> pa.Table:
    some = group.sort_by("task")
    total = sum(np.frombuffer(x, "<f8") for x in some.column("sums").to_pylist())
    return pa.table({"task": [some.column("task")[0].as_py() // BUNDLE], "block": pa.array([some.column("block")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


SUMS = "task bigint, block int, sums binary"


def trained(encoded: DataFrame, model: Model, rate: float = RATE) -> np.ndarray:
    """The network after one pass of all tasks over all words; rows without words stay as they were."""
    known = encoded.sparkSession.sparkContext.broadcast(model)
    sums = written(encoded.select("words").mapInArrow(_learner(known, rate), SUMS), "networks")
    most = sums.agg(F.max("task")).first()[0]
    while most is not None and most > 0:  # bundles of tasks, then bundles of bundles
        sums = written(sums.groupBy("block", F.floor(F.col("task") / BUNDLE)).applyInArrow(_bundle, SUMS), "networks")
        most //= BUNDLE
    known.unpersist()
    net = model.net.copy()
    for row in sums.collect():
        block = np.frombuffer(row["sums"], "<f8").reshape(-1, WIDTH + 2)
        at = row["block"] * BLOCK_ROWS + np.flatnonzero(block[:, -1] > 0)
        full = block[block[:, -1] > 0]
        net[at] = full[:, :-1] / full[:, -1:]
    return net


def fit(encoded: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model learned from all words of ``encode``'s rows."""
    counts = np.zeros(BUCKETS, np.int64)
    found = encoded.select("words").mapInArrow(_count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    outputs = outputs_of(counts)
    model = Model(outputs, inside(counts, outputs), untrained(counts, outputs))
    for k in range(rounds):
        model = model._replace(net=trained(encoded, model, rate / (k + 1)))
    return model


def word_scores(bucket: np.ndarray, doc: np.ndarray, model: Model) -> np.ndarray:
    """log P(word | neighbours) of every word."""
    outputs = model.outputs[bucket]
    return log_probabilities(model.net, outputs, neighbours(outputs, doc)) + model.within[bucket]


def _scorer(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*model.value)
        for batch in batches:
            for lo, part in tokens.pieces(batch.column(1)):
                bucket, doc = _words(part)
                n = np.bincount(doc, minlength=len(part))
                total = np.bincount(doc, word_scores(bucket, doc, known), minlength=len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)], names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    return run


def score(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every encoded text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    known = encoded.sparkSession.sparkContext.broadcast(model)
    return encoded.select("doc_id", "words").mapInArrow(_scorer(known), f"doc_id {kind}, n_words bigint, log_likelihood double, mean_log_likelihood double")
