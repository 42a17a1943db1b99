"""Line dedup by winnowing over line hashes.

Lines are hashed. A window is a least run of lines with ``min_words`` words or more, taken
forwards from every line and backwards from every line. Winnowing selects of each window the line
with the smallest hash (the leftmost of equal ones) as its fingerprint; neighbouring windows mostly
select the same line, so there are fewer fingerprints than lines. Any two equal runs of
``min_words`` words hold the same windows, and so share a fingerprint: that is the guarantee.

The positions of a fingerprint are joined by its hash; those that occur at one place only end
here. Each other position extends its match both ways, through the windows that selected it, as far
back and as far on as such a window stands at an earlier place too. All lines of a later run that is
so reached are deleted; the first place (by doc_id, then line) stays.

So a line goes exactly if it lies in a run of ``min_words`` words or more that stands
earlier too, without overlapping itself. Positions are reduced per fingerprint, and then per window,
before they are shuffled, so a passage that a third of the documents share costs one row a task;
every later place becomes one row, never a pair of places.

Edges: a null text stays null and has no lines; an empty text has one empty line; lines are
compared byte by byte; blank lines belong to runs but are never fingerprints; rows with the
same id and text are one document, and all of them lose the same lines; null ids come first;
only doc_id and text are read, further columns pass through ``dedup_lines`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwright.llm import tokens
from inkwright.llm.shared import free_names, small_batches, written

MIN_WORDS = 30
_LAST = np.uint64(2**64 - 1)


def document_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a row's id and text; null and empty texts differ."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.concat(F.lit("="), text), F.lit("")))
    return F.unhex(F.md5(said.cast("binary")))


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all lines, in text order."""
    breaks = np.flatnonzero(data == 10)
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = offsets[1:][doc]
    same = doc[1:] == doc[:-1]
    end[:-1][same] = start[1:][same] - 1
    return start, end, doc


def least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest of values[start:end] for each pair, by doubling."""
    out = np.empty(len(start), values.dtype)
    level = np.zeros(len(start), np.int64)
    if len(start):
        level = np.frexp((end - start).astype(np.float64))[1] - 1
    held = values
    for k in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(held[start[mine]], held[end[mine] - (1 << k)])
        held = np.minimum(held[: len(held) - (1 << k)], held[1 << k :]) if len(held) > 1 << k else held
    return out


class Fingerprints(NamedTuple):
    """Selected lines (text number, line, hash) in text order, where each one's windows begin (one more
    entry), and the windows: first line, lines, hash. Lines count from the text's first."""

    doc: np.ndarray
    line: np.ndarray
    mark: np.ndarray
    at: np.ndarray
    first: np.ndarray
    lines: np.ndarray
    window: np.ndarray


def winnow(data: np.ndarray, offsets: np.ndarray, min_words: int) -> Fingerprints:
    """The fingerprints of all windows, each with the windows that select it."""
    start, end, doc = line_spans(data, offsets)
    n = len(start)
    w = tokens.words(data, offsets)
    # empty lines share a start with the line or text after them: the last line that starts at or before a word has it
    count = np.bincount(np.searchsorted(start, w.start, "right") - 1, minlength=n) if len(w.start) else np.zeros(n, np.int64)
    before = np.concatenate([[0], np.cumsum(count)])
    h = tokens.span_hash(data, start, end)
    first = np.searchsorted(doc, np.arange(len(offsets) - 1))
    last = np.concatenate([first[1:], [n]])
    at = np.arange(n)
    stop = np.searchsorted(before, before[:-1] + min_words, "left")
    forward = np.flatnonzero((stop <= last[doc]) & (count > 0))
    begin = np.searchsorted(before, before[1:] - min_words, "right") - 1
    backward = np.flatnonzero((before[1:] - min_words >= before[first[doc]]) & (begin >= first[doc]) & (count > 0))
    s = np.concatenate([at[forward], begin[backward]])
    e = np.concatenate([stop[forward], backward + 1])
    both = np.unique(s * (n + 1) + e)
    s, e = both // (n + 1), both % (n + 1)
    up, down = tokens._grown(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:n])])
    g = tokens.mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    by_hash = np.lexsort((at, np.where(count > 0, h, _LAST)))  # blank lines last
    rank = np.empty(n, np.int64)
    rank[by_hash] = at
    chosen = by_hash[least(rank, s, e)] if len(s) else s
    order = np.argsort(chosen, kind="stable")
    chosen, s, e, g = chosen[order], s[order], e[order], g[order]
    new = np.ones(len(chosen), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    one = chosen[new]
    return Fingerprints(doc[one], one - first[doc[one]], h[one], np.append(np.flatnonzero(new), len(chosen)), s - first[doc[s]], e - s, g)


def _winnowed(min_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in tokens.pieces(batch.column(2)):
                f = winnow(*tokens.flat(part), min_words)
                at = pa.array(f.doc + lo)
                each = pa.StructArray.from_arrays([pa.array(f.first, pa.int32()), pa.array(f.lines, pa.int32()), pa.array(f.window.astype(np.int64))], names=["line", "lines", "window"])
                lists = pa.ListArray.from_arrays(pa.array(f.at, pa.int32()), each)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(f.line, pa.int32()), pa.array(f.mark.astype(np.int64)), lists], names=["doc_id", "doc", "line", "mark", "windows"])

    return run


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, runs): for each document (by ``document_key``) with later repeats, its [line, lines] windows to delete."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", document_key(F.col("doc_id"), F.col("text")).alias("doc"), "text")
    found = written(keyed.mapInArrow(_winnowed(min_words), f"doc_id {kind}, doc binary, line int, mark bigint, windows array<struct<line:int,lines:int,window:bigint>>"), "fingerprints")
    places = found.groupBy("mark").agg(F.min(F.struct("doc", "line")).alias("a"), F.max(F.struct("doc", "line")).alias("b"))
    # written, so both sides of the joins come straight from an exchange and hot keys can be split
    marks = written(places.where(F.col("a") != F.col("b")).select(F.col("mark").alias("f_mark")), "marks")
    shared = found.join(marks, F.col("mark") == F.col("f_mark"), "left_semi")
    candidates = written(shared.select("doc_id", "doc", "mark", F.explode("windows").alias("w")).select("doc_id", "doc", "mark", "w.*"), "candidates")
    place = F.struct("doc_id", "doc", "line")
    first = candidates.groupBy("mark", "window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where(F.col("a") != F.col("b"))
    first = written(first.select(F.col("mark").alias("f_mark"), F.col("window").alias("f_window"), F.col("a").alias("f")), "first")
    overlaps = (F.col("doc") == F.col("f.doc")) & (F.col("line") < F.col("f.line") + F.col("lines"))
    later = candidates.join(first, (F.col("mark") == F.col("f_mark")) & (F.col("window") == F.col("f_window"))).where((place > F.col("f")) & ~overlaps)
    return later.select("doc", F.struct("line", "lines").alias("run")).groupBy("doc").agg(F.array_sort(F.collect_set("run")).alias("runs"))


def _delete(text_at: int, runs_at: int, names: list[str], said: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(text_at).to_pylist(), batch.column(runs_at).to_pylist()
            total, gone, lost = [], [], []
            for k, (text, found) in enumerate(zip(texts, runs, strict=True)):
                lines = [] if text is None else text.split("\n")
                total.append(len(lines))
                drop = np.zeros(len(lines), bool)
                for r in found or ():
                    drop[r["line"] : r["line"] + r["lines"]] = True
                gone.append(int(drop.sum()))
                lost.append(0)
                if gone[-1]:
                    lost[-1] = int(len(tokens.words(*tokens.flat(pa.array([lines[i] for i in np.flatnonzero(drop)]))).start))
                    texts[k] = "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)
            columns = [batch.column(i) if i != text_at else pa.array(texts, pa.string()) for i in range(len(names))]
            columns += [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *said])

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs taken out of ``text``, and three more columns: lines, lines
    deleted and words deleted, named by ``report_columns``."""
    key, doc, runs = free_names(docs, "_key", "_doc", "_runs")
    found = repeated_runs(docs, min_words).select(F.col("doc").alias(doc), F.col("runs").alias(runs))
    joined = docs.withColumn(key, document_key(F.col("doc_id"), F.col("text"))).join(found, F.col(key) == F.col(doc), "left").drop(key, doc)
    names, said = list(docs.columns), report_columns(docs)
    schema = joined.drop(runs).schema
    for name in said:
        schema = schema.add(name, "long")
    return joined.mapInArrow(_delete(names.index("text"), len(names), names, said), schema)


def report_columns(docs: DataFrame) -> list[str]:
    """``_lines``, ``_gone`` and ``_lost``, or longer names where ``docs`` has these."""
    return free_names(docs, "_lines", "_gone", "_lost")
