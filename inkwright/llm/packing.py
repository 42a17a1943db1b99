"""Best-fit packing under conflicts.

Documents are packed into bins of ``capacity`` words. A bin holds at most one piece of a
source and of a duplicate cluster (exact copies, unless a cluster column is given): each bin
carries a bitmap of its sources and one of its clusters. Bins are kept in order of their
residual; a piece goes to the first bin from the smallest residual that holds it upwards
whose bitmaps don't meet the piece's, so to the tightest compatible bin, else to a new one.
Larger pieces go first. A document longer than a bin is cut: full bins of its own, and the
rest is packed as any other.

Packing is sequential, so documents are dealt to shards of about ``shard_docs``, packed each
on its own: by a hash of id, source, size, cluster and, as equal rows are counted first, of the
row's number among its equals. So a source, a cluster, an id or a row that comes any number of
times is spread over all shards, and a shard is bounded, whatever the table's size.

Edges: null and empty texts are pieces of 0 words; a null source or cluster is a value of its
own; ties go by id, source, cluster; repeated rows are packed each, in different bins as they
are copies; an empty table gives none; only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.llm.mixing import size_of
from inkwright.llm.shared import counted, expanded, small_batches, written

CAPACITY = 2048
SHARD_DOCS = 1024


def best_fit(rows: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int, int, int]]]:
    """For rows of (size, source, cluster), largest first, with sources and clusters numbered
    from 0: each row's pieces as (piece, start, size, bin, offset in the bin)."""
    free: list[tuple[int, int]] = []  # residual, bin
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    order = sorted((size % capacity if size else 0, k) for k, (size, _, _) in enumerate(rows))
    placed: dict[int, tuple[int, int]] = {}
    full: dict[int, list[int]] = {}
    for k, (size, source, cluster) in enumerate(rows):
        full[k] = []
        for _ in range(size // capacity):
            full[k].append(len(sources))
            sources.append(1 << source)
            clusters.append(1 << cluster)
            insort(free, (0, len(sources) - 1))
    for rest, k in sorted(order, key=lambda x: (-x[0], x[1])):
        size, source, cluster = rows[k]
        if size and not rest:
            continue
        a, b = 1 << source, 1 << cluster
        at = bisect_left(free, (rest, -1))
        while at < len(free) and (sources[free[at][1]] & a or clusters[free[at][1]] & b):
            at += 1
        if at < len(free):
            left, bin_ = free.pop(at)
        else:
            left, bin_ = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed[k] = (bin_, capacity - left)
        sources[bin_] |= a
        clusters[bin_] |= b
        insort(free, (left - rest, bin_))
    for k, (size, _, _) in enumerate(rows):
        pieces = [(i, i * capacity, capacity, bin_, 0) for i, bin_ in enumerate(full[k])]
        if k in placed:
            n = len(pieces)
            pieces.append((n, n * capacity, size - n * capacity, *placed[k]))
        out.append(pieces)
    return out


def _packer(capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def packed() -> pa.RecordBatch:
            number = ({}, {})
            keyed = [(size, number[0].setdefault(source, len(number[0])), number[1].setdefault(cluster, len(number[1]))) for _, size, source, cluster in rows]
            flat = [(rows[k][0], *p) for k, pieces in enumerate(best_fit(keyed, capacity)) for p in pieces]
            doc, piece, start, size, bin_, offset = zip(*flat, strict=True)
            kinds = [batch.schema.field(1).type] + [pa.int64()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((doc, piece, start, size, [(shard << 32) + b for b in bin_], offset), kinds, strict=True)], names=["doc_id", "piece", "start", "size", "bin", "offset"])

        for batch in batches:
            for s, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if s != shard and rows:
                    yield packed()
                    rows = []
                shard = s
                rows.append(tuple(row))
        if rows:
            yield packed()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, cluster: str | None = None) -> DataFrame:
    """(doc_id, piece, start, size, bin, offset): each document's words from ``start`` on lie at
    ``offset`` of a bin. A bin's number holds its shard in the upper half."""
    small_batches(docs.sparkSession)
    copies = F.col(cluster) if cluster else F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    sized = written(counted(docs.select("doc_id", size_of(F.col("text")).alias("size"), "source", copies.alias("cluster"))), "sizes")
    shards = max(1, -(-(sized.agg(F.sum("rows")).first()[0] or 0) // shard_docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = [F.col(c).cast("string") for c in ("doc_id", "source", "size", "cluster")]
    dealt = expanded(sized, "rows", "turn").select(F.pmod(F.xxhash64(*row, "turn", F.lit(4)), F.lit(shards)).alias("shard"), "doc_id", "size", "source", "cluster")
    return (
        dealt.repartition("shard")
        .sortWithinPartitions("shard", F.col("size").desc(), "doc_id", "source", "cluster")
        .mapInArrow(_packer(capacity), f"doc_id {kind}, piece bigint, start bigint, size bigint, bin bigint, offset bigint")
    )
