"""Frames of a multipart image feed, as a streaming source over captured feed files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkwright.session import ship

FRAME = "path string, frame int, jpeg binary"


def frames(data: bytes) -> Iterator[bytes]:
    """The bodies of all complete parts: a part is its headers, an empty line, and as many bytes as
    its Content-Length says. Lengths are of bytes, whatever the bytes are."""
    at = 0
    while m := re.compile(rb"Content-Length:\s*(\d+)", re.I).search(data, at):
        start = data.find(b"\r\n\r\n", m.end())
        end = start + 4 + int(m[1])
        if start < 0 or end > len(data):
            return
        yield data[start + 4 : end]
        at = end


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = list(frames(content or b""))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.binary())], names=["path", "frame", "jpeg"])


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of frames from feed captures as they arrive in a folder."""
    ship(spark)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return files.select("path", "content").mapInArrow(_frames, FRAME)
