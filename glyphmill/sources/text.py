"""Texts of an Arrow column as bytes, and tables of sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.columns import fnv1a

#: Bytes that are worked on together; a longer source is a slice of its own.
SLICE = 1 << 20


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of whole values, about SLICE bytes together; null is empty."""
    kind = pa.binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.string()
    column = column.cast(kind).fill_null(b"" if kind == pa.binary() else "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + SLICE, side="right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield begin, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file_id (FNV-1a of the path), path, bytes of every file under path, bytes as they are; Spark leaves out empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(fnv1a(F.col("path")).alias("file_id"), "path", F.col("content").alias("bytes"))


def from_memory(spark: SparkSession, sources: dict[str, bytes]) -> DataFrame:
    """The same table of sources that are at hand."""
    rows = spark.createDataFrame([(p, bytearray(b)) for p, b in sources.items()], "path string, bytes binary")
    return rows.select(fnv1a(F.col("path")).alias("file_id"), "path", "bytes")
