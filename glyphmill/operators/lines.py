"""Lines of sources, and places in them.

A line ends after \\n, or after \\r that no \\n follows; offsets and columns count
bytes from 0. Each row of a table of texts is a source of its own, whatever its
ids; tables of bytes, places and line starts tell sources by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glyphmill.functions.columns import view
from glyphmill.session import bounded_batches, importable
from glyphmill.sources.text import slices

#: The number of a row, by which sources are told apart where ids may be null or repeated.
ROW = "_row"
#: After each line end.
_BREAK = r"(?<=\n)|(?<=\r)(?!\n)"


def byte_rows(df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, pos, b: a row for each byte of each text."""
    chars = df.select(*ids, F.posexplode(F.split(view(F.col(text)), "")).alias("pos", "ch")).where("ch != ''")
    return chars.select(*ids, "pos", F.ascii("ch").alias("b"))


def line_end_mask(rows: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows of bytes with ends_line."""
    after = F.coalesce(F.lead("b").over(Window.partitionBy(*ids).orderBy("pos")), F.lit(-1))
    return rows.withColumn("ends_line", (F.col("b") == 10) | ((F.col("b") == 13) & (after != 10)))


def _ends(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = batch.num_columns - 1
        for first, data, offsets in slices(batch.column(last)):
            feed = np.append(data[1:] == 10, False)
            feed[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False  # what follows is another source
            at = np.flatnonzero((data == 10) | ((data == 13) & ~feed))
            count = np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])
            ids = [batch.column(i).slice(first, len(count)) for i in range(last)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*ids, pa.array(count)], schema)], schema=schema)


def line_end_counts(df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, line_ends: the bytes of each source that end a line, by the mask over its bytes; no shuffle."""
    importable(df.sparkSession)
    bounded_batches(df.sparkSession)
    schema = StructType([df.schema[c] for c in ids] + StructType.fromDDL("line_ends long").fields)
    return df.select(*ids, text).mapInArrow(partial(_ends, schema=to_arrow_schema(schema)), schema)


def lines(df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, line, start: the line starts of each source, the last of which may be its end."""
    parts = df.select(*ids, F.monotonically_increasing_id().alias(ROW), F.split(view(F.col(text)), _BREAK, -1).alias("parts"))
    parts = parts.select(*ids, ROW, F.posexplode("parts").alias("line", "part"))
    # Only lengths are sorted, not the lines themselves.
    sizes = parts.select(*ids, ROW, "line", F.length("part").cast("long").alias("size"))
    before = Window.partitionBy(ROW).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*ids, "line", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("start"))


def line_counts(df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, line_count: no shuffle."""
    return df.select(*ids, F.size(F.split(view(F.col(text)), _BREAK, -1)).cast("long").alias("line_count"))


def locate(offsets: DataFrame, starts: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, offset, line, column of offsets in 0..byte count: an as-of join on the line starts.

    Both sides meet in one sort by (source, place), so a source with very many
    offsets or lines costs no more than its rows.
    """
    left = starts.select(*ids, F.col("start").alias("at"), F.col("line"), F.lit(None).cast("long").alias("offset"))
    right = offsets.select(*ids, F.col("offset").cast("long").alias("at"), F.lit(None).cast("int").alias("line"), F.col("offset").cast("long").alias("offset"))
    w = Window.partitionBy(*ids).orderBy("at", F.col("offset").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right)
    found = both.withColumn("l", F.last("line", True).over(w)).withColumn("s", F.max(F.when(F.col("offset").isNull(), F.col("at"))).over(w))
    return found.where("offset IS NOT NULL").select(*ids, "offset", F.col("l").alias("line"), (F.col("offset") - F.col("s")).cast("int").alias("column"))


def make_spans(spans: DataFrame, sizes: DataFrame, on: str = "doc_id") -> DataFrame:
    """spans (on, start, end) with the sources' sizes (on, size) and the error of each, null if it is valid."""
    from glyphmill.functions.columns import span_error

    both = spans.join(sizes.withColumnRenamed(on, "source"), F.col(on) == F.col("source"), "left")
    return both.select(on, "start", "end", span_error(F.col("start"), F.col("end"), F.col("size"), F.col(on), F.coalesce("source", F.lit(-1))).alias("error"))
