"""The production plan: pages and tokens of whole sources in one pass over Arrow batches.

Map-only: no shuffle, no state between rows, so it runs alike on batches and
streams. A row of the result is a page with its packed tokens and error spans as
arrays; ``tokens``, ``error_spans`` and ``overflows`` turn them into rows in the
JVM. Ids are passed through, whatever they are; a null source is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glyphmill.functions.columns import BUCKETS, OVERFLOW, PACKED_LENGTH, unpack
from glyphmill.plans.kernel import Kernel, line_starts, page_cuts
from glyphmill.session import bounded_batches, importable
from glyphmill.sources.text import slices
from glyphmill.spec.artifact import V0, V1, Runtime, canonical, load
from glyphmill.spec.builtin import builtin


@dataclass(frozen=True)
class Options:
    """Whether skipped tokens are kept, the profile, bytes that a page aims at."""

    emit_skip: bool = False
    profile: str = V0
    target_bytes: int = 32768


@lru_cache(maxsize=16)
def _kernel(artifact: str, automata: bool) -> Kernel:
    return Kernel(load(artifact), automata)


PAGE = "page_id int, start long, end long, byte_count int, line_break_count int, oversize boolean, bucket int"
TOKENS = "row_count int, packed array<long>, error_start array<int>, error_end array<int>"


@dataclass
class Pages:
    """Pages of some sources: the row each belongs to, its place in it, and in the bytes of all."""

    row: np.ndarray
    number: np.ndarray
    start: np.ndarray
    size: np.ndarray
    lines: np.ndarray
    bounds: np.ndarray


def paged(data: np.ndarray, offsets: np.ndarray, target: int) -> Pages:
    row, number, start, size, lines = [], [], [], [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        starts = line_starts(data[a:b])
        ends = page_cuts(starts, b - a, target)
        begins = np.concatenate(([0], ends[:-1]))
        row.append(np.full(len(ends), i))
        number.append(np.arange(len(ends)))
        start.append(begins)
        size.append(ends - begins)
        lines.append(np.searchsorted(starts, ends, side="right") - np.searchsorted(starts, begins, side="right"))
    row, number, start, size, lines = (np.concatenate(x).astype(np.int64) for x in (row, number, start, size, lines))
    return Pages(row, number, start, size, lines, np.concatenate([offsets[row] + start, offsets[-1:]]))


def _page_columns(p: Pages, target: int) -> list[pa.Array]:
    caps = np.array(BUCKETS)
    at = np.searchsorted(caps, p.size)
    bucket = pa.array(np.append(caps, 0)[at], pa.int32(), mask=at == len(caps))
    i32 = lambda x: pa.array(x.astype(np.int32))
    return [i32(p.number), pa.array(p.start), pa.array(p.start + p.size), i32(p.size), i32(p.lines), pa.array(p.size > target), bucket]


def _lists(owner: np.ndarray, count: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def _token_columns(kernel: Kernel, data: np.ndarray, p: Pages, emit_skip: bool) -> list[pa.Array]:
    count = len(p.size)
    fits = p.size <= BUCKETS[-1]
    # Empty pages take no part: they have no place of their own among the bytes. Nor do pages that no bucket holds.
    used = np.flatnonzero(fits & (p.size > 0))
    if fits.all():
        part, begin = data, p.bounds[:-1]
    else:
        keep = np.zeros(len(data), dtype=bool)
        for a, n in zip(p.bounds[:-1][used].tolist(), p.size[used].tolist()):
            keep[a : a + n] = True
        part = data[keep]
        begin = np.zeros(count, dtype=np.int64)
        begin[used] = np.cumsum(p.size[used]) - p.size[used]
    r = kernel(part, np.append(begin[used], len(part)))
    page, error = used[r.page], used[r.error_page]
    kept = np.ones(len(page), dtype=bool) if emit_skip else ~r.skip
    page, start = page[kept], r.start[kept]
    size = np.minimum(r.end[kept] - start, PACKED_LENGTH)
    packed = (start - begin[page]) | size << 16 | r.kind[kept].astype(np.int64) << 32 | r.skip[kept].astype(np.int64) << 48
    return [
        pa.array(np.bincount(page, minlength=count).astype(np.int32)),
        _lists(page, count, packed, pa.int64()),
        _lists(error, count, r.error_start - begin[error], pa.int32()),
        _lists(error, count, r.error_end - begin[error], pa.int32()),
    ]


def _views(data: np.ndarray, p: Pages) -> pa.Array:
    """Each page's bytes, a character a byte; null where no bucket holds them."""
    cut = lambda a, n: data[a : a + n].tobytes().decode("latin-1") if n <= BUCKETS[-1] else None
    return pa.array([cut(a, n) for a, n in zip(p.bounds[:-1].tolist(), p.size.tolist())], pa.string())


def _run(
    batches: Iterator[pa.RecordBatch], schema: pa.Schema, target: int, artifact: str | None = None, automata: bool = False,
    emit_skip: bool = False, views: bool = False,
) -> Iterator[pa.RecordBatch]:
    kernel = _kernel(artifact, automata) if artifact else None
    for batch in batches:
        last = batch.num_columns - 1
        for first, data, offsets in slices(batch.column(last)):
            p = paged(data, offsets, target)
            own = pa.array(p.row + first)
            columns = [batch.column(i).take(own) for i in range(last)] + _page_columns(p, target)
            if views:
                columns.append(_views(data, p))
            if kernel:
                columns += _token_columns(kernel, data, p, emit_skip)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(df: DataFrame, ids: tuple[str, ...], more: str) -> StructType:
    return StructType([df.schema[c] for c in ids] + StructType.fromDDL(more).fields)


def plan_pages(
    df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), target_bytes: int = 32768, views: bool = False
) -> DataFrame:
    """ids and a row for each page of each source: page_id, start, end, byte_count, line_break_count, oversize, bucket.

    With views also page: the page's bytes alone, a character a byte; null where no bucket holds them.
    """
    importable(df.sparkSession)
    bounded_batches(df.sparkSession)
    schema = _schema(df, ids, PAGE + (", page string" if views else ""))
    run = partial(_run, schema=to_arrow_schema(schema), target=target_bytes, views=views)
    return df.select(*ids, text).mapInArrow(run, schema)


def lex(
    df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), runtime: Runtime | None = None, options: Options | None = None
) -> DataFrame:
    """Pages of each source with their packed tokens and error spans (offsets in the page)."""
    runtime, options = runtime or builtin(), options or Options()
    if options.target_bytes <= 0:
        raise ValueError("target_bytes must be positive")
    importable(df.sparkSession)
    bounded_batches(df.sparkSession)
    schema = _schema(df, ids, f"{PAGE}, {TOKENS}")
    run = partial(
        _run, schema=to_arrow_schema(schema), target=options.target_bytes, artifact=canonical(runtime.artifact),
        automata=options.profile == V1, emit_skip=options.emit_skip,
    )
    return df.select(*ids, text).mapInArrow(run, schema)


def tokens(pages: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, page_id, start, end (in the source), kind_id, flags (1: skipped); a row a token."""
    rows = pages.select(*ids, "page_id", F.col("start").alias("base"), F.explode("packed").alias("p"))
    t = unpack(F.col("p"))
    return rows.select(
        *ids, "page_id", (F.col("base") + t["start"]).alias("start"), (F.col("base") + t["start"] + t["length"]).alias("end"),
        t["kind"].alias("kind_id"), t["flags"].alias("flags"),
    )


def error_spans(pages: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, page_id, start, end (in the source) of the maximal runs of bytes in no token."""
    both = F.explode(F.arrays_zip("error_start", "error_end"))
    rows = pages.select(*ids, "page_id", F.col("start").alias("base"), both.alias("e"))
    return rows.select(*ids, "page_id", (F.col("base") + F.col("e.error_start")).alias("start"), (F.col("base") + F.col("e.error_end")).alias("end"))


def overflows(pages: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, page_id, message, page_byte_count, max_bucket_size, start, end of pages that no bucket holds."""
    return pages.where("bucket IS NULL").select(
        *ids, "page_id", F.lit(OVERFLOW).alias("message"), F.col("byte_count").alias("page_byte_count"),
        F.lit(BUCKETS[-1]).alias("max_bucket_size"), "start", "end",
    )


def observe(pages: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row a source: counts, pages by bucket, and a trace id of them (the last id names the source)."""
    by_bucket = pages.groupBy(*ids, "bucket").agg(
        F.count("*").alias("pages"), F.sum("byte_count").alias("bytes"), F.sum("row_count").alias("tokens"), F.sum(F.size("error_start")).alias("errors")
    )
    out = by_bucket.groupBy(*ids).agg(
        F.sum("pages").alias("page_count"), F.sum("bytes").alias("total_bytes"), F.sum("tokens").alias("token_count"),
        F.sum("errors").alias("error_span_count"),
        F.sum(F.when(F.col("bucket").isNull(), F.col("pages")).otherwise(0)).alias("overflow_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "pages"))))).alias("pages_by_bucket"),
    )
    trace = F.format_string(
        "f%s-b%d-p%d-t%d-e%d-o%d", F.col(ids[-1]).cast("string"), "total_bytes", "page_count", "token_count", "error_span_count", "overflow_count"
    )
    return out.withColumn("trace_id", trace)
