"""Lexing is map-only, so a stream of sources is lexed as a table is; counts by kind keep state per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.columns import kind_name
from glyphmill.plans.arrow import Options, lex, tokens
from glyphmill.spec.artifact import Runtime
from glyphmill.spec.builtin import builtin


def lex_stream(stream: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), runtime: Runtime | None = None, options: Options | None = None) -> DataFrame:
    """A stream of lexed pages; no state, so any output mode and trigger will do."""
    return lex(stream, text, ids, runtime, options)


def kind_counts(stream: DataFrame, time: str, text: str = "text", window: str = "1 minute", late: str = "5 minutes", runtime: Runtime | None = None) -> DataFrame:
    """window_start, kind, n: tokens of each kind in each window of event time; rows later than ``late`` are left out."""
    runtime = runtime or builtin()
    pages = lex(stream.withWatermark(time, late), text, (time,), runtime)
    rows = tokens(pages, (time,)).withColumn("kind", kind_name(F.col("kind_id"), runtime))
    counts = rows.groupBy(F.window(time, window).alias("w"), "kind").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "kind", "n")
