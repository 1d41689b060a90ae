"""Pages of sources as tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.plans.arrow import plan_pages


def page_views(df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), target_bytes: int = 32768) -> DataFrame:
    """ids, page_id, base, size, bucket, page: the bytes of each page as a view (a character a byte), null in overflow pages."""
    planned = plan_pages(df, text, ids, target_bytes, views=True)
    return planned.select(*ids, "page_id", F.col("start").alias("base"), F.col("byte_count").alias("size"), "bucket", "page")


def padded(pages: DataFrame) -> DataFrame:
    """page_views with pages filled up to their buckets with NUL."""
    return pages.withColumn("page", F.when(F.col("bucket").isNotNull(), F.rpad("page", F.col("bucket"), "\0")).otherwise(F.col("page")))


def bucket_histogram(pages: DataFrame) -> DataFrame:
    """bucket, pages of plan_pages; a null bucket is overflow."""
    return pages.groupBy("bucket").agg(F.count("*").alias("pages"))


def snapshot(df: DataFrame, text: str = "text", file_id: str = "doc_id", target_bytes: int = 32768) -> DataFrame:
    """file_id, json, dump of each source: its size, line starts and pages, as JSON and as text.

    An id names one source; rows that share one would be shown as one.
    """
    from glyphmill.operators.lines import lines

    starts = lines(df, text, (file_id,)).groupBy(file_id).agg(F.sort_array(F.collect_list("start")).alias("lineStartOffsets"))
    page = F.struct(
        F.col("page_id").alias("pageID"), "start", "end", F.col("byte_count").alias("byteCount"),
        F.col("line_break_count").alias("lineBreakCount"), "oversize",
    )
    pages = plan_pages(df, text, (file_id,), target_bytes).groupBy(file_id).agg(F.sort_array(F.collect_list(page)).alias("pages"))
    both = starts.join(pages, file_id)
    size, count = F.element_at("pages", -1)["end"], F.size("lineStartOffsets")
    line = lambda p: F.concat(
        F.format_string("  page %d: [%d, %d) bytes=%d lineBreaks=%d", p["pageID"], p["start"], p["end"], p["byteCount"], p["lineBreakCount"]),
        F.when(p["oversize"], F.lit(" OVERSIZE\n")).otherwise(F.lit("\n")),
    )
    dump = F.concat(
        F.format_string("fileID: %d\nbyteCount: %d\nlineCount: %d\nlineStartOffsets: [", F.col(file_id), size, count),
        F.array_join(F.transform("lineStartOffsets", lambda x: x.cast("string")), ", "), F.lit("]\npages:\n"),
        F.array_join(F.transform("pages", line), ""),
    )
    whole = F.struct(size.alias("byteCount"), F.col(file_id).alias("fileID"), count.alias("lineCount"), "lineStartOffsets", "pages")
    return both.select(file_id, F.to_json(whole).alias("json"), dump.alias("dump"))
