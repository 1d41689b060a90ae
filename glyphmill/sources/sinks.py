"""Results as JSON and as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.columns import BUCKETS, OVERFLOW, kind_name, unpack
from glyphmill.spec.artifact import Runtime


def as_json(pages: DataFrame, runtime: Runtime, file_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """file_id, json: a source's tokens, error spans and overflows.

    Pages keep their tokens as arrays, so the shuffle moves a row a page.
    """
    t = lambda p: unpack(p)
    token = lambda base: lambda p: F.struct(
        (base + t(p)["start"] + t(p)["length"]).alias("endByte"), t(p)["flags"].alias("flags"), kind_name(t(p)["kind"], runtime).alias("kind"),
        t(p)["kind"].alias("kindID"), (base + t(p)["start"]).alias("startByte"),
    )
    span = lambda e: F.struct((F.col("start") + e["error_end"]).alias("end"), (F.col("start") + e["error_start"]).alias("start"))
    over = F.struct(F.lit(BUCKETS[-1]).alias("maxBucketSize"), F.lit(OVERFLOW).alias("message"), F.col("byte_count").alias("pageByteCount"))
    one = pages.select(
        file_id, *([path] if path else []),
        F.struct(
            "page_id", F.transform("packed", token(F.col("start"))).alias("tokens"), F.transform(F.arrays_zip("error_start", "error_end"), span).alias("errors"),
            F.when(F.col("bucket").isNull(), F.array(over)).otherwise(F.array().cast("array<struct<maxBucketSize:int,message:string,pageByteCount:int>>")).alias("overflows"),
        ).alias("page"),
    )
    both = one.groupBy(file_id, *([path] if path else [])).agg(F.array_sort(F.collect_list("page"), lambda a, b: a["page_id"] - b["page_id"]).alias("pages"))
    flat = lambda c: F.flatten(F.col(f"pages.{c}"))
    name = [F.col(path).alias("filePath")] if path else []
    whole = F.struct(
        flat("errors").alias("errorSpans"), F.col(file_id).alias("fileID"), *name, flat("overflows").alias("overflows"),
        F.size(flat("tokens")).alias("tokenCount"), flat("tokens").alias("tokens"),
    )
    return both.select(file_id, F.to_json(whole).alias("json"))
