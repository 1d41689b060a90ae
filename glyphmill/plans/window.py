"""The plan by single steps: window functions over the bytes of whole pages, then joins with the artifact's tables.

It explains and checks the others; for whole corpora use ``plans.arrow``. Each row
of df is a source of its own, so ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.columns import pack
from glyphmill.operators import paged
from glyphmill.operators.pages import page_views
from glyphmill.operators.select import remap_keywords
from glyphmill.spec.artifact import Runtime
from glyphmill.spec.builtin import builtin


def _found(df: DataFrame, text: str, ids: tuple[str, ...], runtime: Runtime | None, automata: bool, target_bytes: int) -> DataFrame:
    """ids, page_id, base, start, end (in the page), rule_id, idx, lexeme, kind_id, skip of all tokens."""
    runtime = runtime or builtin()
    pages = page_views(df, text, ids, target_bytes)
    return remap_keywords(paged.tokens(pages, runtime, [*ids, "page_id", "base"], automata), runtime)


def tokens(df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), runtime: Runtime | None = None, automata: bool = False, target_bytes: int = 32768) -> DataFrame:
    """ids, page_id, start, end (in the source), rule_id, kind_id, skip, lexeme of all tokens."""
    out = _found(df, text, ids, runtime, automata, target_bytes)
    return out.select(
        *ids, "page_id", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), "rule_id", "kind_id", "skip", "lexeme"
    )


def packed(df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), runtime: Runtime | None = None, automata: bool = False, target_bytes: int = 32768) -> DataFrame:
    """ids, page_id, idx, packed (offsets in the page) of the tokens that are kept, numbered in order on each page."""
    kept = _found(df, text, ids, runtime, automata, target_bytes).where("NOT skip")
    return kept.select(*ids, "page_id", "idx", pack(F.col("start"), F.col("end") - F.col("start"), F.col("kind_id"), F.col("skip").cast("int")).alias("packed"))
