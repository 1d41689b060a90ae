"""From winners to tokens: selection, keywords, coverage, errors, transport."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.columns import kind_name, pack, unpack
from glyphmill.spec.artifact import Runtime


def greedy(won: DataFrame, page: list[str]) -> DataFrame:
    """page, start, end, rule_id of the tokens that a scan from left to right takes.

    A candidate that starts at or after all earlier ends is surely taken and opens
    an island; islands don't depend on each other, and a fold chooses inside each.
    """
    w = Window.partitionBy(*page).orderBy("pos")
    before = F.max(F.col("pos") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    sure = won.withColumn("opens", (F.coalesce(before, F.lit(0)) <= F.col("pos")).cast("int"))
    island = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island")
    groups = sure.select("*", island).groupBy(*page, "island").agg(F.sort_array(F.collect_list(F.struct("pos", "len", "rule_id"))).alias("c"))
    kind = "array<struct<pos:int,len:int,rule_id:int>>"
    start = F.struct(F.lit(0).alias("stop"), F.array().cast(kind).alias("taken"))
    step = lambda s, c: F.when(
        c["pos"] >= s["stop"], F.struct((c["pos"] + c["len"]).alias("stop"), F.concat(s["taken"], F.array(c)).alias("taken"))
    ).otherwise(s)
    taken = F.aggregate("c", start, step, lambda s: s["taken"])
    return groups.select(*page, F.explode(taken).alias("t")).select(
        *page, F.col("t.pos").alias("start"), (F.col("t.pos") + F.col("t.len")).alias("end"), F.col("t.rule_id").alias("rule_id")
    )


def with_lexemes(tokens: DataFrame, pages: DataFrame, page: list[str], view_column: str = "page") -> DataFrame:
    """tokens with the characters of their bytes."""
    cut = F.substring(view_column, F.col("start") + 1, F.col("end") - F.col("start"))
    return tokens.join(pages.select(*page, view_column), page).withColumn("lexeme", cut).drop(view_column)


def remap_keywords(tokens: DataFrame, runtime: Runtime) -> DataFrame:
    """tokens (with rule_id, lexeme) with kind_id and skip: the rule's, or the keyword's by a lookup on (rule, lexeme).

    The keywords are part of the artifact, a few rows whatever the data.
    """
    spark = tokens.sparkSession
    rules = spark.createDataFrame([(r.id, r.kind_id, r.skip) for r in runtime.rules], "rule_id int, rule_kind int, skip boolean")
    words = [(r, w.decode("latin-1"), k) for (r, w), k in runtime.keywords().items()]
    words = spark.createDataFrame(words, "rule_id int, lexeme string, word_kind int")
    out = tokens.join(F.broadcast(rules), "rule_id").join(F.broadcast(words), ["rule_id", "lexeme"], "left")
    return out.withColumn("kind_id", F.coalesce("word_kind", "rule_kind")).drop("word_kind", "rule_kind")


def coverage(rows: DataFrame, tokens: DataFrame, page: list[str]) -> DataFrame:
    """rows (page, pos) with covered: one up where a token starts, one down where it ends, summed."""
    # Tables made by explode are estimated as small as their source, so they aren't left to be broadcast.
    marks = tokens.select(*page, F.col("start").alias("pos"), F.lit(1).alias("d")).unionByName(tokens.select(*page, F.col("end").alias("pos"), F.lit(-1).alias("d")))
    marks = marks.groupBy(*page, "pos").agg(F.sum("d").alias("d"))
    open_ = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy(*page).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(marks.hint("merge"), [*page, "pos"], "left").withColumn("covered", open_ > 0).drop("d")


def coverage_by_reach(rows: DataFrame, tokens: DataFrame, page: list[str]) -> DataFrame:
    """The same by the furthest end of the tokens that start at or before each byte."""
    ends = tokens.groupBy(*page, F.col("start").alias("pos")).agg(F.max("end").alias("reach"))
    far = F.max("reach").over(Window.partitionBy(*page).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(ends.hint("merge"), [*page, "pos"], "left").withColumn("covered", F.coalesce(far > F.col("pos"), F.lit(False))).drop("reach")


def error_spans(tokens: DataFrame, sizes: DataFrame, page: list[str]) -> DataFrame:
    """page, start, end: what lies between tokens, and before the first and after the last."""
    ends = sizes.select(*page, F.col("size").alias("start"), F.col("size").alias("end"))
    w = Window.partitionBy(*page).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("end").over(w), F.lit(0))
    gaps = tokens.select(*page, "start", "end").unionByName(ends).select(*page, before.alias("from"), "start")
    return gaps.where("start > from").select(*page, F.col("from").alias("start"), F.col("start").alias("end"))


def pack_rows(tokens: DataFrame, page: list[str], emit_skip: bool = False) -> DataFrame:
    """page, idx, packed of the tokens that are kept, in order."""
    kept = tokens if emit_skip else tokens.where("NOT skip")
    idx = F.row_number().over(Window.partitionBy(*page).orderBy("start")) - 1
    packed = pack(F.col("start"), F.col("end") - F.col("start"), F.col("kind_id"), F.col("skip").cast("int"))
    return kept.select(*page, idx.alias("idx"), packed.alias("packed"))


def unpack_rows(rows: DataFrame, page: list[str], base: str | None = None) -> DataFrame:
    """page, idx, start, end, kind_id, flags, payload_a, payload_b; offsets are moved by the column base, if given."""
    t = unpack(F.col("packed"))
    start = t["start"].cast("long") + (F.col(base) if base else F.lit(0))
    return rows.select(
        *page, "idx", start.alias("start"), (start + t["length"]).alias("end"), t["kind"].alias("kind_id"), t["flags"].alias("flags"),
        F.lit(0).alias("payload_a"), F.lit(0).alias("payload_b"),
    )


def named(tokens: DataFrame, runtime: Runtime) -> DataFrame:
    """tokens with the name of kind_id."""
    return tokens.withColumn("kind", kind_name(F.col("kind_id"), runtime))
