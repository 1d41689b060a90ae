"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation once for each turn that it grew by. A hash is
rolled over each conversation's turns, so that every prefix has one: the exclusive
or of hashes of (position, turn). A conversation whose full hash is a proper prefix
hash of another is dropped by an anti-join; of equal ones the smallest conv_id
stays. What is left is rendered.

Positions and rolled hashes don't need a conversation in one task: rows (without
texts) are range partitioned by conversation and turn, numbered and rolled within
each range, and carried on by the ranges' totals. Rendered text comes in segments
of at most SEGMENT turns, so no row grows with a conversation of any length.

Row rules: rows equal in all four columns count once. Turns are ordered by turn
(null first), then by the hash of role and text. Rows with a null conv_id are one
conversation, which stays if no conversation with an id is equal or longer. Null
role renders as ``unknown``, null text as empty, and both differ from empty when
conversations are compared. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize

#: Most turns in a row of the result.
SEGMENT = 500


def _hash(seed: int) -> Column:
    return F.xxhash64(
        F.lit(seed), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()
    )


def _rolled(turns: DataFrame) -> DataFrame:
    """conv_id, turn, h1, h2, pos, r1, r2: each turn's position from 1 and the hashes of the prefix it ends."""
    order = ["turn", "h1", "h2"]
    rows = turns.select("conv_id", "turn", "h1", "h2").distinct().repartitionByRange("conv_id", *order)
    rows = materialize(rows.withColumn("part", F.spark_partition_id()), "turns")
    here = Window.partitionBy("conv_id", "part").orderBy(*order)
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c")
    local = rows.withColumn("at", F.row_number().over(here))
    placed = _with(local, counts, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("at"))
    mixed = placed.select("conv_id", "part", *order, "pos", F.xxhash64("pos", "h1", "h2").alias("x1"), F.xxhash64(F.lit(1), "pos", "h1", "h2").alias("x2"))
    mixed = materialize(mixed, "placed")
    totals = mixed.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    totals = totals.select("conv_id", "part", *(F.coalesce(F.bit_xor(f"t{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in (1, 2)))
    prefix = here.rowsBetween(Window.unboundedPreceding, 0)
    rolled = mixed.select("*", *(F.bit_xor(f"x{k}").over(prefix).alias(f"l{k}") for k in (1, 2)))
    rolled = _with(rolled, totals, ["conv_id", "part"])
    return rolled.select("conv_id", *order, "pos", *(F.col(f"b{k}").bitwiseXOR(F.col(f"l{k}")).alias(f"r{k}") for k in (1, 2)))


def _with(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which nulls are equal; the right side's keys go."""
    right = right.select(*(F.col(c).alias(f"right_{c}") if c in on else F.col(c) for c in right.columns))
    found = left.join(right, [F.col(c).eqNullSafe(F.col(f"right_{c}")) for c in on])
    return found.drop(*(f"right_{c}" for c in on))


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, n: the conversations that stay and their numbers of turns."""
    ends = rolled.groupBy("conv_id").agg(F.max(F.struct("pos", "r1", "r2")).alias("e")).select("conv_id", "e.*")
    # Of equal conversations one; prefixes are looked up once for each distinct conversation.
    once = ends.groupBy("pos", "r1", "r2").agg(F.min("conv_id").alias("conv_id"))
    inner = _with(rolled.select("conv_id", "pos", "r1", "r2"), ends.select("conv_id", F.col("pos").alias("n")), ["conv_id"])
    prefixes = inner.where("pos < n").select("pos", "r1", "r2").distinct()
    return once.join(prefixes, ["pos", "r1", "r2"], "left_anti").select("conv_id", F.col("pos").alias("n"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns, total_turns, chat of the maximal conversations."""
    turns = conversations.select("conv_id", "turn", "role", "text", _hash(0).alias("h1"), _hash(1).alias("h2"))
    rolled = materialize(_rolled(turns), "rolled")
    kept = materialize(maximal(rolled), "kept")
    places = _with(rolled.select("conv_id", "turn", "h1", "h2", "pos"), kept, ["conv_id"])
    texts = _with(turns, places, ["conv_id", "turn", "h1", "h2"])
    piece = F.struct("pos", render(F.col("role"), F.col("text")).alias("piece"))
    # A set: rows that were logged twice are one turn. At most SEGMENT pieces a group.
    segments = texts.groupBy("conv_id", F.floor((F.col("pos") - 1) / SEGMENT).alias("segment")).agg(
        F.sort_array(F.collect_set(piece)).alias("pieces"), F.max("n").alias("total_turns")
    )
    return segments.select(
        "conv_id", "segment", F.size("pieces").cast("long").alias("n_turns"), "total_turns",
        F.array_join(F.col("pieces.piece"), "").alias("chat"),
    )


#: DuckDB SQL for collapse_and_render over the table conversations: prefixes are compared by all their text.
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), p AS (
  SELECT conv_id, pos, string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), ends AS (
  SELECT min(conv_id) AS conv_id, pos AS n, prefix FROM p WHERE pos = n GROUP BY pos, prefix
), kept AS (
  SELECT conv_id, n FROM ends WHERE NOT EXISTS (
    SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = ends.n AND p.prefix = ends.prefix)
)
SELECT t.conv_id, CAST(floor((t.pos - 1) / {SEGMENT}) AS BIGINT) AS segment, count(*)::BIGINT AS n_turns,
       max(kept.n)::BIGINT AS total_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS chat
FROM t JOIN kept ON t.conv_id = kept.conv_id
GROUP BY 1, 2
"""
