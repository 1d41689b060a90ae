"""Candidates of each rule at each byte, by window functions over (page, pos).

Run ends are running minima over descending positions, so each rule costs one
sort of the page, which all rules share.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.columns import in_bytes, in_set
from glyphmill.spec.artifact import Rule, Runtime


def _run_end(inside: Column, page: list[str]) -> Column:
    """For each byte, the place of the first byte at or after it that isn't inside; null if none is."""
    down = Window.partitionBy(*page).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.min(F.when(~inside, F.col("pos"))).over(down)


def next_stop(rows: DataFrame, stops: list[int], page: list[str]) -> DataFrame:
    """rows (page, pos, b) with the place of the first of the bytes ``stops`` at or after each; the page's size if none follows."""
    size = F.max("pos").over(Window.partitionBy(*page)) + 1
    return rows.withColumn("next_stop", F.coalesce(_run_end(~in_bytes(F.col("b"), stops), page), size))


def with_candidates(rows: DataFrame, runtime: Runtime, page: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """rows (page, pos, b) with a column len_<rule id> for each rule that needs no automaton: the candidate's length or 0."""
    up = Window.partitionBy(*page).orderBy("pos")
    size = (F.max("pos").over(Window.partitionBy(*page)) + 1).alias("size")
    rows = rows.select("*", size)
    b, pos = F.col("b"), F.col("pos")
    for r in rules or runtime.rules:
        p = r.plan
        match p["kind"]:
            case "literal":
                same = reduce(lambda x, y: x & y, (F.coalesce(F.lead("b", k).over(up) == c, F.lit(False)) if k else b == c for k, c in enumerate(p["bytes"])))
                length = F.when(same, F.lit(len(p["bytes"]))).otherwise(0)
            case "runClassRun" | "runHeadTail":
                body = in_set(b, runtime, p["bodyClassSetID" if p["kind"] == "runClassRun" else "tailClassSetID"])
                head = body if p["kind"] == "runClassRun" else in_set(b, runtime, p["headClassSetID"])
                least = p.get("minLength", 1)
                n = F.coalesce(_run_end(body, page), F.col("size")) - pos
                length = F.when(head & ~F.coalesce(F.lag(body).over(up), F.lit(False)) & (n >= least), n).otherwise(0)
            case "runPrefixed":
                body = in_set(b, runtime, p["bodyClassSetID"])
                prefix = p["prefix"]
                same = reduce(lambda x, y: x & y, (F.coalesce(F.lead("b", k).over(up) == c, F.lit(False)) if k else b == c for k, c in enumerate(prefix)))
                stop = F.lead(F.coalesce(_run_end(body, page), F.col("size")), len(prefix)).over(up)
                length = F.when(same, F.coalesce(stop, F.col("size")) - pos).otherwise(0)
            case _:
                continue
        rows = rows.withColumn(f"len_{r.id}", length.cast("int"))
    return rows


def candidates(rows: DataFrame, runtime: Runtime, page: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """page, pos, rule_id, rank, len of every candidate of the rules that need no automaton."""
    wide = with_candidates(rows, runtime, page, rules)
    fast = [r for r in rules or runtime.rules if f"len_{r.id}" in wide.columns]
    each = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.rank).alias("rank"), F.col(f"len_{r.id}").alias("len")) for r in fast))
    return wide.select(*page, "pos", F.explode(F.filter(each, lambda c: c["len"] > 0)).alias("c")).select(*page, "pos", "c.*")


def automaton_candidates(pages: DataFrame, runtime: Runtime, page: list[str], view_column: str = "page") -> DataFrame:
    """page, pos, rule_id, rank, len of the automaton rules, stepped over Arrow batches of page views."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from glyphmill.plans.arrow import _kernel
    from glyphmill.session import bounded_batches, importable
    from glyphmill.spec.artifact import canonical

    importable(pages.sparkSession)
    bounded_batches(pages.sparkSession)
    schema = StructType([pages.schema[c] for c in page] + StructType.fromDDL("pos int, rule_id int, rank int, len int").fields)
    artifact, arrow, keys = canonical(runtime.artifact), to_arrow_schema(schema), len(page)

    def run(batches):
        kernel = _kernel(artifact, True)
        for batch in batches:
            texts = [(x.as_py() or "").encode("latin-1") for x in batch.column(keys)]
            kernel.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            kernel.bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
            for r in runtime.rules:
                if r.plan["kind"] == "fallback" and len(kernel.data):
                    a, e = kernel.candidates(r)
                    own = np.searchsorted(kernel.bounds, a, side="right") - 1
                    fill = lambda v: np.full(len(a), v)
                    new = [a - kernel.bounds[own], fill(r.id), fill(r.rank), e - a]
                    columns = [batch.column(i).take(pa.array(own)) for i in range(keys)] + [pa.array(x.astype(np.int32)) for x in new]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return pages.select(*page, view_column).mapInArrow(run, schema)


def winners(found: DataFrame, page: list[str]) -> DataFrame:
    """The best candidate of each position: longest, then least rank, then least rule."""
    best = F.max(F.struct("len", (-F.col("rank")).alias("r"), (-F.col("rule_id")).alias("i"))).alias("w")
    return found.groupBy(*page, "pos").agg(best).select(
        *page, "pos", F.col("w.len").alias("len"), (-F.col("w.r")).alias("rank"), (-F.col("w.i")).alias("rule_id")
    )


def winners_by_score(found: DataFrame, page: list[str]) -> DataFrame:
    """The same by one number for each candidate: length, complement of rank, complement of rule, 16 bits each."""
    score = F.col("len").cast("long") * (1 << 32) + (65535 - F.col("rank")).cast("long") * 65536 + (65535 - F.col("rule_id"))
    best = found.withColumn("score", score).groupBy(*page, "pos").agg(F.max("score").alias("s"))
    part = lambda at: F.shiftright("s", at).bitwiseAND(F.lit(65535).cast("long")).cast("int")
    return best.select(*page, "pos", F.shiftright("s", 32).cast("int").alias("len"), (65535 - part(16)).alias("rank"), (65535 - part(0)).alias("rule_id"))


def merge_winners(fast: DataFrame, slow: DataFrame, page: list[str]) -> DataFrame:
    """Winners of two sets of rules as one: the better of each position."""
    return winners(fast.unionByName(slow), page)
