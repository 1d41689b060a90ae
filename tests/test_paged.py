"""The steps on whole pages: the definitions byte by byte, and no shuffle of rows of bytes, candidates or tokens."""

import random
import re

import pytest
from pyspark.sql import functions as F
from scalar_model import candidate
from scalar_model import lex as scalar
from scalar_model import pages as scalar_pages

from glyphmill import queries as Q
from glyphmill.operators import lines as L
from glyphmill.operators import pages as P
from glyphmill.operators import paged
from glyphmill.plans import arrow, regex, window
from glyphmill.spec.builtin import builtin

PAGE = ["doc_id", "page_id"]
PIECES = ["let", "if", " ", "//", "\n", "=", "==", "->", "-", ">", "@", "é", "1", "a", "_", "42", "{", "\r\n", "\r", "漢", "\0"]


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(11)
    return list(enumerate(["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["", None, "=" * 99, "y" * 70_000]))


@pytest.fixture(scope="module")
def views(spark, sources):
    df = spark.createDataFrame(sources, "doc_id long, text string").repartition(3)
    return P.page_views(df, target_bytes=24).cache()


@pytest.fixture(scope="module")
def cut(sources):
    """(source, page, bytes) of the pages that a bucket holds."""
    whole = [(i, k, (t or "").encode()[a:b]) for i, t in sources for k, (a, b) in enumerate(scalar_pages((t or "").encode(), 24))]
    return [x for x in whole if len(x[2]) <= 65536]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def spans(cut):
    return {(i, k): scalar(builtin(), data) for i, k, data in cut}


@pytest.mark.parametrize("by_reach", [True, False])
def test_coverage(views, cut, by_reach):
    want = [(i, k, sum(t[1] - t[0] for t in found), sum(b - a for a, b in bad)) for (i, k), (found, bad) in spans(cut).items()]
    assert rows(paged.coverage(views, builtin(), PAGE, by_reach)) == sorted(want)


@pytest.mark.parametrize("rules", [[0, 3], [2], [1]])
def test_candidates(views, cut, rules):
    few = [r for r in builtin().rules if r.id in rules]
    want = [(i, k, at, r.id, r.rank, n) for i, k, data in cut for at in range(len(data) if len(data) < 1000 else 0) for r in few if (n := candidate(builtin(), r, data, at, False))]
    assert rows(paged.candidates(views, builtin(), PAGE, rules)) == sorted(want)


def test_next_stop(views, cut):
    want = [(i, k, at, b, n if (n := data.find(b"\n", at)) >= 0 else len(data)) for i, k, data in cut for at, b in enumerate(data)]
    assert rows(paged.next_stop(views, [10], PAGE)) == sorted(want)


@pytest.mark.parametrize("form", ["order", "score", "merged"])
def test_winners(views, cut, form):
    want = []
    for i, k, data in cut:
        for at in range(len(data) if len(data) < 1000 else 0):
            found = [(-n, r.rank, r.id) for r in builtin().rules if (n := candidate(builtin(), r, data, at, False))]
            want += [(i, k, at, best[2], best[1], -best[0]) for best in [min(found, default=None)] if best]
    assert rows(paged.winners(views, builtin(), PAGE, form)) == sorted(want)


def test_error_spans(views, cut):
    want = [(i, k, a, b) for (i, k), (_, bad) in spans(cut).items() for a, b in bad]
    assert rows(paged.error_spans(views, builtin(), PAGE)) == sorted(want)


def test_tokens_and_packed_rows(spark, sources, views, cut):
    want = [(i, k, a, b, rule, data[a:b].decode("latin-1")) for i, k, data in cut for a, b, rule, _, _ in scalar(builtin(), data)[0]]
    assert rows(paged.tokens(views, builtin(), PAGE).drop("idx")) == sorted(want)
    df = spark.createDataFrame(sources, "doc_id long, text string")
    pages = arrow.lex(df, options=arrow.Options(target_bytes=24)).select(*PAGE, F.posexplode("packed").alias("idx", "packed"))
    assert rows(window.packed(df, target_bytes=24)) == rows(pages)


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("paged")
    made = spark.range(200).select(
        F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"), F.lit("BUILDING").alias("c_mktsegment"), (F.col("id") % 25).alias("c_nationkey")
    )
    made.write.parquet(f"{path}/customer.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["coverage_by_reach", "coverage_bytes", "packed_rows_window", "tokens_window", "error_spans_window", "winners", "winners_by_score", "greedy_tokens", "winners_merged", "candidates_class_run", "candidates_literal", "candidates_head_tail", "tokens_regex", "candidates_prefixed", "next_line_end"])
def test_rows_are_not_shuffled(spark, customers, name):
    """Pages are worked on where they are: no windows, and only sums of each source are dealt out."""
    plan = Q.QUERIES[name](spark, customers)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Sort", "Generate"))
    assert re.findall(r"Exchange hashpartitioning\((\w+)", plan) == ["doc_id"] * name.startswith("coverage")


def test_the_expression_reads_pages_once(spark, sources):
    df = spark.createDataFrame(sources, "doc_id long, text string")
    found = regex.tokens(df, target_bytes=24)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hash" not in plan and "RLIKE" not in plan
    want = [(i, a + x, a + y, rule) for i, t in sources for a, b in scalar_pages((t or "").encode(), 24) if b - a <= 65536 for x, y, rule, _, _ in scalar(builtin(), (t or "").encode()[a:b])[0]]
    assert rows(found.select("doc_id", "start", "end", "rule_id")) == sorted(want)


def test_line_ends(spark, sources, customers):
    texts = [*sources, (None, "a\r"), (None, "\n\r\r\n")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = [(i, len(re.findall(r"\n|\r(?!\n)", t or ""))) for i, t in texts]
    assert sorted(map(str, rows_as_they_are(L.line_end_counts(df)))) == sorted(map(str, want))
    df.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text").write.parquet(f"{customers}/documents.parquet")
    assert "Exchange" not in Q.QUERIES["line_ends_mixed"](spark, customers)._jdf.queryExecution().executedPlan().toString()


def rows_as_they_are(df):
    return [tuple(r) for r in df.collect()]
