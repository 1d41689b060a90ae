import json
import random

import pytest
from pyspark.sql import functions as F
from scalar_model import lex as scalar
from scalar_model import pages as scalar_pages

from glyphmill.functions import columns as X
from glyphmill.operators import candidates as C
from glyphmill.operators import lines as L
from glyphmill.operators import pages as P
from glyphmill.operators import select as S
from glyphmill.plans import arrow, regex, window
from glyphmill.spec.artifact import V1, load
from glyphmill.spec.builtin import builtin
from glyphmill.spec.byteset import LOWER
from glyphmill.spec.compiler import Options, compile_spec
from glyphmill.spec.dsl import Spec
from glyphmill.spec.pattern import alt, literal, many1, one_of, times

PIECES = ["let", "if", " ", "//", "\n", "=", "==", "->", "-", ">", "@", "é", "1", "a", "_", "42", "{", "\r\n", "\r", "漢", "\0"]


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    return [(i, t) for i, t in enumerate([*texts, "", None, "let x = 1\n" * 300])]


@pytest.fixture(scope="module")
def table(spark, sources):
    # An extra column with a clashing name is not read.
    return spark.createDataFrame([(i, t, 1) for i, t in sources], "doc_id long, text string, start int")


def expected(sources, target, runtime=None, automata=False):
    tokens, errors = [], []
    for i, t in sources:
        data = (t or "").encode()
        for k, (a, b) in enumerate(scalar_pages(data, target)):
            found, bad = scalar(runtime or builtin(), data[a:b], automata)
            tokens += [(i, k, a + x, a + y, kind, int(skip)) for x, y, _, kind, skip in found]
            errors += [(i, k, a + x, a + y) for x, y in bad]
    return sorted(tokens), sorted(errors)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("target", [16, 32768])
def test_arrow_plan(table, sources, target):
    tokens, errors = expected(sources, target)
    pages = arrow.lex(table, options=arrow.Options(emit_skip=True, target_bytes=target))
    assert rows(arrow.tokens(pages)) == tokens and rows(arrow.error_spans(pages)) == errors
    kept = arrow.lex(table, options=arrow.Options(target_bytes=target))
    assert rows(arrow.tokens(kept)) == [t for t in tokens if not t[5]]
    # Skipped tokens cover their bytes all the same.
    assert rows(arrow.error_spans(kept)) == errors


def test_plans_agree(table, sources):
    tokens, _ = expected(sources, 24)
    cols = ["doc_id", "page_id", "start", "end", "kind_id", F.col("skip").cast("int")]
    assert rows(window.tokens(table, target_bytes=24).select(*cols)) == tokens
    assert rows(regex.tokens(table, target_bytes=24).select(*cols)) == tokens


def test_automata_in_the_plans(spark):
    s = Spec("a")
    s.token("the", literal("th") + times(one_of(LOWER), 0, 4) + literal("e"))
    s.token("word", many1(one_of(LOWER)))
    s.token("pair", alt(literal("aa"), literal("bb")))
    runtime = load(compile_spec(s, Options(window_bytes=1)))
    src = [(1, "the thee thorne there aabb"), (2, "aa"), (3, "")]
    df = spark.createDataFrame(src, "doc_id long, text string")
    tokens, errors = expected(src, 32768, runtime, True)
    pages = arrow.lex(df, runtime=runtime, options=arrow.Options(profile=V1))
    assert rows(arrow.tokens(pages)) == tokens and rows(arrow.error_spans(pages)) == errors
    found = window.tokens(df, runtime=runtime, automata=True).select("doc_id", "page_id", "start", "end", "kind_id", F.col("skip").cast("int"))
    assert rows(found) == tokens
    with pytest.raises(regex.NotOrdered):
        regex.tokens(df, runtime=runtime)


def test_order_of_alternatives():
    s = Spec("a")
    s.token("slashes", literal("//"))
    s.token("comment", literal("//") + times(one_of(LOWER), 0, 0) + literal(""))
    s2 = Spec("b")
    s2.token("a", literal("a"))
    s2.token("word", many1(one_of(LOWER)))
    with pytest.raises(regex.NotOrdered, match="begin alike"):
        regex.compile_rules(load(compile_spec(s2)))
    order = [r.name for r, _ in regex.compile_rules(builtin())]
    assert order.index("lineComment") < order.index("slash") and order.index("arrow") < order.index("minus") and order.index("eqEq") < order.index("eq")


def test_overflow(spark):
    df = spark.createDataFrame([(1, "a" * 70000), (2, "a" * 40000), (3, "b\n" + "a" * 70000 + "\nc")], "doc_id long, text string")
    pages = arrow.lex(df)
    got = {(r["doc_id"], r["page_id"]): (r["bucket"], r["oversize"], r["row_count"], len(r["error_start"])) for r in pages.collect()}
    assert got == {(1, 0): (None, True, 0, 0), (2, 0): (65536, True, 1, 0), (3, 0): (4096, False, 1, 0), (3, 1): (None, True, 0, 0), (3, 2): (4096, False, 1, 0)}
    over = {(r["doc_id"], r["page_id"]): (r["message"], r["page_byte_count"], r["max_bucket_size"], r["start"], r["end"]) for r in arrow.overflows(pages).collect()}
    text = "lex-page-overflow: line exceeds maximum supported page bucket"
    assert over == {(1, 0): (text, 70000, 65536, 0, 70000), (3, 1): (text, 70001, 65536, 2, 70003)}
    seen = {r["doc_id"]: (r["trace_id"], r["pages_by_bucket"]) for r in arrow.observe(pages).collect()}
    assert seen[3] == ("f3-b70004-p3-t2-e0-o1", {4096: 2}) and seen[1] == ("f1-b70000-p1-t0-e0-o1", {})


def test_empty_table_and_binary(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert arrow.lex(none).count() == window.tokens(none).count() == L.lines(none).count() == 0
    raw = spark.createDataFrame([("x", bytearray(b"a\xff\r1"))], "name string, data binary")
    pages = arrow.lex(raw, "data", ("name",))
    assert rows(arrow.tokens(pages, ("name",))) == [("x", 0, 0, 1, 2, 0), ("x", 1, 3, 4, 3, 0)] and rows(arrow.error_spans(pages, ("name",))) == [("x", 0, 1, 2)]
    with pytest.raises(ValueError):
        arrow.lex(none, options=arrow.Options(target_bytes=0))


def test_no_shuffle_and_column_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "let", 2.0)], "doc_id long, text string, more double").write.parquet(path)
    plan = arrow.tokens(arrow.lex(spark.read.parquet(path)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "more" not in plan


def test_lines_and_places(spark, sources, table):
    for i, t in sources[:40]:
        data = (t or "").encode()
        want = [0] + [k + 1 for k, b in enumerate(data) if b == 10 or (b == 13 and data[k + 1 : k + 2] != b"\n")]
        if i == 0:
            got = {}
            for r in L.lines(table).collect():
                got.setdefault(r["doc_id"], []).append((r["line"], r["start"]))
        assert [s for _, s in sorted(got[i])] == want
    d = spark.createDataFrame([(1, "ab\ncd\r\ne"), (2, "")], "doc_id long, text string")
    o = spark.createDataFrame([(1, x) for x in range(9)] + [(1, 3), (2, 0)], "doc_id long, offset long")
    want = [(1, x, 0, x) for x in range(3)] + [(1, 3, 1, 0)] * 2 + [(1, x, 1, x - 3) for x in range(4, 7)] + [(1, 7, 2, 0), (1, 8, 2, 1), (2, 0, 0, 0)]
    assert rows(L.locate(o, L.lines(d))) == sorted(want)
    assert {r["doc_id"]: r["line_count"] for r in L.line_counts(d).collect()} == {1: 3, 2: 1}
    ends = [r["pos"] for r in L.line_end_mask(L.byte_rows(d)).where("ends_line").collect()]
    assert sorted(ends) == [2, 6]


def test_spans(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, -1, 2), (1, 4, 3), (1, 0, 6), (9, 0, 1)], "doc_id long, start long, end long")
    sizes = spark.createDataFrame([(1, 5)], "doc_id long, size long")
    got = [r["error"] for r in L.make_spans(spans, sizes).orderBy("doc_id", "start", "end").collect()]
    assert got == ["negative-offset", None, "end-beyond-source", "start-after-end", "file-mismatch"]


def test_snapshot(spark):
    d = spark.createDataFrame([(1, "abc\ndef\nghi"), (2, "")], "doc_id long, text string")
    one, two = P.snapshot(d, target_bytes=8).orderBy("doc_id").collect()
    snap = json.loads(one["json"])
    assert (snap["byteCount"], snap["lineCount"], snap["lineStartOffsets"]) == (11, 3, [0, 4, 8])
    assert [(p["start"], p["end"]) for p in snap["pages"]] == [(0, 8), (8, 11)]
    assert json.loads(two["json"]) == {
        "byteCount": 0, "fileID": 2, "lineCount": 1, "lineStartOffsets": [0],
        "pages": [{"byteCount": 0, "end": 0, "lineBreakCount": 0, "oversize": False, "pageID": 0, "start": 0}],
    }
    assert one["dump"] == (
        "fileID: 1\nbyteCount: 11\nlineCount: 3\nlineStartOffsets: [0, 4, 8]\npages:\n"
        "  page 0: [0, 8) bytes=8 lineBreaks=2\n  page 1: [8, 11) bytes=3 lineBreaks=0\n"
    )
    assert "OVERSIZE" in P.snapshot(d, target_bytes=2).orderBy("doc_id").first()["dump"]


def test_packing_and_columns(spark):
    df = spark.createDataFrame([(0, 1, 2, 0), (65535, 65535, 65535, 255), (7, 70000, 3, 1)], "s int, n int, k int, f int")
    out = df.select(X.pack(*(F.col(c) for c in "snkf")).alias("p")).select("p", *(v.alias(k) for k, v in X.unpack(F.col("p")).items()))
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 1, 2, 0), (65535, 65535, 65535, 255), (7, 65535, 3, 1)]
    one = spark.createDataFrame([("a/b", bytearray(b"\xff"), None)], "t string, b binary, n string")
    r = one.select(X.fnv1a(F.col("t")), X.fnv1a(F.lit("")), X.binary_view(F.col("b")), X.view(F.col("n"))).first()
    h = 2166136261
    for c in b"a/b":
        h = (h ^ c) * 16777619 % 2**32
    assert tuple(r) == (h, 2166136261, "ÿ", "")
    sizes = spark.createDataFrame([(n,) for n in (0, 4096, 4097, 65536, 65537)], "n int").select(X.bucket_of(F.col("n"))).collect()
    assert [x[0] for x in sizes] == [4096, 4096, 8192, 65536, None]
    b = spark.range(256).select("id", X.byte_class(F.col("id"), builtin()).alias("c"), X.in_set(F.col("id"), builtin(), 10).alias("m")).collect()
    assert all(x["c"] == builtin().lut[x["id"]] and x["m"] == (x["id"] in builtin().bytes_of_set(10)) for x in b)
    padded = spark.range(1).select(X.padded_rows(F.array(F.lit(5).cast("long")), F.lit(3))).first()[0]
    assert padded == [5, 0, 0]
    names = spark.range(18, 20).select(X.kind_name(F.col("id"), builtin()), X.kind_name(F.lit(999), builtin())).collect()
    assert [tuple(x) for x in names] == [("kwLet", "<unknown>"), ("kwReturn", "<unknown>")]


def test_winner_forms_agree(table):
    page = ["doc_id", "page_id"]
    pages = P.page_views(table)
    byte_rows = pages.select(*page, F.posexplode(F.split("page", "")).alias("pos", "ch")).where("ch != ''").select(*page, "pos", F.ascii("ch").alias("b"))
    found = C.candidates(byte_rows, builtin(), page).cache()
    cols = [*page, "pos", "len", "rank", "rule_id"]
    best = rows(C.winners(found, page).select(*cols))
    assert best == rows(C.winners_by_score(found, page).select(*cols))
    parts = [C.winners(found.where(c), page).select(*cols) for c in ("rule_id % 2 = 0", "rule_id % 2 = 1")]
    assert best == rows(C.merge_winners(*parts, page).select(*cols))
    chosen = S.greedy(C.winners(found, page), page)
    covered = S.coverage(byte_rows, chosen, page).where("covered").count()
    assert covered == chosen.agg(F.sum(F.col("end") - F.col("start"))).first()[0]
    assert P.padded(pages).where("length(page) != bucket").count() == 0


def test_profiles_agree_without_automata(spark):
    samples = ["", "func add(x: int) -> int { return x + 1 }", "let x = 42 // comment", "if true { return false } else { return true }"]
    df = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    one, two = (rows(arrow.tokens(arrow.lex(df, options=arrow.Options(profile=p)))) for p in ("v0", V1))
    assert one == two and len(one) > 20


def test_null_and_repeated_ids_are_sources_of_their_own(spark):
    data = [(1, "let x = 1abc\n// é\nif"), (1, "let x = 1abc\n// é\nif"), (1, "a==b"), (None, "x->y\r\n"), (None, "x->y\r\n"), (None, None), (2, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3).sortWithinPartitions("doc_id", "text")
    cols = ["doc_id", "page_id", "start", "end", "kind_id"]
    text = lambda found: sorted(str(tuple(r)) for r in found.select(*cols).collect())
    want = text(arrow.tokens(arrow.lex(df, options=arrow.Options(emit_skip=True, target_bytes=8))))
    assert text(window.tokens(df, target_bytes=8)) == want and text(regex.tokens(df, target_bytes=8)) == want and len(want) > 30
    starts = sorted(str(tuple(r)) for r in L.lines(df).collect())
    assert starts == sorted(str(r) for i, t in data for r in [(i, 0, 0)] + ([(i, 1, 13), (i, 2, 19)] if t and "let" in t else [(i, 1, 6)] if t and "\r" in t else []))


def test_a_long_source_is_cut_into_pages_alone(spark):
    """Each page carries its own bytes, not the source's: 24 MB in 733 pages, and a line that no bucket holds."""
    df = spark.createDataFrame([(1, 0)], "doc_id long, start int").withColumn("text", F.repeat(F.lit("let name = 12345 + é // x\n"), 24_000_000 // 27))
    got = P.page_views(df).agg(F.count("*"), F.sum(F.length("page")), F.max("size"), F.sum("size")).first()
    assert got[1] == got[3] == 27 * (24_000_000 // 27) and got[2] <= 32768 and got[0] >= 733
    assert regex.tokens(df).groupBy("doc_id").count().first()["count"] == 13 * (24_000_000 // 27)
    line = df.withColumn("text", F.repeat(F.lit("x"), 70_000))
    assert [tuple(r) for r in P.page_views(line).select("size", "bucket", "page").collect()] == [(70_000, None, None)]
