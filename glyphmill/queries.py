"""The queries on lexing, each over its whole tables, and the SQL that checks them.

The SQL shares nothing with the plans: candidates come from regular expressions
on each suffix, selection from a recursive query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.columns import byte_class, fnv1a, in_set, padded_rows, span_error
from glyphmill.operators import candidates as C
from glyphmill.operators import lines as L
from glyphmill.operators import paged
from glyphmill.operators import pages as P
from glyphmill.operators import select as S
from glyphmill.plans import arrow, regex, window
from glyphmill.spec.artifact import V1, load
from glyphmill.spec.builtin import KEYWORDS, OPERATORS, builtin
from glyphmill.spec.byteset import LOWER
from glyphmill.spec.compiler import compile_spec
from glyphmill.spec.dsl import Spec
from glyphmill.spec.pattern import literal, many1, one_of, times

PAGE = ["doc_id", "page_id"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Sources: the documents, and statements made of the table customer.


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


_STATEMENT = (
    "concat('let ', c_name, ' = ', c_custkey, ' // ', c_mktsegment, ' ', {nl}, 'if n', c_nationkey, '==', c_custkey,"
    " 'x->func(', c_custkey % 7, '1abc) {{ return true }} ===>@', {nl}, '  let_', c_nationkey, ' - -> /// end', {nl})"
)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("doc_id"), F.expr(_STATEMENT.format(nl="'\\n'")).alias("text")
    )


def _statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_views(statements(spark, sf_dir))


_SRC = f"src AS (SELECT c_custkey AS doc_id, {_STATEMENT.format(nl='chr(10)')} AS s FROM customer)"
_POS = (
    "pos AS (SELECT doc_id, p, CASE WHEN p = 0 THEN '' ELSE substr(s, p, 1) END AS pv, substr(s, p + 1) AS rest"
    " FROM (SELECT doc_id, s, unnest(range(0, length(s))) AS p FROM src))"
)


def _rule_sql() -> list[tuple[int, str, str]]:
    """(rule, pattern at the start of a suffix, pattern that the byte before must not match)."""
    ws = r"[ \t\r\n]"
    out = [(0, ws + "+", ws), (1, r"//[^\n]*", ""), (2, "[A-Za-z_][A-Za-z0-9_]*", "[A-Za-z0-9_]"), (3, "[0-9]+", "[0-9]")]
    escape = lambda t: "".join("\\" + c if c in "+*(){}-/=>:," else c for c in t)
    return out + [(4 + i, escape(t), "") for i, t in enumerate(OPERATORS.values())]


def _cand_sql(rules: list[int] | None = None) -> str:
    parts = []
    for rule, pattern, guard in _rule_sql():
        if rules is None or rule in rules:
            where = f" WHERE NOT regexp_matches(pv, '^{guard}$')" if guard else ""
            parts.append(f"SELECT doc_id, p, {rule} AS rule, length(regexp_extract(rest, '^(?:{pattern})')) AS len FROM pos{where}")
    return "cand AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE len > 0)"


_BEST = (
    "best AS (SELECT doc_id, p, len, rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, p ORDER BY len DESC, rule) AS r"
    " FROM cand) WHERE r = 1)"
)
_WALK = (
    "nxt AS (SELECT pos.doc_id, pos.p, coalesce(best.len, 0) AS len, best.rule FROM pos LEFT JOIN best ON best.doc_id = pos.doc_id AND best.p = pos.p),"
    " walk AS (SELECT doc_id, 0::BIGINT AS place FROM src UNION ALL SELECT w.doc_id, w.place + greatest(n.len, 1)"
    " FROM walk w JOIN nxt n ON n.doc_id = w.doc_id AND n.p = w.place),"
    " tok AS (SELECT n.doc_id, n.p, n.len, n.rule FROM walk w JOIN nxt n ON n.doc_id = w.doc_id AND n.p = w.place WHERE n.len > 0)"
)
_KINDS = ", ".join(f"('{w}', {17 + i})" for i, w in enumerate(KEYWORDS))
_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(["ws", "lineComment", "ident", "int", *OPERATORS, *KEYWORDS.values()]))
_KIND = (
    f"words AS (SELECT * FROM (VALUES {_KINDS}) AS v(word, kind)),"
    " tk AS (SELECT t.*, substr(src.s, t.p + 1, t.len) AS lexeme, coalesce(CASE WHEN t.rule = 2 THEN words.kind END, t.rule) AS kind, t.rule < 2 AS skip"
    " FROM tok t JOIN src ON src.doc_id = t.doc_id LEFT JOIN words ON words.word = substr(src.s, t.p + 1, t.len))"
)
_TOKENS = f"WITH RECURSIVE {_SRC}, {_POS}, {_cand_sql()}, {_BEST}, {_WALK}, {_KIND}"


# Lines, places, pages.

_CHARS = (
    "chars AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch),"
    " hexes AS (SELECT n, hex(encode(ch)) AS h FROM chars),"
    " bytes AS (SELECT n, substr(h, (2 * k + 1)::BIGINT, 2) AS h FROM (SELECT n, h, unnest(range(0, length(h) // 2)) AS k FROM hexes))"
)


def _class_values() -> str:
    return ", ".join(f"('{b:02X}', {c})" for b, c in enumerate(builtin().lut))


@query(
    f"WITH {_CHARS.replace('length(h) // 2', 'CAST(length(h) / 2 AS BIGINT)')}, lut AS (SELECT * FROM (VALUES {_class_values()}) AS v(h, class_id))"
    " SELECT class_id, sum(n)::BIGINT AS n FROM bytes JOIN lut ON lut.h = bytes.h GROUP BY class_id"
)
def byte_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the documents by class."""
    rows = L.byte_rows(docs(spark, sf_dir)).groupBy("b").agg(F.count("*").alias("n"))
    return rows.select(byte_class(F.col("b"), builtin()).alias("class_id"), "n").groupBy("class_id").agg(F.sum("n").alias("n"))


_OP_BYTES = ", ".join(str(b) for b in sorted(set("".join(OPERATORS.values()).encode())))


@query(
    "WITH b AS (SELECT unnest(range(0, 256)) AS b), sig AS (SELECT b, b IN (9, 10, 13, 32) AS ws, b = 10 AS nl, b BETWEEN 48 AND 57 AS digit,"
    f" b BETWEEN 65 AND 90 OR b BETWEEN 97 AND 122 OR b = 95 AS start, CASE WHEN b IN ({_OP_BYTES}) THEN b END AS op FROM b),"
    " least AS (SELECT *, min(b) OVER (PARTITION BY ws, nl, digit, start, op) AS first FROM sig)"
    " SELECT b::INTEGER AS byte, (dense_rank() OVER (ORDER BY first) - 1)::INTEGER AS class_id FROM least"
)
def byte_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each byte: bytes that no rule tells apart share one."""
    b = spark.range(256).select(F.col("id").cast("int").alias("byte"))
    return b.select("byte", byte_class(F.col("byte"), builtin()).alias("class_id"))


_LINES = (
    "parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),"
    " starts AS (SELECT doc_id, line, (sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY line) - strlen(part) - 1)::BIGINT AS start FROM parts)"
)


@query(f"WITH {_LINES} SELECT doc_id, line::INTEGER AS line, start FROM starts")
def line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line starts of the documents."""
    return L.lines(docs(spark, sf_dir))


_MIXED = "replace(replace(text, '. ', '.' || chr(13)), chr(10), chr(13) || chr(10))"
# A lone \r as \n, the pair as one of two bytes: line ends are then the \n.
_MIXED_LINES = _LINES.replace("FROM documents", "FROM mixed")
_MIXED_SQL = f"mixed AS (SELECT doc_id, replace(replace({_MIXED}, chr(13) || chr(10), '.' || chr(10)), chr(13), chr(10)) AS text FROM documents)"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with lines that end in \\r and in \\r\\n."""
    cr = F.replace(F.replace("text", F.lit(". "), F.lit(".\r")), F.lit("\n"), F.lit("\r\n"))
    return docs(spark, sf_dir).select("doc_id", cr.alias("text"))


@query(f"WITH {_MIXED_SQL}, {_MIXED_LINES} SELECT doc_id, line::INTEGER AS line, start FROM starts")
def line_starts_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line starts of the documents where lines end in \\r, \\r\\n and none."""
    return L.lines(_mixed(spark, sf_dir))


@query(f"WITH {_MIXED_SQL} SELECT doc_id, (strlen(text) - strlen(replace(text, chr(10), '')))::BIGINT AS line_ends FROM mixed")
def line_ends_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that end a line, by the mask over bytes."""
    return L.line_end_counts(_mixed(spark, sf_dir))


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS line_count FROM documents")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document."""
    return L.line_counts(docs(spark, sf_dir))


@query(
    f"WITH {_LINES}, offs AS (SELECT doc_id, (doc_id * 7919 + k * 104729) % (strlen(text) + 1) AS o"
    " FROM (SELECT doc_id, text, unnest(range(0, 5)) AS k FROM documents))"
    " SELECT o.doc_id, o.o::BIGINT AS \"offset\", max(s.line)::INTEGER AS line, (o.o - max(s.start))::INTEGER AS \"column\""
    " FROM offs o JOIN starts s ON s.doc_id = o.doc_id AND s.start <= o.o GROUP BY o.doc_id, o.o, o.k"
    .replace("AS o FROM", "AS o, k FROM")
)
def locate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of five offsets of each document."""
    size = F.octet_length("text") + 1
    d = docs(spark, sf_dir)
    o = d.select("doc_id", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    o = o.select("doc_id", ((F.col("doc_id") * 7919 + F.col("k") * 104729) % F.col("size")).alias("offset"))
    return L.locate(o, L.lines(d))


def _pages_sql(target: int, table: str = "documents", source: str = "text", key: str = "doc_id") -> str:
    return (
        f"src AS (SELECT {key} AS doc_id, {source} AS s FROM {table}),"
        " parts AS (SELECT doc_id, unnest(string_split(s, chr(10))) AS part, generate_subscripts(string_split(s, chr(10)), 1) - 1 AS line FROM src),"
        " starts AS (SELECT doc_id, line, (sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY line) - strlen(part) - 1)::BIGINT AS start FROM parts),"
        " size AS (SELECT doc_id, strlen(s)::BIGINT AS n FROM src),"
        # From each possible page start: the end.
        f" ends AS (SELECT a.doc_id, a.start, coalesce(max(CASE WHEN b.start <= a.start + {target} THEN b.start END), min(b.start), size.n) AS stop"
        " FROM starts a JOIN size ON size.doc_id = a.doc_id LEFT JOIN starts b ON b.doc_id = a.doc_id AND b.start > a.start GROUP BY a.doc_id, a.start, size.n),"
        " cut AS (SELECT doc_id, 0::BIGINT AS page_id, 0::BIGINT AS start FROM src"
        " UNION ALL SELECT c.doc_id, c.page_id + 1, e.stop FROM cut c JOIN ends e ON e.doc_id = c.doc_id AND e.start = c.start JOIN size z ON z.doc_id = c.doc_id WHERE e.stop < z.n),"
        " pages AS (SELECT c.doc_id, c.page_id, c.start, coalesce(lead(c.start) OVER (PARTITION BY c.doc_id ORDER BY c.page_id), z.n) AS stop"
        " FROM cut c JOIN size z ON z.doc_id = c.doc_id)"
    )


_BUCKET = "CASE WHEN stop - start <= 4096 THEN 4096 WHEN stop - start <= 8192 THEN 8192 WHEN stop - start <= 16384 THEN 16384 WHEN stop - start <= 32768 THEN 32768 WHEN stop - start <= 65536 THEN 65536 END"


@query(
    f"WITH RECURSIVE {_pages_sql(1024)} SELECT doc_id, page_id::INTEGER AS page_id, start, stop AS \"end\", (stop - start)::INTEGER AS byte_count,"
    " (SELECT count(*) FROM starts s WHERE s.doc_id = pages.doc_id AND s.start > pages.start AND s.start <= pages.stop)::INTEGER AS line_break_count,"
    f" stop - start > 1024 AS oversize, ({_BUCKET})::INTEGER AS bucket FROM pages"
)
def plan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of about a kilobyte of the documents."""
    return arrow.plan_pages(docs(spark, sf_dir), target_bytes=1024)


@query(f"WITH RECURSIVE {_pages_sql(32768)} SELECT ({_BUCKET})::INTEGER AS bucket, count(*)::BIGINT AS pages FROM pages GROUP BY 1")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the documents by bucket."""
    return P.bucket_histogram(arrow.plan_pages(docs(spark, sf_dir)))


@query(
    f"WITH RECURSIVE {_pages_sql(2048)} SELECT doc_id, page_id::INTEGER AS page_id, ({_BUCKET})::INTEGER AS bytes, (({_BUCKET}) - (stop - start))::INTEGER AS nulls"
    " FROM pages WHERE stop - start <= 65536"
)
def padded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the documents' pages filled up to their buckets, and how many of them fill."""
    pages = P.padded(P.page_views(docs(spark, sf_dir), target_bytes=2048)).where("bucket IS NOT NULL")
    nulls = F.length("page") - F.length(F.replace("page", F.lit("\0"), F.lit("")))
    return pages.select("doc_id", "page_id", F.length("page").alias("bytes"), nulls.alias("nulls"))


_LONG = "repeat(replace(text, chr(10), ' '), 5) || chr(10) || 'let x = 1'"


@query(
    f"WITH RECURSIVE {_pages_sql(32768, 'documents', _LONG)}"
    " SELECT doc_id, page_id::INTEGER AS page_id, 'lex-page-overflow: line exceeds maximum supported page bucket' AS message,"
    " (stop - start)::INTEGER AS page_byte_count, 65536::INTEGER AS max_bucket_size, start, stop AS \"end\" FROM pages WHERE stop - start > 65536"
)
def overflow_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no bucket holds, of documents whose lines are joined and repeated."""
    one = docs(spark, sf_dir).select("doc_id", F.concat(F.repeat(F.replace("text", F.lit("\n"), F.lit(" ")), 5), F.lit("\nlet x = 1")).alias("text"))
    return arrow.overflows(arrow.plan_pages(one))


@query(
    f"WITH RECURSIVE {_pages_sql(512, 'conversations', 'text', 'conv_id * 1000 + turn')}, lo AS (SELECT doc_id, count(*) AS c, string_agg(start::VARCHAR, ', ' ORDER BY line) AS l FROM starts GROUP BY doc_id),"
    " pl AS (SELECT p.*, (SELECT count(*) FROM starts s WHERE s.doc_id = p.doc_id AND s.start > p.start AND s.start <= p.stop) AS lb FROM pages p),"
    " pp AS (SELECT doc_id, max(stop) AS n, string_agg('  page ' || page_id || ': [' || start || ', ' || stop || ') bytes=' || (stop - start) || ' lineBreaks=' || lb"
    " || CASE WHEN stop - start > 512 THEN ' OVERSIZE' ELSE '' END || chr(10), '' ORDER BY page_id) AS d FROM pl GROUP BY doc_id)"
    " SELECT pp.doc_id, 'fileID: ' || pp.doc_id || chr(10) || 'byteCount: ' || n || chr(10) || 'lineCount: ' || c || chr(10) || 'lineStartOffsets: [' || l || ']' || chr(10)"
    " || 'pages:' || chr(10) || d AS dump FROM pp JOIN lo ON lo.doc_id = pp.doc_id"
)
def source_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text dump of size, lines and pages of each turn of the conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return P.snapshot(turns, target_bytes=512).select("doc_id", "dump")


# Candidates, winners, tokens of the statements.


def _candidate_query(name: str, rules: list[int]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paged.candidates(_statement_pages(spark, sf_dir), builtin(), PAGE, rules).select("doc_id", "pos", "rule_id", "len")

    run.__name__ = name
    query(f"WITH {_SRC}, {_POS}, {_cand_sql(rules)} SELECT doc_id, p::INTEGER AS pos, rule::INTEGER AS rule_id, len::INTEGER AS len FROM cand")(run)


_candidate_query("candidates_literal", list(range(4, 17)))
_candidate_query("candidates_class_run", [0, 3])
_candidate_query("candidates_head_tail", [2])
_candidate_query("candidates_prefixed", [1])


def automaton_runtime():
    """A specification with an automaton rule: th, up to six letters, e."""
    spec = Spec("automaton")
    spec.token("the", literal("th") + times(one_of(LOWER), 0, 6) + literal("e"))
    spec.token("word", many1(one_of(LOWER)))
    spec.token("long", literal("0123456789"))
    return load(compile_spec(spec))


@query(
    "WITH src AS (SELECT conv_id * 1000 + turn AS doc_id, text AS s FROM conversations),"
    " pos AS (SELECT doc_id, p, substr(s, p + 1, 9) AS rest, strlen(substr(s, 1, p)) AS b FROM (SELECT doc_id, s, unnest(range(0, length(s))) AS p FROM src))"
    " SELECT doc_id, b::INTEGER AS pos, length(regexp_extract(rest, '^th[a-z]{0,6}e'))::INTEGER AS len FROM pos WHERE regexp_matches(rest, '^th[a-z]{0,6}e')"
)
def candidates_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest matches of an automaton at every place of the conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    pages = P.page_views(turns)
    found = C.automaton_candidates(pages, automaton_runtime(), PAGE).join(pages.select(*PAGE, "base"), PAGE)
    return found.select("doc_id", (F.col("base") + F.col("pos")).cast("int").alias("pos"), "len")


_WINNERS = f"WITH {_SRC}, {_POS}, {_cand_sql()}, {_BEST} SELECT doc_id, p::INTEGER AS pos, len::INTEGER AS len, rule::INTEGER AS rule_id FROM best"


@query(_WINNERS)
def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate of each place."""
    return paged.winners(_statement_pages(spark, sf_dir), builtin(), PAGE).select("doc_id", "pos", "len", "rule_id")


@query(_WINNERS)
def winners_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a packed score."""
    return paged.winners(_statement_pages(spark, sf_dir), builtin(), PAGE, "score").select("doc_id", "pos", "len", "rule_id")


@query(_WINNERS)
def winners_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a merge of the winners of runs and of literals."""
    return paged.winners(_statement_pages(spark, sf_dir), builtin(), PAGE, "merged").select("doc_id", "pos", "len", "rule_id")


@query(f"{_TOKENS} SELECT doc_id, p::INTEGER AS start, (p + len)::INTEGER AS \"end\", rule::INTEGER AS rule_id FROM tok")
def greedy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens chosen from left to right."""
    return paged.tokens(_statement_pages(spark, sf_dir), builtin(), PAGE).select("doc_id", "start", "end", "rule_id")


_ALL = f"{_TOKENS} SELECT doc_id, p::BIGINT AS start, (p + len)::BIGINT AS \"end\", kind::INTEGER AS kind_id, skip, lexeme FROM tk"


@query(_ALL)
def tokens_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens with keywords, by window functions."""
    return window.tokens(statements(spark, sf_dir)).select("doc_id", "start", "end", "kind_id", "skip", "lexeme")


@query(_ALL)
def tokens_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by one regular expression."""
    return regex.tokens(statements(spark, sf_dir)).select("doc_id", "start", "end", "kind_id", "skip", "lexeme")


@query(f"{_TOKENS} SELECT doc_id, p::BIGINT AS start, (p + len)::BIGINT AS \"end\", kind::INTEGER AS kind_id, skip::INTEGER AS flags FROM tk")
def tokens_with_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens, skipped ones with flag 1."""
    return arrow.tokens(arrow.lex(statements(spark, sf_dir), options=arrow.Options(emit_skip=True))).drop("page_id")


@query(
    f"{_TOKENS}, names AS (SELECT * FROM (VALUES {_NAMES}) AS v(kind_id, kind))"
    " SELECT doc_id, p::BIGINT AS start, (p + len)::BIGINT AS \"end\", tk.kind::INTEGER AS kind_id, names.kind AS kind"
    " FROM tk JOIN names ON names.kind_id = tk.kind WHERE NOT skip"
)
def keyword_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted tokens with the names of their kinds."""
    return S.named(arrow.tokens(arrow.lex(statements(spark, sf_dir))), builtin()).select("doc_id", "start", "end", "kind_id", "kind")


_ERRORS = (
    " edges AS (SELECT doc_id, p AS start, p + len AS stop FROM tok UNION ALL SELECT doc_id, length(s), length(s) FROM src),"
    " gaps AS (SELECT doc_id, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS a, start AS b FROM edges)"
)


@query(f"{_TOKENS}, {_ERRORS} SELECT doc_id, a::BIGINT AS start, b::BIGINT AS \"end\" FROM gaps WHERE b > a")
def error_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of bytes in no token."""
    return arrow.error_spans(arrow.lex(statements(spark, sf_dir))).select("doc_id", "start", "end")


@query(f"{_TOKENS}, {_ERRORS} SELECT doc_id, a::BIGINT AS start, b::BIGINT AS \"end\" FROM gaps WHERE b > a")
def error_spans_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the relational operators."""
    found = paged.error_spans(_statement_pages(spark, sf_dir), builtin(), PAGE)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    f"{_TOKENS} SELECT src.doc_id, coalesce(sum(len), 0)::BIGINT AS covered, (length(any_value(s)) - coalesce(sum(len), 0))::BIGINT AS unknown"
    " FROM src LEFT JOIN tok ON tok.doc_id = src.doc_id GROUP BY src.doc_id"
)
def coverage_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in tokens, skipped ones too, and in none."""
    found = paged.coverage(_statement_pages(spark, sf_dir), builtin(), PAGE)
    return found.groupBy("doc_id").agg(F.sum("covered").alias("covered"), F.sum("unknown").alias("unknown"))


@query(ORACLES["coverage_bytes"])
def coverage_by_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the furthest end of earlier tokens."""
    found = paged.coverage(_statement_pages(spark, sf_dir), builtin(), PAGE, by_reach=True)
    return found.groupBy("doc_id").agg(F.sum("covered").alias("covered"), F.sum("unknown").alias("unknown"))


@query(
    f"WITH {_SRC}, {_POS}, stop AS (SELECT doc_id, p FROM pos WHERE rest[1] = chr(10))"
    " SELECT pos.doc_id, pos.p::INTEGER AS pos, min(stop.p)::INTEGER AS next_stop FROM pos JOIN stop ON stop.doc_id = pos.doc_id AND stop.p >= pos.p GROUP BY pos.doc_id, pos.p"
)
def next_line_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each byte of the statements the next line feed."""
    return paged.next_stop(_statement_pages(spark, sf_dir), [10], PAGE).select("doc_id", "pos", "next_stop")


@query(
    f"WITH {_SRC}, {_POS} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(rest, '^[A-Za-z0-9_]'))::BIGINT AS name_bytes,"
    " count(*) FILTER (WHERE regexp_matches(rest, '^[0-9]'))::BIGINT AS digit_bytes FROM pos GROUP BY doc_id"
)
def class_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the statements in the class sets of names and of digits."""
    plans = {r.name: r.plan for r in builtin().rules}
    member = lambda k, s: F.count_if(in_set(F.col("b"), builtin(), plans[k][s]))
    rows = L.byte_rows(statements(spark, sf_dir))
    return rows.groupBy("doc_id").agg(member("ident", "tailClassSetID").alias("name_bytes"), member("int", "bodyClassSetID").alias("digit_bytes"))


_PACKED = "p::BIGINT + len::BIGINT * 65536 + kind::BIGINT * 4294967296"


@query(f"{_TOKENS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INTEGER AS idx, ({_PACKED})::BIGINT AS packed FROM tk WHERE NOT skip")
def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed tokens in order."""
    pages = arrow.lex(statements(spark, sf_dir))
    return pages.select("doc_id", F.posexplode("packed").alias("idx", "packed"))


@query(f"{_TOKENS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INTEGER AS idx, ({_PACKED})::BIGINT AS packed FROM tk WHERE NOT skip")
def packed_rows_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the relational operators."""
    return window.packed(statements(spark, sf_dir)).select("doc_id", "idx", "packed")


@query(
    f"{_TOKENS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INTEGER AS idx, p::BIGINT AS start, (p + len)::BIGINT AS \"end\","
    " kind::INTEGER AS kind_id, 0::INTEGER AS flags, 0::INTEGER AS payload_a, 0::INTEGER AS payload_b FROM tk WHERE NOT skip"
)
def unpack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens unpacked again and moved to their place in the source."""
    pages = arrow.lex(statements(spark, sf_dir)).withColumnRenamed("start", "base")
    rows = pages.select("doc_id", "base", F.posexplode("packed").alias("idx", "packed"))
    return S.unpack_rows(rows, ["doc_id"], "base")


@query(f"{_TOKENS} SELECT src.doc_id, 4096::INTEGER AS capacity, count(tk.p)::BIGINT AS used FROM src LEFT JOIN tk ON tk.doc_id = src.doc_id AND NOT tk.skip GROUP BY src.doc_id")
def padded_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows filled with zeros to the bucket: their number, and how many aren't zero."""
    pages = arrow.lex(statements(spark, sf_dir)).withColumn("rows", padded_rows(F.col("packed"), F.col("bucket")))
    return pages.select("doc_id", F.size("rows").alias("capacity"), F.size(F.filter("rows", lambda x: x != 0)).cast("long").alias("used"))


@query(
    f"{_TOKENS}, {_ERRORS}, t AS (SELECT doc_id, count(*) AS n FROM tk WHERE NOT skip GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS n FROM gaps WHERE b > a GROUP BY doc_id)"
    " SELECT src.doc_id, 1::BIGINT AS page_count, length(s)::BIGINT AS total_bytes, coalesce(t.n, 0)::BIGINT AS token_count, coalesce(e.n, 0)::BIGINT AS error_span_count,"
    " 0::BIGINT AS overflow_count, '4096=1' AS buckets, 'f' || src.doc_id || '-b' || length(s) || '-p1-t' || coalesce(t.n, 0) || '-e' || coalesce(e.n, 0) || '-o0' AS trace_id"
    " FROM src LEFT JOIN t ON t.doc_id = src.doc_id LEFT JOIN e ON e.doc_id = src.doc_id"
)
def observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each source and their trace id."""
    return _observed(arrow.lex(statements(spark, sf_dir)))


def _observed(pages: DataFrame) -> DataFrame:
    found = arrow.observe(pages)
    pairs = F.transform(F.map_entries("pages_by_bucket"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return found.withColumn("buckets", F.array_join(pairs, ",")).drop("pages_by_bucket")


# Tokens of whole documents on pages of about 512 bytes, in any alphabet. The parts of a page are cut by one expression;
# a run of letters and digits that begins with a digit holds an int for each run of digits, and blanks after a comment that
# ends in blanks belong to a run that began inside it.
_PAGED = (
    f"WITH RECURSIVE {_pages_sql(512)}, words AS (SELECT * FROM (VALUES {_KINDS}) AS v(word, kind)),"
    f" ops AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {4 + i})' for i, t in enumerate(OPERATORS.values()))}) AS v(op, kind)),"
    " fit AS (SELECT * FROM pages WHERE stop - start <= 65536),"
    " whole AS (SELECT s.doc_id, s.line, s.start, q.part FROM starts s JOIN parts q ON q.doc_id = s.doc_id AND q.line = s.line),"
    " txt AS (SELECT p.doc_id, p.page_id, p.start AS base, string_agg(l.part || CASE WHEN l.start + strlen(l.part) < z.n THEN chr(10) ELSE '' END, '' ORDER BY l.line) AS s"
    " FROM fit p JOIN size z ON z.doc_id = p.doc_id JOIN whole l ON l.doc_id = p.doc_id AND l.start >= p.start AND l.start < p.stop GROUP BY p.doc_id, p.page_id, p.start),"
    r" cutup AS (SELECT doc_id, page_id, base, regexp_extract_all(s, '//[^\n]*|[ \t\r\n]+|[A-Za-z0-9_]+|->|==|(?s:.)') AS xs FROM txt),"
    " piece AS (SELECT doc_id, page_id, base, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM cutup),"
    " placed AS (SELECT doc_id, page_id, x, lag(x) OVER w AS before, (base + sum(strlen(x)) OVER w - strlen(x))::BIGINT AS p FROM piece"
    " WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY i)),"
    r" digits AS (SELECT doc_id, page_id, p, regexp_extract_all(x, '[0-9]+|[A-Za-z_]+') AS ys FROM placed WHERE regexp_matches(x, '^[0-9]')),"
    " part AS (SELECT doc_id, page_id, p, unnest(ys) AS y, generate_subscripts(ys, 1) AS j FROM digits),"
    " inner_ AS (SELECT doc_id, page_id, y AS x, (p + sum(strlen(y)) OVER (PARTITION BY doc_id, p ORDER BY j) - strlen(y))::BIGINT AS p FROM part),"
    r" both_ AS (SELECT doc_id, page_id, x, p, CASE WHEN regexp_matches(x, '^[ \t\r\n]') THEN CASE WHEN before IS NULL OR NOT regexp_matches(before, '^//([^\n]*[ \t\r])$') THEN 0 END"
    " WHEN starts_with(x, '//') THEN 1 WHEN regexp_matches(x, '^[A-Za-z_]') THEN coalesce(words.kind, 2) ELSE ops.kind END AS kind"
    " FROM placed LEFT JOIN words ON words.word = x LEFT JOIN ops ON ops.op = x WHERE NOT regexp_matches(x, '^[0-9]')"
    " UNION ALL SELECT doc_id, page_id, x, p, 3 FROM inner_ WHERE regexp_matches(x, '^[0-9]')),"
    " tk AS (SELECT doc_id, page_id, p, strlen(x) AS len, kind FROM both_ WHERE kind IS NOT NULL)"
)


@query(f"{_PAGED} SELECT doc_id, page_id::INTEGER AS page_id, p::BIGINT AS start, (p + len)::BIGINT AS \"end\", kind::INTEGER AS kind_id, (kind < 2)::INTEGER AS flags FROM tk")
def tokens_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of the documents on many pages each, at their places in the source."""
    return arrow.tokens(arrow.lex(docs(spark, sf_dir), options=arrow.Options(emit_skip=True, target_bytes=512)))


_PAGED_GAPS = (
    " edges AS (SELECT doc_id, page_id, p AS a, p + len AS b FROM tk UNION ALL SELECT doc_id, page_id, stop, stop FROM fit),"
    " gaps AS (SELECT e.doc_id, e.page_id, coalesce(lag(e.b) OVER (PARTITION BY e.doc_id, e.page_id ORDER BY e.a, e.b), f.start) AS a, e.a AS b"
    " FROM edges e JOIN fit f ON f.doc_id = e.doc_id AND f.page_id = e.page_id)"
)


@query(f"{_PAGED}, {_PAGED_GAPS} SELECT doc_id, page_id::INTEGER AS page_id, a::BIGINT AS start, b::BIGINT AS \"end\" FROM gaps WHERE b > a")
def error_spans_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of bytes in no token, page by page of the documents."""
    return arrow.error_spans(arrow.lex(docs(spark, sf_dir), options=arrow.Options(target_bytes=512)))


@query(
    f"{_PAGED}, {_PAGED_GAPS}, t AS (SELECT doc_id, count(*) AS n FROM tk WHERE kind > 1 GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS n FROM gaps WHERE b > a GROUP BY doc_id),"
    f" bk AS (SELECT doc_id, {_BUCKET} AS bucket, count(*) AS c FROM pages GROUP BY 1, 2),"
    " g AS (SELECT doc_id, sum(c)::BIGINT AS pc, coalesce(sum(c) FILTER (WHERE bucket IS NULL), 0)::BIGINT AS oc, coalesce(string_agg(bucket || '=' || c, ',' ORDER BY bucket) FILTER (WHERE bucket IS NOT NULL), '') AS buckets FROM bk GROUP BY doc_id)"
    " SELECT g.doc_id, pc AS page_count, z.n AS total_bytes, coalesce(t.n, 0)::BIGINT AS token_count, coalesce(e.n, 0)::BIGINT AS error_span_count, oc AS overflow_count, buckets,"
    " 'f' || g.doc_id || '-b' || z.n || '-p' || pc || '-t' || coalesce(t.n, 0) || '-e' || coalesce(e.n, 0) || '-o' || oc AS trace_id"
    " FROM g JOIN size z ON z.doc_id = g.doc_id LEFT JOIN t ON t.doc_id = g.doc_id LEFT JOIN e ON e.doc_id = g.doc_id"
)
def observation_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document over its pages, and its trace id."""
    return _observed(arrow.lex(docs(spark, sf_dir), options=arrow.Options(target_bytes=512)))


@query(f"{_PAGED} SELECT l.quality::INTEGER AS quality, count(*)::BIGINT AS tokens, count(DISTINCT tk.doc_id)::BIGINT AS sources FROM tk JOIN labels l ON l.doc_id = tk.doc_id WHERE kind > 1 GROUP BY l.quality")
def document_tokens_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents by their label: counts a source are joined, not tokens."""
    return _by_label(arrow.lex(docs(spark, sf_dir), options=arrow.Options(target_bytes=512)), spark, sf_dir)


_DOC_PARTS = r"'[A-Za-z0-9_]+|[ \t\r\n]+|->|==|[=+\-*/(){}:,]'"


@query(
    f"WITH part AS (SELECT unnest(regexp_extract_all(text, {_DOC_PARTS})) AS x FROM documents),"
    f" words AS (SELECT * FROM (VALUES {_KINDS}) AS v(word, kind)), names AS (SELECT * FROM (VALUES {_NAMES}) AS v(kind_id, kind)),"
    f" ops AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {4 + i})' for i, t in enumerate(OPERATORS.values()))}) AS v(op, kind)),"
    # A run of letters and digits that begins with a digit holds an int for each run of digits, and errors.
    " each AS (SELECT x, CASE WHEN regexp_matches(x, '^[A-Za-z_]') THEN coalesce(words.kind, 2) WHEN regexp_matches(x, '^[0-9]') THEN 3 ELSE ops.kind END AS kind,"
    " CASE WHEN regexp_matches(x, '^[0-9]') THEN len(regexp_extract_all(x, '[0-9]+')) ELSE 1 END AS n"
    " FROM part LEFT JOIN words ON words.word = x LEFT JOIN ops ON ops.op = x WHERE NOT regexp_matches(x, '^[ \\t\\r\\n]'))"
    " SELECT names.kind AS kind, sum(n)::BIGINT AS n FROM each JOIN names ON names.kind_id = each.kind GROUP BY names.kind"
)
def token_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents by kind."""
    found = arrow.tokens(arrow.lex(docs(spark, sf_dir))).groupBy("kind_id").agg(F.count("*").alias("n"))
    return S.named(found, builtin()).select("kind", "n")


@query(f"{_TOKENS} SELECT l.quality::INTEGER AS quality, count(*)::BIGINT AS tokens, count(DISTINCT tk.doc_id)::BIGINT AS sources FROM tk JOIN labels l ON l.doc_id = tk.doc_id WHERE NOT skip GROUP BY l.quality")
def tokens_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens joined with labels: counts a source are joined, not tokens."""
    return _by_label(arrow.lex(statements(spark, sf_dir)), spark, sf_dir)


def _by_label(pages: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pages.groupBy("doc_id").agg(F.sum("row_count").alias("n")).where("n > 0")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return counts.join(labels, "doc_id").groupBy("quality").agg(F.sum("n").alias("tokens"), F.count_distinct("doc_id").alias("sources"))


# Other functions.


@query(
    "SELECT doc_id, s AS start, e AS \"end\", CASE WHEN s < 0 OR e < 0 THEN 'negative-offset' WHEN s > e THEN 'start-after-end' WHEN e > strlen(text) THEN 'end-beyond-source' END AS error"
    " FROM (SELECT doc_id, text, doc_id % 50 - 5 AS s, (doc_id * 37) % 400 - 3 AS e FROM documents)"
)
def span_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some spans are valid, and why not."""
    start, end = F.col("doc_id") % 50 - 5, (F.col("doc_id") * 37) % 400 - 3
    error = span_error(start, end, F.octet_length("text"), F.lit(1), F.lit(1))
    return docs(spark, sf_dir).select("doc_id", start.alias("start"), end.alias("end"), error.alias("error"))


@query(
    "WITH RECURSIVE h AS (SELECT page_id, hex(encode(url)) AS u, 0 AS k, 2166136261::BIGINT AS v FROM pages"
    " UNION ALL SELECT page_id, u, k + 1, (xor(v, ('0x' || substr(u, 2 * k + 1, 2))::BIGINT) * 16777619) % 4294967296 FROM h WHERE 2 * k < length(u))"
    " SELECT page_id, v AS file_id FROM h WHERE 2 * k = length(u)"
)
def fnv1a_file_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit ids of the pages' urls."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fnv1a(F.col("url")).alias("file_id"))


@query(
    f"{_TOKENS}, {_ERRORS}, n AS (SELECT (SELECT count(*) FROM tk WHERE NOT skip)::BIGINT AS tokens, (SELECT count(*) FROM gaps WHERE b > a)::BIGINT AS error_spans)"
    f" SELECT profile, tokens, error_spans, 0::BIGINT AS differences FROM n, (VALUES ('v0'), ('{V1}')) AS v(profile)"
)
def profiles_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and errors under each profile, and pages that only it has: none, for a specification without automata."""
    d = statements(spark, sf_dir)
    columns = ["doc_id", "page_id", "packed", "error_start", "error_end"]
    each = {p: arrow.lex(d, options=arrow.Options(profile=p)).select(*columns) for p in ("v0", V1)}
    count = lambda p, q: each[p].agg(
        F.lit(p).alias("profile"), F.sum(F.size("packed")).alias("tokens"), F.sum(F.size("error_start")).alias("error_spans")
    ).join(each[p].exceptAll(each[q]).agg(F.count("*").alias("differences")), F.lit(True))  # one row each
    return count("v0", V1).unionAll(count(V1, "v0"))


@query(f"{_PAGED} SELECT count(*)::BIGINT AS tokens, 0::BIGINT AS differences FROM tk")
def plans_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents, skipped ones too, and documents on which the expression and the Arrow kernel differ: none."""
    a = regex.tokens(docs(spark, sf_dir), target_bytes=512).select("doc_id", "start", "end", "kind_id", F.col("skip").cast("int").alias("flags"))
    b = arrow.tokens(arrow.lex(docs(spark, sf_dir), options=arrow.Options(emit_skip=True, target_bytes=512))).select(*a.columns)
    # A checksum of each document's tokens instead of a comparison of all rows.
    sums = lambda df, c: df.groupBy("doc_id").agg(F.bit_xor(F.xxhash64(*df.columns)).alias(c), F.count("*").alias(c + "n"))
    both = sums(a, "x").join(sums(b, "y"), "doc_id", "full")
    return both.agg(F.sum("yn").alias("tokens"), F.count_if(~F.col("x").eqNullSafe(F.col("y")) | ~F.col("xn").eqNullSafe(F.col("yn"))).alias("differences"))


@query(
    f"{_TOKENS}, {_ERRORS}, names AS (SELECT * FROM (VALUES {_NAMES}) AS v(kind_id, kind)),"
    " t AS (SELECT tk.doc_id, count(*) AS n, string_agg('{\"endByte\":' || (p + len) || ',\"flags\":0,\"kind\":\"' || names.kind || '\",\"kindID\":' || tk.kind || ',\"startByte\":' || p || '}', ',' ORDER BY p) AS j"
    " FROM tk JOIN names ON names.kind_id = tk.kind WHERE NOT skip GROUP BY tk.doc_id),"
    " e AS (SELECT doc_id, string_agg('{\"end\":' || b || ',\"start\":' || a || '}', ',' ORDER BY a) AS j FROM gaps WHERE b > a GROUP BY doc_id)"
    " SELECT src.doc_id, '{\"errorSpans\":[' || coalesce(e.j, '') || '],\"fileID\":' || src.doc_id || ',\"overflows\":[],\"tokenCount\":' || coalesce(t.n, 0) || ',\"tokens\":[' || coalesce(t.j, '') || ']}' AS json"
    " FROM src LEFT JOIN t ON t.doc_id = src.doc_id LEFT JOIN e ON e.doc_id = src.doc_id"
)
def tokens_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's tokens and errors as one JSON value, as the command line writes them."""
    from glyphmill.sources.sinks import as_json

    return as_json(arrow.lex(statements(spark, sf_dir)), builtin())

