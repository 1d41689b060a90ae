"""The plan by one regular expression, where order of alternatives can stand for longest match.

Java tries alternatives in order, not by length. ``compile_rules`` orders the rules
so that the first that matches is the longest, of equal lengths the one of least
rank, or raises if it can't prove such an order:

* literals: longer ones first;
* a prefixed rule before literals that aren't longer than its prefix; a literal
  equal to the prefix must have the larger rank;
* all others must not begin with the same byte.

A last alternative takes one byte of what no rule matches. Each row is a source of
its own, so ids may be null or repeated. Pages are read by Python's expressions where
they are (possessive repeats: Python 3.11 or later): no lexeme is sorted or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glyphmill.operators.pages import page_views
from glyphmill.operators.select import remap_keywords
from glyphmill.spec.artifact import Rule, Runtime
from glyphmill.spec.builtin import builtin


class NotOrdered(ValueError):
    """No order of alternatives is proven to give the longest match."""


def _class(members: list[int]) -> str:
    if len(members) > 128:
        rest = sorted(set(range(256)) - set(members))
        return "[^" + "".join(f"\\x{b:02x}" for b in rest) + "]" if rest else "[\\x00-\\xff]"
    return "[" + "".join(f"\\x{b:02x}" for b in members) + "]"


def _text(data: list[int]) -> str:
    return "".join(f"\\x{b:02x}" for b in data)


def _pattern(r: Rule, runtime: Runtime) -> tuple[str, set[int]]:
    """(expression, bytes it can begin with)."""
    p = r.plan
    match p["kind"]:
        case "literal":
            return _text(p["bytes"]), {p["bytes"][0]}
        case "runClassRun":
            body = runtime.bytes_of_set(p["bodyClassSetID"])
            c = _class(body)
            return f"(?<!{c}){c}{{{max(1, p['minLength'])},}}+", set(body)
        case "runHeadTail":
            head, tail = (runtime.bytes_of_set(p[k]) for k in ("headClassSetID", "tailClassSetID"))
            return f"(?<!{_class(tail)}){_class(head)}{_class(tail)}*+", set(head)
        case "runPrefixed":
            return f"{_text(p['prefix'])}{_class(runtime.bytes_of_set(p['bodyClassSetID']))}*+", {p["prefix"][0]}
    raise NotOrdered(f"rule {r.name}: {p['kind']} has no expression here")


def compile_rules(runtime: Runtime) -> list[tuple[Rule, str]]:
    """Rules with their expressions, in an order in which the first match is the best."""
    found = [(r, *_pattern(r, runtime)) for r in runtime.rules]
    for i, (r, _, a) in enumerate(found):
        for s, _, b in found[i + 1 :]:
            kinds = {r.plan["kind"], s.plan["kind"]}
            if not a & b or kinds == {"literal"}:
                continue
            if kinds == {"literal", "runPrefixed"}:
                lit, pre = (r, s) if r.plan["kind"] == "literal" else (s, r)
                n, m = len(lit.plan["bytes"]), len(pre.plan["prefix"])
                if n < m or (n == m and (lit.plan["bytes"] != pre.plan["prefix"] or pre.rank < lit.rank)):
                    continue
            raise NotOrdered(f"rules {r.name} and {s.name} can begin alike")
    order = lambda x: (x[0].plan["kind"] == "literal", -len(x[0].plan.get("bytes", ())), x[0].rank)
    return [(r, e) for r, e, _ in sorted(found, key=order)]


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, whole: str, rules: list[int]) -> Iterator[pa.RecordBatch]:
    """The tokens of each page, in one reading; the group that matched names the rule."""
    pattern = re.compile(whole)
    for batch in batches:
        last = batch.num_columns - 1
        own, start, end, rule, lexeme = [], [], [], [], []

        def flush(own, *columns):
            ids = [batch.column(i).take(pa.array(own, pa.int64())) for i in range(last)]  # noqa: B023
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(ids, schema)] + [pa.array(c, f.type) for c, f in zip(columns, list(schema)[last:])], schema=schema)  # noqa: B023

        for k, page in enumerate(batch.column(last)):
            for m in pattern.finditer(page.as_py()):
                if m.lastindex:
                    own.append(k)
                    start.append(m.start())
                    end.append(m.end())
                    rule.append(rules[m.lastindex - 1])
                    lexeme.append(m.group())
            if len(own) > 50_000:
                yield flush(own, start, end, rule, lexeme)
                own, start, end, rule, lexeme = [], [], [], [], []
        if own:
            yield flush(own, start, end, rule, lexeme)


def tokens(df: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), runtime: Runtime | None = None, target_bytes: int = 32768) -> DataFrame:
    """ids, page_id, start, end (in the source), rule_id, kind_id, skip, lexeme of all tokens."""
    runtime = runtime or builtin()
    rules = compile_rules(runtime)
    whole = "|".join(f"({e})" for _, e in rules) + "|[\\x00-\\xff]"
    keys = [*ids, "page_id", "base"]
    pages = page_views(df, text, ids, target_bytes).where("bucket IS NOT NULL").select(*keys, "page")
    schema = StructType([pages.schema[c] for c in keys] + StructType.fromDDL("start int, end int, rule_id int, lexeme string").fields)
    found = pages.mapInArrow(partial(_cut, schema=to_arrow_schema(schema), whole=whole, rules=[r.id for r, _ in rules]), schema)
    return remap_keywords(found, runtime).select(
        *ids, "page_id", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), "rule_id", "kind_id", "skip", "lexeme"
    )
