"""The steps from bytes to tokens on whole pages: window functions over arrays instead of over tables of byte rows.

A page has at most 65,536 bytes and needs nothing of others. So each batch of page
views is worked on where it is: no shuffle, no sort, no join of byte rows, and memory
by the batch, however large the table. After each page of a batch stands a mark that
is no byte, at which runs, leads and lags end. Pages that no bucket holds give nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glyphmill.session import bounded_batches, importable
from glyphmill.sources.text import slices
from glyphmill.spec.artifact import Runtime, canonical, load

#: What stands after each page.
MARK = 256


class PageBytes:
    """The bytes of some pages in one array b, page k from begin[k], each followed by a mark."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.begin = offsets[:-1] + np.arange(len(offsets) - 1)
        self.size = np.diff(offsets)
        self.b = np.insert(data.astype(np.int16), offsets[1:], MARK)
        self.place = np.arange(len(self.b))

    def page(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1

    def lead(self, x: np.ndarray, k: int, pad: int) -> np.ndarray:
        return np.append(x[k:], np.full(min(k, len(x)), pad, dtype=x.dtype))

    def run_end(self, inside: np.ndarray) -> np.ndarray:
        """For each place the first at or after it that isn't inside: a running minimum from the end."""
        stop = np.where(inside, len(self.b), self.place)
        return np.minimum.accumulate(stop[::-1])[::-1]


class Found(NamedTuple):
    """Candidates or winners: places among the bytes of all pages, lengths, ranks, rules."""

    at: np.ndarray
    size: np.ndarray
    rank: np.ndarray
    rule: np.ndarray


def _all(parts: list[Found]) -> Found:
    return Found(*(np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*parts))) if parts else Found(*[np.zeros(0, dtype=np.int64)] * 4)


def _table(members: list[int]) -> np.ndarray:
    out = np.zeros(MARK + 1, dtype=bool)
    out[members] = True
    return out


@lru_cache(maxsize=16)
def _runtime(artifact: str) -> Runtime:
    return load(artifact)


def _candidates(p: PageBytes, artifact: str, rules: frozenset[int] | None, automata: bool = False) -> Found:
    runtime, parts = _runtime(artifact), []
    inside = lambda i: _table(runtime.bytes_of_set(i))[p.b]
    for r in runtime.rules:
        if rules is not None and r.id not in rules:
            continue
        plan = r.plan
        match plan["kind"]:
            case "literal":
                same = np.logical_and.reduce([p.lead(p.b, k, MARK) == c for k, c in enumerate(plan["bytes"])])
                at = np.flatnonzero(same)
                size = np.full(len(at), len(plan["bytes"]))
            case "runClassRun" | "runHeadTail":
                body = inside(plan["bodyClassSetID" if plan["kind"] == "runClassRun" else "tailClassSetID"])
                head = body if plan["kind"] == "runClassRun" else inside(plan["headClassSetID"])
                n = p.run_end(body) - p.place
                at = np.flatnonzero(head & ~np.append(False, body[:-1]) & (n >= plan.get("minLength", 1)))
                # A head outside the tail's set has no run of its own.
                at = at[n[at] > 0]
                size = n[at]
            case "runPrefixed":
                prefix = plan["prefix"]
                at = np.flatnonzero(np.logical_and.reduce([p.lead(p.b, k, MARK) == c for k, c in enumerate(prefix)]))
                size = p.run_end(inside(plan["bodyClassSetID"]))[at + len(prefix)] - at
            case "fallback" if automata:
                from glyphmill.plans.arrow import _kernel

                kernel = _kernel(artifact, True)
                kernel.data, kernel.bounds = p.data, p.offsets
                a, e = kernel.candidates(r)
                at, size = a + np.searchsorted(p.offsets, a, side="right") - 1, e - a
            case _:
                continue
        parts.append(Found(at, size, np.full(len(at), r.rank), np.full(len(at), r.id)))
    return _all(parts)


def _by_order(p: PageBytes, found: Found) -> Found:
    """The best of each place: longest, then least rank, then least rule."""
    order = np.lexsort((found.rule, found.rank, -found.size, found.at))
    at = found.at[order]
    first = np.append(True, at[1:] != at[:-1])[: len(at)]
    return Found(*(x[order][first] for x in found))


def _by_score(p: PageBytes, found: Found) -> Found:
    """The same by the greatest number: length, complement of rank, complement of rule, 16 bits each below the length."""
    score = np.zeros(len(p.b), dtype=np.int64)
    np.maximum.at(score, found.at, found.size << 32 | (65535 - found.rank) << 16 | (65535 - found.rule))
    at = np.flatnonzero(score)
    s = score[at]
    return Found(at, s >> 32, 65535 - (s >> 16 & 65535), 65535 - (s & 65535))


def _winners(p: PageBytes, artifact: str, form: str = "order", automata: bool = False) -> Found:
    if form == "merged":
        literal = frozenset(r.id for r in _runtime(artifact).rules if r.plan["kind"] == "literal")
        others = frozenset(r.id for r in _runtime(artifact).rules) - literal
        return _by_order(p, _all([_by_order(p, _candidates(p, artifact, x, automata)) for x in (others, literal)]))
    return {"order": _by_order, "score": _by_score}[form](p, _candidates(p, artifact, None, automata))


def _greedy(p: PageBytes, artifact: str, automata: bool = False) -> Found:
    """The winners that a scan from left to right takes: from each to the first that starts at or after its end."""
    won = _winners(p, artifact, automata=automata)
    after = np.searchsorted(won.at, won.at + won.size).tolist()
    taken, k = [], 0
    while k < len(after):
        taken.append(k)
        k = after[k]
    return Found(*(x[np.array(taken, dtype=np.int64)] for x in won))


# Steps: the page of each row of the result, and its columns.

Step = Callable[[PageBytes], tuple[np.ndarray, list]]


def _found_step(p: PageBytes, choose: Callable[[PageBytes], Found]) -> tuple[np.ndarray, list]:
    found = choose(p)
    own = p.page(found.at)
    return own, [found.at - p.begin[own], found.rule, found.rank, found.size]


def _token_step(p: PageBytes, artifact: str, automata: bool) -> tuple[np.ndarray, list]:
    t = _greedy(p, artifact, automata)
    own = p.page(t.at)
    keeps = np.zeros(max(r.id for r in _runtime(artifact).rules) + 1, dtype=np.int64)
    for r in _runtime(artifact).rules:
        keeps[r.id] = not r.skip
    # Numbers among the kept tokens of the page: those of all pages, less those before the page.
    before = np.cumsum(keeps[t.rule]) - keeps[t.rule]
    first = np.searchsorted(own, own)
    # Tokens don't overlap, so their bytes in order are the lexemes one after the other.
    edges = np.zeros(len(p.b) + 1, dtype=np.int8)
    edges[t.at] += 1
    edges[t.at + t.size] -= 1
    covered = np.cumsum(edges[:-1], dtype=np.int8) > 0
    ends = np.append(0, np.cumsum(t.size)).astype(np.int32)
    lexemes = pa.Array.from_buffers(pa.binary(), len(t.at), [None, pa.py_buffer(ends), pa.py_buffer(p.b[covered].astype(np.uint8))])
    return own, [t.at - p.begin[own], t.at + t.size - p.begin[own], t.rule, before - before[first], lexemes]


def _error_step(p: PageBytes, artifact: str) -> tuple[np.ndarray, list]:
    t = _greedy(p, artifact)
    # Between the ends of earlier tokens, or the page's start, and the next token's start, or the page's end.
    own = np.append(p.page(t.at), np.arange(len(p.begin)))
    start, end = (np.append(x, p.begin + p.size) for x in (t.at, t.at + t.size))
    order = np.lexsort((end, start, own))
    own, start, end = own[order], start[order], end[order]
    first = np.append(True, own[1:] != own[:-1])[: len(own)]
    before = np.where(first, p.begin[own], np.append(0, end[:-1])[: len(own)])
    gap = start > before
    own = own[gap]
    return own, [before[gap] - p.begin[own], start[gap] - p.begin[own]]


def _coverage_step(p: PageBytes, artifact: str, by_reach: bool) -> tuple[np.ndarray, list]:
    t = _greedy(p, artifact)
    if by_reach:
        far = np.zeros(len(p.b), dtype=np.int64)
        far[t.at] = t.at + t.size
        covered = np.maximum.accumulate(far) > p.place
    else:
        marks = np.bincount(t.at, minlength=len(p.b)) - np.bincount(t.at + t.size, minlength=len(p.b))
        covered = np.cumsum(marks) > 0
    total = np.append(0, np.cumsum(covered))
    n = total[p.begin + p.size] - total[p.begin]
    return np.arange(len(p.begin)), [n, p.size - n]


def _stop_step(p: PageBytes, stops: list[int]) -> tuple[np.ndarray, list]:
    stop = p.run_end(~_table([*stops, MARK])[p.b])
    at = np.flatnonzero(p.b != MARK)
    own = p.page(at)
    return own, [at - p.begin[own], p.b[at], stop[at] - p.begin[own]]


def _run(batches: Iterator[pa.RecordBatch], schema: pa.Schema, step: Step) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = batch.num_columns - 1
        for first, data, offsets in slices(batch.column(last)):
            own, columns = step(PageBytes(data, offsets))
            own = pa.array(own + first)
            columns = [batch.column(i).take(own) for i in range(last)] + [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _each(pages: DataFrame, page: list[str], more: str, step: Step) -> DataFrame:
    """page and the columns ``more`` of the step's rows, from page views."""
    importable(pages.sparkSession)
    bounded_batches(pages.sparkSession)
    schema = StructType([pages.schema[c] for c in page] + StructType.fromDDL(more).fields)
    views = pages.where("page IS NOT NULL").select(*page, F.encode("page", "ISO-8859-1").alias("page"))
    return views.mapInArrow(partial(_run, schema=to_arrow_schema(schema), step=step), schema)


_FOUND = "pos int, rule_id int, rank int, len int"


def candidates(pages: DataFrame, runtime: Runtime, page: list[str], rules: list[int] | None = None) -> DataFrame:
    """page, pos, rule_id, rank, len of every candidate of the rules that need no automaton."""
    choose = partial(_candidates, artifact=canonical(runtime.artifact), rules=None if rules is None else frozenset(rules))
    return _each(pages, page, _FOUND, partial(_found_step, choose=choose))


def winners(pages: DataFrame, runtime: Runtime, page: list[str], form: str = "order") -> DataFrame:
    """page, pos, rule_id, rank, len of the best candidate of each place.

    By a sort (order), by one number for each candidate (score), or as the better of the winners of runs and of literals (merged).
    """
    return _each(pages, page, _FOUND, partial(_found_step, choose=partial(_winners, artifact=canonical(runtime.artifact), form=form)))


def tokens(pages: DataFrame, runtime: Runtime, page: list[str], automata: bool = False) -> DataFrame:
    """page, start, end, rule_id, idx (number among the page's kept tokens), lexeme of the tokens that a scan from left to right takes."""
    step = partial(_token_step, artifact=canonical(runtime.artifact), automata=automata)
    found = _each(pages, page, "start int, end int, rule_id int, idx int, lexeme binary", step)
    return found.withColumn("lexeme", F.decode("lexeme", "ISO-8859-1"))


def error_spans(pages: DataFrame, runtime: Runtime, page: list[str]) -> DataFrame:
    """page, start, end: what lies between tokens, and before the first and after the last."""
    return _each(pages, page, "start int, end int", partial(_error_step, artifact=canonical(runtime.artifact)))


def coverage(pages: DataFrame, runtime: Runtime, page: list[str], by_reach: bool = False) -> DataFrame:
    """page, covered, unknown: bytes in tokens and in none, by marks at starts and ends, or by the furthest end so far."""
    step = partial(_coverage_step, artifact=canonical(runtime.artifact), by_reach=by_reach)
    return _each(pages, page, "covered long, unknown long", step)


def next_stop(pages: DataFrame, stops: list[int], page: list[str]) -> DataFrame:
    """page, pos, b, next_stop: the first of the bytes ``stops`` at or after each byte; the page's size if none follows."""
    return _each(pages, page, "pos int, b int, next_stop int", partial(_stop_step, stops=stops))
