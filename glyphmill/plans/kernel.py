"""Lexing of many pages at once in numpy.

All pages of a batch stand in one byte array. Every rule gives candidates
(start, length) by array operations over the whole batch; the best candidate of
each position is found by one sort; tokens are chosen from left to right, in
arrays where candidates don't overlap and by a loop only inside those that do.
No array is larger than the number of bytes or candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from glyphmill.spec.artifact import Runtime


@dataclass
class Result:
    """Tokens in order, with offsets in the whole array; error spans likewise."""

    page: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rule: np.ndarray
    kind: np.ndarray
    skip: np.ndarray
    error_page: np.ndarray
    error_start: np.ndarray
    error_end: np.ndarray


def _table(members) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


class Kernel:
    def __init__(self, runtime: Runtime, automata: bool = False):
        """automata: whether automaton rules take part (the profile v1-fallback)."""
        self.runtime = runtime
        self.automata = automata
        self.lut = np.frombuffer(runtime.lut, dtype=np.uint8)
        self.sets = {i: _table(runtime.bytes_of_set(i)) for i in runtime.sets}
        self.rank_bits = len(runtime.rules).bit_length()
        self.rules = {r.id: r for r in runtime.rules}
        size = max(self.rules) + 1
        self.kind, self.skip = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=bool)
        for r in runtime.rules:
            self.kind[r.id], self.skip[r.id] = r.kind_id, r.skip
        # Literals of one byte are looked up together: of two for a byte the better one.
        self.single = np.full(256, -1, dtype=np.int32)
        self.others = []
        for r in sorted(runtime.rules, key=lambda r: (r.rank, r.id)):
            if r.plan["kind"] == "literal" and len(r.plan["bytes"]) == 1:
                b = r.plan["bytes"][0]
                self.single[b] = r.id if self.single[b] < 0 else self.single[b]
            else:
                self.others.append(r)
        self.others.sort(key=lambda r: r.id)
        self.order = np.zeros(size, dtype=np.int64)  # place of each rule by rank, then id
        for k, r in enumerate(sorted(runtime.rules, key=lambda r: (r.rank, r.id))):
            self.order[r.id] = k
        self.words: dict[int, dict[int, list[tuple[bytes, int]]]] = {}
        for (base, lexeme), kind in runtime.keywords().items():
            self.words.setdefault(base, {}).setdefault(len(lexeme), []).append((lexeme, kind))

    # Candidates.

    def _runs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes in a table, page by page."""
        inside = table[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | self.edge[1:-1]
        last[:-1] &= ~inside[1:] | self.edge[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def _places(self, text: bytes) -> np.ndarray:
        """Where a literal stands inside one page."""
        n = len(self.data) - len(text) + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.data[:n] == text[0])
        for k in range(1, len(text)):
            at = at[self.data[at + k] == text[k]]
        return at[at + len(text) <= self.page_end(at)]

    def page_end(self, at: np.ndarray) -> np.ndarray:
        return self.bounds[np.searchsorted(self.bounds, at, side="right")]

    def candidates(self, rule) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of a rule's candidates."""
        plan = rule.plan
        match plan["kind"]:
            case "literal":
                at = self._places(bytes(plan["bytes"]))
                return at, at + len(plan["bytes"])
            case "runClassRun":
                a, b = self._runs(self.sets[plan["bodyClassSetID"]])
                long = b - a >= plan["minLength"]
                return a[long], b[long]
            case "runHeadTail":
                a, b = self._runs(self.sets[plan["tailClassSetID"]])
                head = self.sets[plan["headClassSetID"]][self.data[a]]
                return a[head], b[head]
            case "runPrefixed":
                at = self._places(bytes(plan["prefix"]))
                begin = at + len(plan["prefix"])
                outside = np.flatnonzero(~self.sets[plan["bodyClassSetID"]][self.data])
                stop = np.append(outside, len(self.data))[np.searchsorted(outside, begin)]
                return at, np.minimum(stop, self.page_end(at))
            case "fallback" if self.automata:
                return self._automaton(rule)
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _automaton(self, rule) -> tuple[np.ndarray, np.ndarray]:
        """The longest accepted prefix at each position, all positions a byte further at a time."""
        plan = rule.plan
        table = np.array(plan["transitions"], dtype=np.int32).reshape(plan["stateCount"], plan["classCount"])
        accepting = np.zeros(plan["stateCount"], dtype=bool)
        accepting[plan["acceptingStates"]] = True
        # States from which nothing is accepted end a search: state by state, those that reach acceptance.
        alive = accepting.copy()
        while (more := alive | alive[table].any(axis=1)).sum() > alive.sum():
            alive = more
        classes = self.lut[self.data]
        at = np.flatnonzero(alive[table[plan["startState"]]][classes]) if len(classes) else np.zeros(0, dtype=np.int64)
        end = self.page_end(at) if len(at) else at
        state = np.full(len(at), plan["startState"], dtype=np.int32)
        best = np.zeros(len(at), dtype=np.int64)
        live = np.arange(len(at))
        for k in range(rule.most or 0):
            live = live[at[live] + k < end[live]]
            if not len(live):
                break
            state[live] = table[state[live], classes[at[live] + k]]
            best[live[accepting[state[live]]]] = k + 1
            live = live[alive[state[live]]]
        hit = best > 0
        return at[hit], at[hit] + best[hit]

    # Best candidate, tokens, keywords, errors.

    def winners(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, rules): of each position the longest candidate, then the least rank, then the least rule."""
        one = self.single[self.data]
        at = np.flatnonzero(one >= 0)
        starts, ends, rules = ([at], [at + 1], [one[at]]) if len(at) else ([], [], [])
        for r in self.others:
            a, b = self.candidates(r)
            if len(a):
                starts.append(a)
                ends.append(b)
                rules.append(np.full(len(a), r.id, dtype=np.int32))
        if not starts:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z.astype(np.int32)
        start, end, rule = (np.concatenate(x) for x in (starts, ends, rules))
        # By length, rank, rule: equal ranks are rare, and then the rule decides.
        width = int((end - start).max()).bit_length()
        low = ((1 << width) - 1 - (end - start)) << self.rank_bits | self.order[rule]
        if int(start.max()).bit_length() + width + self.rank_bits < 63:
            order = np.argsort(start << (width + self.rank_bits) | low, kind="stable")
        else:
            order = np.lexsort((low, start))
        start = start[order]
        first = np.ones(len(start), dtype=bool)
        first[1:] = start[1:] != start[:-1]
        order = order[first]
        return start[first], end[order], rule[order]

    @staticmethod
    def choose(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mask of the candidates that a scan from left to right takes; candidates stay inside their pages."""
        n = len(start)
        if not n:
            return np.zeros(0, dtype=bool)
        reach = np.maximum.accumulate(end)
        free = np.ones(n, dtype=bool)
        free[1:] = start[1:] >= reach[:-1]  # nothing before overlaps: surely taken
        taken = free.copy()
        # Between one sure candidate and the next, the scan jumps to the first that starts at or after the end.
        head = np.flatnonzero(free)
        size = np.diff(np.append(head, n))
        for h, s in zip(head[size > 1].tolist(), size[size > 1].tolist()):
            if end[h] >= reach[h + s - 1]:
                # The first one covers all others: none of them can start in time, but those at its very end would be free.
                continue
            stop, at = end[h], h
            local_start, local_end = start[h : h + s].tolist(), end[h : h + s].tolist()
            for k in range(1, s):
                if local_start[k] >= stop:
                    taken[at + k] = True
                    stop = local_end[k]
        return taken

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> Result:
        """data: bytes of all pages; bounds: where each page begins, and the end."""
        self.data, self.bounds = data, bounds
        self.edge = np.zeros(len(data) + 1, dtype=bool)
        self.edge[bounds] = True
        start, end, rule = self.winners()
        taken = self.choose(start, end)
        start, end, rule = start[taken], end[taken], rule[taken]
        kind = self.kind[rule].copy()
        for base, by_length in self.words.items():
            own = np.flatnonzero(rule == base)
            size = end[own] - start[own]
            for length, entries in by_length.items():
                some = own[size == length]
                text = data[start[some][:, None] + np.arange(length)]
                for lexeme, to in entries:
                    kind[some[(text == np.frombuffer(lexeme, dtype=np.uint8)).all(axis=1)]] = to
        page = np.searchsorted(bounds, start, side="right") - 1
        # Errors: what lies between a page's start, its tokens and its end.
        # All are in order by place alone; where a page ends and the next begins, the same number stands twice.
        marks = np.sort(np.concatenate([bounds[:-1], end]), kind="stable")
        nexts = np.sort(np.concatenate([start, bounds[1:]]), kind="stable")
        gap = nexts > marks
        marks, nexts = marks[gap], nexts[gap]
        own = np.searchsorted(bounds, marks, side="right") - 1
        return Result(page, start, end, rule, kind, self.skip[rule], own, marks, nexts)


def line_starts(data: np.ndarray) -> np.ndarray:
    """0, and the place after each line end: \\n, or \\r that no \\n follows."""
    ends = data == 10
    lone = data == 13
    lone[:-1] &= data[1:] != 10
    return np.concatenate(([0], np.flatnonzero(ends | lone) + 1))


def page_cuts(starts: np.ndarray, size: int, target: int) -> np.ndarray:
    """Ends of a source's pages. A page ends at the last line start within ``target`` bytes, else at the next one."""
    if not size:
        return np.zeros(1, dtype=np.int64)
    out, at = [], 0
    while at < size:
        k = int(np.searchsorted(starts, at + target, side="right"))
        if k and starts[k - 1] > at:
            at = int(starts[k - 1])
        else:
            at = int(starts[k]) if k < len(starts) else size
        out.append(at)
    return np.array(out, dtype=np.int64)
