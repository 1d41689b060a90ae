"""Lexing of one page byte by byte, written from the definitions: the tests' oracle."""

from __future__ import annotations


def candidate(runtime, rule, data: bytes, at: int, automata: bool) -> int:
    """Length of a rule's candidate at a place, or 0."""
    p = rule.plan
    member = lambda k, i: runtime.lut[data[i]] in runtime.sets[p[k]]

    def run(k: str, i: int) -> int:
        n = 0
        while i + n < len(data) and member(k, i + n):
            n += 1
        return n

    match p["kind"]:
        case "literal":
            return len(p["bytes"]) if data[at : at + len(p["bytes"])] == bytes(p["bytes"]) else 0
        case "runClassRun":
            if at and member("bodyClassSetID", at - 1):
                return 0
            n = run("bodyClassSetID", at)
            return n if n >= p["minLength"] else 0
        case "runHeadTail":
            if not member("headClassSetID", at) or (at and member("tailClassSetID", at - 1)):
                return 0
            return 1 + run("tailClassSetID", at + 1)
        case "runPrefixed":
            n = len(p["prefix"])
            return n + run("bodyClassSetID", at + n) if data[at : at + n] == bytes(p["prefix"]) else 0
        case "fallback" if automata:
            state, best = p["startState"], 0
            for k in range(min(rule.most, len(data) - at)):
                state = p["transitions"][state * p["transitionRowStride"] + runtime.lut[data[at + k]]]
                if state in p["acceptingStates"]:
                    best = k + 1
            return best
    return 0


def lex(runtime, data: bytes, automata: bool = False):
    """(tokens (start, end, rule, kind, skip), error spans (start, end)) of a page."""
    words = runtime.keywords()
    tokens, errors, at, covered = [], [], 0, 0
    while at < len(data):
        found = [(-candidate(runtime, r, data, at, automata), r.rank, r.id, r) for r in runtime.rules]
        found = [f for f in found if f[0] < 0]
        if not found:
            at += 1
            continue
        n, _, _, r = min(found, key=lambda f: f[:3])
        if at > covered:
            errors.append((covered, at))
        end = at - n
        tokens.append((at, end, r.id, words.get((r.id, data[at:end]), r.kind_id), r.skip))
        at = covered = end
    if covered < len(data):
        errors.append((covered, len(data)))
    return tokens, errors


def pages(data: bytes, target: int) -> list[tuple[int, int]]:
    starts = [0] + [i + 1 for i, b in enumerate(data) if b == 10 or (b == 13 and data[i + 1 : i + 2] != b"\n")]
    if not data:
        return [(0, 0)]
    out, at = [], 0
    while at < len(data):
        inside = [s for s in starts if at < s <= at + target]
        beyond = [s for s in starts if s > at + target]
        end = inside[-1] if inside else beyond[0] if beyond else len(data)
        out.append((at, end))
        at = end
    return out
