"""From a declared specification to an artifact.

declare -> normalize -> validate -> byte classes and class sets -> classify (an
execution plan for each rule) -> lower. Each step is a pure function on the
driver; ``compile_spec`` runs them all.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from glyphmill.spec import artifact as A
from glyphmill.spec.byteset import ByteSet
from glyphmill.spec.dsl import EMIT, Place, Spec
from glyphmill.spec.pattern import NEVER, Literal, OneOf, Pattern, Repeat, Seq, accepts, derivative, normalize, primitive_sets


@dataclass(frozen=True)
class Options:
    """Greatest width of a window rule, whether automata are allowed, most states of one."""

    window_bytes: int = 8
    automata: bool = True
    states: int = 256


@dataclass(frozen=True)
class Diagnostic:
    code: str
    place: Place
    message: str
    other: Place | None = None


class SpecError(ValueError):
    """Diagnostics in order of place and code."""

    def __init__(self, diagnostics: list[Diagnostic]):
        self.diagnostics = sorted(diagnostics, key=lambda d: (d.place, d.code))
        super().__init__("\n".join(f"{d.code} {d.place.file}:{d.place.line}: {d.message}" for d in self.diagnostics))


class ClassificationError(ValueError):
    pass


@dataclass(frozen=True)
class NormalRule:
    id: int
    kind_id: int
    name: str
    mode: str
    role: str
    pattern: Pattern
    place: Place


@dataclass(frozen=True)
class NormalKeyword:
    lexeme: str
    data: bytes
    kind: str
    kind_id: int
    place: Place


@dataclass(frozen=True)
class NormalBlock:
    base: str
    base_kind_id: int
    entries: tuple[NormalKeyword, ...]


@dataclass(frozen=True)
class NormalSpec:
    name: str
    rules: tuple[NormalRule, ...]
    blocks: tuple[NormalBlock, ...]


def normalize_spec(spec: Spec) -> NormalSpec:
    """Rule ids by order, kind ids by first occurrence: rules first, then keywords."""
    ids: dict[str, int] = {}
    kind = lambda name: ids.setdefault(name, len(ids))
    rules = tuple(NormalRule(i, kind(r.kind), r.kind, r.mode, r.role, normalize(r.pattern), r.place) for i, r in enumerate(spec.rules))
    blocks = tuple(
        NormalBlock(b.base, kind(b.base), tuple(NormalKeyword(e.lexeme, e.data, e.kind, kind(e.kind), e.place) for e in b.entries))
        for b in spec.blocks
    )
    return NormalSpec(spec.name, rules, blocks)


def validate(spec: NormalSpec) -> NormalSpec:
    """Raises SpecError with LEX001 to LEX005 if anything is wrong."""
    found: list[Diagnostic] = []
    first: dict[str, NormalRule] = {}
    for r in spec.rules:
        if r.pattern.props.nullable:
            found.append(Diagnostic("LEX001", r.place, f"Rule '{r.name}' can match the empty string."))
        if r.name in first:
            found.append(Diagnostic("LEX002", r.place, f"Duplicate top-level token kind '{r.name}'.", first[r.name].place))
        first.setdefault(r.name, r)
    for b in spec.blocks:
        base = first.get(b.base)
        if base is None:
            continue
        lexemes: dict[str, Place] = {}
        kinds: dict[str, Place] = {}
        for e in b.entries:
            for code, what, value, seen in (("LEX004", "lexeme", e.lexeme, lexemes), ("LEX003", "kind", e.kind, kinds)):
                if value in seen:
                    found.append(Diagnostic(code, e.place, f"Duplicate keyword {what} '{value}' in block '{b.base}'.", seen[value]))
                seen.setdefault(value, e.place)
            if not accepts(base.pattern, e.data):
                found.append(Diagnostic("LEX005", e.place, f"Keyword '{e.lexeme}' is not matched by base rule '{b.base}'.", base.place))
    if found:
        raise SpecError(found)
    return spec


@dataclass(frozen=True)
class ByteClasses:
    """Bytes that no rule tells apart share a class; ids by smallest byte."""

    byte_to_class: tuple[int, ...]
    members: tuple[tuple[int, ...], ...]

    def project(self, s: ByteSet) -> tuple[int, ...]:
        return tuple(c for c, m in enumerate(self.members) if m[0] in s)


def relevant_sets(spec: NormalSpec) -> list[ByteSet]:
    found: set[ByteSet] = set()
    for r in spec.rules:
        found |= {r.pattern.props.first} | primitive_sets(r.pattern)
    return sorted(found, key=lambda s: (len(s), s.members()))


def byte_classes(spec: NormalSpec) -> ByteClasses:
    sets = relevant_sets(spec)
    ids: dict[tuple[bool, ...], int] = {}
    lut = [ids.setdefault(tuple(b in s for s in sets), len(ids)) for b in range(256)]
    members = tuple(tuple(b for b in range(256) if lut[b] == c) for c in range(len(ids)))
    return ByteClasses(tuple(lut), members)


def class_sets(spec: NormalSpec, classes: ByteClasses) -> dict[tuple[int, ...], int]:
    """Class lists of the relevant sets, numbered in lexicographic order."""
    return {c: i for i, c in enumerate(sorted({classes.project(s) for s in relevant_sets(spec)}))}


def automaton(pattern: Pattern, classes: ByteClasses, most_states: int) -> dict:
    """A table of derivatives by class, found breadth first: state 0 is dead, 1 the start."""
    states: list[Pattern] = [NEVER, pattern]
    ids = {NEVER.key: 0, pattern.key: 1}
    table = [0] * len(classes.members)
    queue = deque([1])
    while queue:
        state = states[queue.popleft()]
        for members in classes.members:
            after = derivative(state, members[0])
            if after.key not in ids:
                if len(states) > most_states:
                    raise ClassificationError(f"an automaton needs more than {most_states} states")
                ids[after.key] = len(states)
                queue.append(len(states))
                states.append(after)
            table.append(ids[after.key])
    return {
        "kind": "fallback", "stateCount": len(states), "classCount": len(classes.members), "transitionRowStride": len(classes.members),
        "startState": 1, "acceptingStates": [i for i, s in enumerate(states) if s.props.nullable], "transitions": table,
    }


def plan_of(pattern: Pattern, classes: ByteClasses, sets: dict[tuple[int, ...], int], options: Options) -> tuple[str, dict]:
    """(family, plan): the cheapest way to run a rule, by its shape."""
    set_id = lambda s: sets.get(classes.project(s))
    match pattern:
        case Literal(data):
            return "literal", {"kind": "literal", "bytes": list(data)}
        case Repeat(OneOf(body), least, None) if set_id(body) is not None:
            return "run", {"kind": "runClassRun", "bodyClassSetID": set_id(body), "minLength": min(least, A.U16)}
        case Seq((OneOf(head), Repeat(OneOf(tail), 0, None))) if head <= tail and None not in (set_id(head), set_id(tail)):
            return "run", {"kind": "runHeadTail", "headClassSetID": set_id(head), "tailClassSetID": set_id(tail)}
        case Seq((Literal(prefix), Repeat(OneOf(body), 0, None))) if set_id(body) is not None:
            return "run", {"kind": "runPrefixed", "prefix": list(prefix), "bodyClassSetID": set_id(body), "stopClassSetID": set_id(~body)}
    most = pattern.props.most
    if most is not None and most <= options.window_bytes:
        return "localWindow", {"kind": "localWindow", "maxWidth": most}
    if options.automata:
        return "fallback", automaton(pattern, classes, options.states)
    raise ClassificationError("a rule needs an automaton, and automata are off")


def lower(spec: NormalSpec, options: Options, generator: str) -> dict:
    """The artifact; LEX006 and LEX007 if widths or keywords are out of range."""
    found = []
    for r in spec.rules:
        for what, width in (("minWidth", r.pattern.props.least), ("maxWidth", r.pattern.props.most)):
            if width is not None and width > A.U16:
                found.append(Diagnostic("LEX006", r.place, f"Rule '{r.name}' has {what} {width}, which exceeds UInt16.max."))
    for b in spec.blocks:
        for e in b.entries:
            if len(e.data) > A.U8:
                text = f"Keyword '{e.lexeme}' in block '{b.base}' has {len(e.data)} bytes, exceeding UInt8.max."
                found.append(Diagnostic("LEX007", e.place, text))
    if found:
        raise SpecError(found)
    classes = byte_classes(spec)
    sets = class_sets(spec, classes)
    rules = []
    kinds: dict[int, dict] = {}
    for rank, r in enumerate(spec.rules):
        family, plan = plan_of(r.pattern, classes, sets, options)
        p = r.pattern.props
        rule = {
            "ruleID": r.id, "name": r.name, "tokenKindID": r.kind_id, "mode": r.mode, "family": family, "priorityRank": rank,
            "minWidth": p.least, "firstClassSetID": sets.get(classes.project(p.first), 0), "plan": plan,
        }
        rules.append(rule if p.most is None else rule | {"maxWidth": p.most})
        kinds.setdefault(r.kind_id, {"tokenKindID": r.kind_id, "name": r.name, "defaultMode": r.mode})
    remaps = []
    by_name = {r.name: r for r in spec.rules}
    for b in spec.blocks:
        for e in b.entries:
            kinds.setdefault(e.kind_id, {"tokenKindID": e.kind_id, "name": e.kind, "defaultMode": EMIT})
        if b.base in by_name:
            entries = [{"lexeme": list(e.data), "tokenKindID": e.kind_id} for e in sorted(b.entries, key=lambda e: e.data)]
            longest = min(A.U8, max((len(e["lexeme"]) for e in entries), default=0))
            remaps.append(
                {"baseRuleID": by_name[b.base].id, "baseTokenKindID": b.base_kind_id, "maxKeywordLength": longest, "entries": entries}
            )
    longest = max((len(r["plan"]["bytes"]) for r in rules if r["plan"]["kind"] == "literal"), default=0)
    widest = max((r["maxWidth"] for r in rules if "maxWidth" in r), default=0)
    out = {
        "formatVersion": A.FORMAT_VERSION,
        "specName": spec.name,
        "generatorVersion": generator,
        "runtimeHints": {"maxLiteralLength": longest, "maxBoundedRuleWidth": widest, "maxDeterministicLookaheadBytes": longest},
        "tokenKinds": [kinds[k] for k in sorted(kinds)],
        "byteToClass": list(classes.byte_to_class),
        "classes": [{"classID": c, "bytes": list(m)} for c, m in enumerate(classes.members)],
        "classSets": [{"classSetID": {"rawValue": i}, "classes": list(c)} for c, i in sets.items()],
        "rules": rules,
        "keywordRemaps": remaps,
    }
    return out | {"specHashHex": A.semantic_hash(out)}


def compile_spec(spec: Spec, options: Options | None = None, generator: str = "dev") -> dict:
    """The artifact of a specification."""
    return lower(validate(normalize_spec(spec)), options or Options(), generator)

