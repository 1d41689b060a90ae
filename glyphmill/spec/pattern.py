"""Patterns over bytes: building, normal form, properties, acceptance and derivatives.

Written patterns and normal forms share one set of nodes; ``normalize`` brings a
pattern into normal form: no nested or one-element sequences and alternatives,
no empty parts, adjacent literals joined, alternatives sorted by key and
distinct.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from glyphmill.spec.byteset import ByteSet


class Pattern:
    def __add__(self, other: Pattern) -> Pattern:
        left = self.parts if isinstance(self, Seq) else (self,)
        return Seq(left + (other.parts if isinstance(other, Seq) else (other,)))

    def __or__(self, other: Pattern) -> Pattern:
        return Either((self, other))


@dataclass(frozen=True)
class Properties:
    nullable: bool
    least: int
    most: int | None
    first: ByteSet


@dataclass(frozen=True)
class Never(Pattern):
    @property
    def key(self) -> str:
        return "n"

    @property
    def props(self) -> Properties:
        return Properties(False, 0, 0, ByteSet())


@dataclass(frozen=True)
class Empty(Pattern):
    @property
    def key(self) -> str:
        return "e"

    @property
    def props(self) -> Properties:
        return Properties(True, 0, 0, ByteSet())


@dataclass(frozen=True)
class Literal(Pattern):
    data: bytes

    @property
    def key(self) -> str:
        return "l[" + ",".join(map(str, self.data)) + "]"

    @property
    def props(self) -> Properties:
        return Properties(not self.data, len(self.data), len(self.data), ByteSet.of(*self.data[:1]))


@dataclass(frozen=True)
class OneOf(Pattern):
    bytes: ByteSet

    @property
    def key(self) -> str:
        return "b[" + ",".join(map(str, self.bytes.members())) + "]"

    @property
    def props(self) -> Properties:
        return Properties(False, 1, 1, self.bytes)


@dataclass(frozen=True)
class Seq(Pattern):
    parts: tuple[Pattern, ...]

    @cached_property
    def key(self) -> str:
        return "c(" + "|".join(p.key for p in self.parts) + ")"

    @cached_property
    def props(self) -> Properties:
        all_ = [p.props for p in self.parts]
        most = None if any(p.most is None for p in all_) else sum(p.most for p in all_)
        first, nullable = ByteSet(), True
        for p in all_:
            first |= p.first
            if not p.nullable:
                nullable = False
                break
        return Properties(nullable, sum(p.least for p in all_), most, first)


@dataclass(frozen=True)
class Either(Pattern):
    options: tuple[Pattern, ...]

    @cached_property
    def key(self) -> str:
        return "a(" + "|".join(p.key for p in self.options) + ")"

    @cached_property
    def props(self) -> Properties:
        all_ = [p.props for p in self.options]
        most = None if any(p.most is None for p in all_) else max((p.most for p in all_), default=0)
        first = reduce(lambda s, p: s | p.first, all_, ByteSet())
        return Properties(any(p.nullable for p in all_), min((p.least for p in all_), default=0), most, first)


@dataclass(frozen=True)
class Repeat(Pattern):
    child: Pattern
    least: int
    most: int | None

    @cached_property
    def key(self) -> str:
        return f"r({self.child.key},{self.least},{'*' if self.most is None else self.most})"

    @cached_property
    def props(self) -> Properties:
        p = self.child.props
        if self.most is not None:
            most = None if p.most is None else p.most * self.most
        else:
            most = 0 if p.most == 0 else None
        first = ByteSet() if self.most == 0 else p.first
        return Properties(self.least == 0 or p.nullable, p.least * self.least, most, first)


NEVER, EMPTY = Never(), Empty()


# What specifications are written with.


def literal(text: str) -> Pattern:
    """Fixed bytes; the text must be ASCII."""
    return Literal(text.encode("ascii"))


def byte(value: int) -> Pattern:
    return Literal(bytes([value]))


def one_of(bytes_: ByteSet) -> Pattern:
    return OneOf(bytes_)


def none_of(bytes_: ByteSet) -> Pattern:
    return OneOf(~bytes_)


def alt(*options: Pattern) -> Pattern:
    return Either(options)


def many(p: Pattern) -> Pattern:
    return Repeat(p, 0, None)


def many1(p: Pattern) -> Pattern:
    return Repeat(p, 1, None)


def maybe(p: Pattern) -> Pattern:
    return Repeat(p, 0, 1)


def times(p: Pattern, least: int, most: int | None = None) -> Pattern:
    """Exactly ``least`` times, or from least to most."""
    return Repeat(p, least, least if most is None else most)


def at_least(p: Pattern, least: int) -> Pattern:
    return Repeat(p, least, None)


# Normal form.


def normalize(p: Pattern) -> Pattern:
    match p:
        case Literal(data):
            return p if data else EMPTY
        case OneOf(set_):
            return p if set_ else NEVER
        case Seq(parts):
            return sequence([normalize(x) for x in parts])
        case Either(options):
            return either([normalize(x) for x in options])
        case Repeat(child, least, most):
            return repeat(normalize(child), least, most)
    return p


def sequence(parts: list[Pattern]) -> Pattern:
    out: list[Pattern] = []
    for part in parts:
        if isinstance(part, Never):
            return NEVER
        for x in part.parts if isinstance(part, Seq) else () if isinstance(part, Empty) else (part,):
            if isinstance(x, Literal) and out and isinstance(out[-1], Literal):
                out[-1] = Literal(out[-1].data + x.data)
            else:
                out.append(x)
    return Seq(tuple(out)) if len(out) > 1 else out[0] if out else EMPTY


def either(options: list[Pattern]) -> Pattern:
    flat = {y for x in options for y in (x.options if isinstance(x, Either) else (x,)) if not isinstance(y, Never)}
    out = sorted(flat, key=lambda x: x.key)
    return Either(tuple(out)) if len(out) > 1 else out[0] if out else NEVER


def repeat(child: Pattern, least: int, most: int | None) -> Pattern:
    if least < 0 or (most is not None and most < least):
        raise ValueError("a repetition's bounds must be 0 <= least <= most")
    if most == 0 or isinstance(child, Empty):
        return EMPTY
    if least == most == 1:
        return child
    if isinstance(child, Never):
        return EMPTY if least == 0 else NEVER
    return Repeat(child, least, most)


def primitive_sets(p: Pattern) -> set[ByteSet]:
    """The byte sets that a pattern tells apart: its classes and the bytes of its literals."""
    match p:
        case Literal(data):
            return {ByteSet.of(b) for b in data}
        case OneOf(set_):
            return {set_}
        case Seq(parts) | Either(parts):
            return set().union(*(primitive_sets(x) for x in parts)) if parts else set()
        case Repeat(child, _, _):
            return primitive_sets(child)
    return set()


def derivative(p: Pattern, b: int) -> Pattern:
    """What must follow byte b (Brzozowski), in normal form."""
    match p:
        case Literal(data):
            return normalize(Literal(data[1:])) if data and data[0] == b else NEVER
        case OneOf(set_):
            return EMPTY if b in set_ else NEVER
        case Seq(parts):
            out = []
            for i, x in enumerate(parts):
                out.append(sequence([derivative(x, b), *parts[i + 1 :]]))
                if not x.props.nullable:
                    break
            return either(out)
        case Either(options):
            return either([derivative(x, b) for x in options])
        case Repeat(child, least, most):
            rest = repeat(child, max(0, least - 1), None if most is None else most - 1)
            return sequence([derivative(child, b), rest])
    return NEVER


def accepts(p: Pattern, data: bytes) -> bool:
    """Whether a pattern in normal form matches all of data: it has a nullable derivative by its bytes."""
    for b in data:
        p = derivative(p, b)
    return p.props.nullable
