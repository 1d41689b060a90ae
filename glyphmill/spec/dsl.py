"""Declaring a specification in Python.

    spec = Spec("demo")
    spec.skip("ws", many1(one_of(WHITESPACE)))
    name = spec.identifier("ident", one_of(IDENT_START) + many(one_of(IDENT_CONTINUE)))
    spec.keywords(name, {"let": "kwLet"})
    spec.token("eq", literal("="))

Rules are tried in the order of their declaration where lengths are equal.
"""

from __future__ import annotations

import inspect
import os
from dataclasses import dataclass, field

from glyphmill.spec.pattern import Pattern

EMIT, SKIP = "emit", "skip"


@dataclass(frozen=True, order=True)
class Place:
    """Where something was declared."""

    file: str
    line: int
    column: int = 0


def _caller() -> Place:
    frame = inspect.currentframe()
    while frame and frame.f_code.co_filename == __file__:
        frame = frame.f_back
    if frame is None:
        return Place("<unknown>", 0)
    positions = inspect.getframeinfo(frame).positions
    return Place(os.path.basename(frame.f_code.co_filename), frame.f_lineno, (positions.col_offset or 0) if positions else 0)


@dataclass(frozen=True)
class RuleDecl:
    kind: str
    mode: str
    pattern: Pattern
    place: Place
    role: str = "plain"


@dataclass(frozen=True)
class KeywordDecl:
    lexeme: str
    kind: str
    place: Place

    @property
    def data(self) -> bytes:
        return self.lexeme.encode("ascii")


@dataclass(frozen=True)
class KeywordBlock:
    base: str
    entries: tuple[KeywordDecl, ...]
    place: Place


@dataclass
class Spec:
    name: str
    rules: list[RuleDecl] = field(default_factory=list)
    blocks: list[KeywordBlock] = field(default_factory=list)

    def token(self, kind: str, pattern: Pattern) -> str:
        self.rules.append(RuleDecl(kind, EMIT, pattern, _caller()))
        return kind

    def skip(self, kind: str, pattern: Pattern) -> str:
        self.rules.append(RuleDecl(kind, SKIP, pattern, _caller()))
        return kind

    def identifier(self, kind: str, pattern: Pattern) -> str:
        self.rules.append(RuleDecl(kind, EMIT, pattern, _caller(), "identifier"))
        return kind

    def keywords(self, base: str, words: dict[str, str] | list[tuple[str, str]]) -> None:
        """Tokens of ``base`` whose text is a key get that key's kind."""
        place = _caller()
        pairs = words.items() if isinstance(words, dict) else words
        self.blocks.append(KeywordBlock(base, tuple(KeywordDecl(x, k, place) for x, k in pairs), place))
