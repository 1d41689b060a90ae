"""Sets of bytes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

_ALL = (1 << 256) - 1


@dataclass(frozen=True)
class ByteSet:
    """A set of byte values, kept as the bits of one integer."""

    mask: int = 0

    @classmethod
    def of(cls, *members: int | str | bytes) -> ByteSet:
        """From byte values, or the bytes of (ASCII) strings."""
        mask = 0
        for m in members:
            for b in (m,) if isinstance(m, int) else m.encode("ascii") if isinstance(m, str) else m:
                mask |= 1 << b
        return cls(mask)

    @classmethod
    def span(cls, first: int | str, last: int | str) -> ByteSet:
        a, b = (ord(x) if isinstance(x, str) else x for x in (first, last))
        return cls(((1 << (b + 1)) - 1) & ~((1 << a) - 1))

    @classmethod
    def from_json(cls, members: Iterable[int]) -> ByteSet:
        return cls.of(*members)

    def to_json(self) -> list[int]:
        return self.members()

    def __contains__(self, byte: int) -> bool:
        return bool(self.mask >> byte & 1)

    def __or__(self, other: ByteSet) -> ByteSet:
        return ByteSet(self.mask | other.mask)

    def __and__(self, other: ByteSet) -> ByteSet:
        return ByteSet(self.mask & other.mask)

    def __invert__(self) -> ByteSet:
        return ByteSet(_ALL ^ self.mask)

    def __le__(self, other: ByteSet) -> bool:
        return not self.mask & ~other.mask

    def __len__(self) -> int:
        return self.mask.bit_count()

    def __bool__(self) -> bool:
        return self.mask != 0

    def with_byte(self, byte: int) -> ByteSet:
        return ByteSet(self.mask | 1 << byte)

    def members(self) -> list[int]:
        return [b for b in range(256) if self.mask >> b & 1]


DIGIT = ByteSet.span("0", "9")
LOWER = ByteSet.span("a", "z")
UPPER = ByteSet.span("A", "Z")
LETTER = LOWER | UPPER
UNDERSCORE = ByteSet.of("_")
IDENT_START = LETTER | UNDERSCORE
IDENT_CONTINUE = IDENT_START | DIGIT
NEWLINE = ByteSet.of("\n")
CARRIAGE_RETURN = ByteSet.of("\r")
NEWLINES = NEWLINE | CARRIAGE_RETURN
SPACE = ByteSet.of(" ")
TAB = ByteSet.of("\t")
WHITESPACE = SPACE | TAB | NEWLINES
