"""One page at hand: bytes in, packed tokens and error spans out. The plan of ``plans.arrow`` without a table."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from glyphmill.functions.columns import PACKED_LENGTH
from glyphmill.plans.arrow import Options, _kernel
from glyphmill.spec.artifact import V1, Runtime, canonical
from glyphmill.spec.builtin import builtin


@dataclass(frozen=True)
class Token:
    """A token in its source."""

    kind: int
    flags: int
    start: int
    end: int
    payload_a: int = 0
    payload_b: int = 0


@dataclass
class PageResult:
    """Packed tokens (offsets in the page) and error spans."""

    packed: list[int]
    error_spans: list[tuple[int, int]]
    base: int = 0
    rule_ids: list[int] = field(default_factory=list)

    def tokens(self) -> list[Token]:
        out = []
        for p in self.packed:
            start, size = self.base + (p & 0xFFFF), p >> 16 & 0xFFFF
            out.append(Token(p >> 32 & 0xFFFF, p >> 48 & 0xFF, start, start + size))
        return out

    def rows(self, capacity: int) -> list[int]:
        """Packed tokens filled with zeros to a capacity."""
        return self.packed + [0] * max(0, capacity - len(self.packed))


def lex_page(data: bytes, valid: int | None = None, base: int = 0, runtime: Runtime | None = None, options: Options | None = None) -> PageResult:
    """Lexes the first ``valid`` bytes of a page that stands at ``base`` in its source; what follows is padding."""
    runtime, options = runtime or builtin(), options or Options()
    part = np.frombuffer(data, dtype=np.uint8)[: len(data) if valid is None else max(0, valid)]
    if not len(part):
        return PageResult([], [], base)
    r = _kernel(canonical(runtime.artifact), options.profile == V1)(part, np.array([0, len(part)]))
    keep = np.ones(len(r.start), dtype=bool) if options.emit_skip else ~r.skip
    size = np.minimum(r.end - r.start, PACKED_LENGTH)
    packed = r.start | size << 16 | r.kind.astype(np.int64) << 32 | r.skip.astype(np.int64) << 48
    return PageResult(packed[keep].tolist(), list(zip(r.error_start.tolist(), r.error_end.tolist())), base, r.rule[keep].tolist())
