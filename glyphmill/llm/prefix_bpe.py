"""Byte-level BPE by a table of last tokens.

In byte-pair encoding each prefix of a piece has one encoding, so it has one
last token. A token t that ends at byte i is that token exactly if the pair
(last token of the prefix before t, t) is one that BPE leaves apart. So the
table of last tokens is filled from left to right, and the encoding is read off
from the end. Bytes can be appended with exact results, and after an edit only
the positions of its piece from the edit on are filled anew.

``Vocabulary`` holds the ranks with, for each token, the two tokens it is merged
from; its ``ids`` fill a short piece's table only where the reading asks for it.
``PrefixTable`` is the table of one piece. ``Text`` keeps the pieces of an
editable text. ``encode_documents`` is the operator on a table.

Row rules: null text is empty: no ids, and the hashes of an empty string. Each
row is returned, repeated or not; null doc_ids stay null. No other column is
read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glyphmill.llm.common import small_batches

#: Bytes that a worker's memos may take before they start anew, as entries and their texts; pairs of tokens known; characters of an entry.
MEMO, PAIRS, ENTRY = 400_000_000, 700_000, 200
#: Characters after a piece on which its match may depend, in the public patterns: an apostrophe and two letters.
REACH = 4


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                self._split(token, rank)
        self.known: dict[tuple[int, int], bool] = {}

    def _split(self, token: bytes, rank: int) -> None:
        """Merges the token's bytes by ranks below its own; the two parts left are its halves."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                found = self.ranks.get(parts[i] + parts[i + 1], rank)
                if found < best:
                    best, at = found, i
            if at < 0:
                return  # no merges lead here: the token never comes about
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            pair = self.ranks[parts[0]], self.ranks[parts[1]]
            self.halves[rank] = pair
            self.merged[pair] = rank

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b gives exactly these two tokens.

        Merges are undone from the latest one: at each moment of the history the
        tokens that touch the border must not have been due to merge. Of merges of
        one rank the left one comes first.
        """
        key = (a, b)
        known = self.known.get(key)
        if known is None:
            known = self._undo(a, b)
            if len(self.known) > PAIRS:
                self.known.clear()
            self.known[key] = known
        return known

    def _undo(self, a: int, b: int) -> bool:
        # A merge across the border spoils it if it comes before `moment`: (rank, 0) left of the border or (rank, 1)
        # for what lies right of it, which a merge across the border precedes also at equal rank.
        moment = (1 << 62, 0)
        while True:
            across = self.merged.get((a, b))
            if across is not None and (across, 0) < moment:
                return False
            left, right = self.halves.get(a), self.halves.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                moment, a = (a, 0), left[1]
            else:
                moment, b = (b, 1), right[0]

    def ids(self, data: bytes) -> list[int]:
        """The encoding of a piece: of its table of last tokens only what is asked for from the end is filled."""
        size = len(data)
        if size > ENTRY:
            return PrefixTable(self, data).ids()
        last: list[int | None] = [None] * (size + 1)
        get, known, longest = self.ranks.get, self.known.get, self.longest

        def fill(end: int) -> int:
            for begin in range(end - longest if end > longest else 0, end):
                token = get(data[begin:end])
                if token is not None:
                    if begin:
                        before = last[begin]
                        if before is None:
                            before = fill(begin)
                        fits = known((before, token))
                        if fits is None:
                            fits = self.apart(before, token)
                        if not fits:
                            continue
                    last[end] = token
                    return token
            raise ValueError("the vocabulary lacks a byte")

        out, token_bytes = [], self.bytes
        while size:
            token = last[size]
            if token is None:
                token = fill(size)
            out.append(token)
            size -= len(token_bytes[token])
        return out[::-1]


class PrefixTable:
    """The last token of each prefix of a piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill()

    def copy(self) -> PrefixTable:
        out = PrefixTable(self.vocabulary)
        out.data, out.last = self.data, list(self.last)
        return out

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces data[start:end]; the table is kept up to start."""
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1 :]
        self._fill()

    def _fill(self) -> None:
        data, last, v = self.data, self.last, self.vocabulary
        get, known, longest = v.ranks.get, v.known.get, v.longest
        for end in range(len(last), len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = get(data[begin:end])
                if token is not None:
                    if not begin:
                        last.append(token)
                        break
                    fits = known((last[begin], token))
                    if fits is None:
                        fits = v.apart(last[begin], token)
                    if fits:
                        last.append(token)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.bytes[token])
        return out[::-1]


class Text:
    """A text whose encoding follows its edits; only pieces that an edit reaches are found and filled anew.

    The pattern must match everywhere, whatever stands before the place, and look at most ``reach`` characters
    beyond a piece's end. So pieces that end farther before an edit stay, and from the first new piece behind
    the edit that begins where an old one did, the old ones follow.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = "", reach: int = REACH):
        self.vocabulary, self.pattern, self.text, self.reach = vocabulary, regex.compile(pattern), text, reach
        spans = [m.span() for m in self.pattern.finditer(text)]
        #: Where pieces begin, and the table of each.
        self.starts = np.array([a for a, _ in spans], dtype=np.int64)
        self.tables = [PrefixTable(vocabulary, text[a:b].encode()) for a, b in spans]
        self.searched = len(spans)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]."""
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # The first piece whose end isn't safely before the edit: it begins where the one before ends.
        first = max(0, int(np.searchsorted(self.starts, start - self.reach, side="right")) - 1)
        at = int(self.starts[first]) if len(self.starts) else 0
        last = int(np.searchsorted(self.starts, end))
        starts, tables = [], []
        self.searched = 0
        old = len(self.starts)
        for m in self.pattern.finditer(self.text, at):
            a, b = m.span()
            while last < old and self.starts[last] + shift < a:
                last += 1
            if a >= start + len(new) and last < old and self.starts[last] + shift == a:
                break
            self.searched += 1
            starts.append(a)
            tables.append(self._table(a, m[0].encode(), first, start))
        else:
            last = old
        self.starts = np.concatenate([self.starts[:first], np.array(starts, dtype=np.int64), self.starts[last:] + shift])
        self.tables[first:last] = tables

    def _table(self, a: int, data: bytes, first: int, start: int) -> PrefixTable:
        """The table of a piece at a; an old one that began there before the edit is kept up to where they differ."""
        k = int(np.searchsorted(self.starts, a))
        if a >= start or k == len(self.starts) or self.starts[k] != a:
            return PrefixTable(self.vocabulary, data)
        table = self.tables[k]
        if table.data != data:
            keep = len(os.path.commonprefix([table.data, data]))
            table.edit(keep, len(table.data), data[keep:])
        return table

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [x for t in self.tables for x in t.ids()]


class _Units(dict):
    """A memo of what lies between single blanks, by the text without the blank before it; what it lacks is made."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> tuple[str, bytes]:
        return self.make(text)


class Encoder:
    """Whole texts to (count, ids in decimal, decoded bytes), with a memo of what lies between single blanks."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(load_ranks(path))
        self.find = regex.compile(pattern).findall
        #: Of pieces without, and units with, a blank before them: ids in decimal and decoded bytes.
        self.pieces: dict[str, tuple[str, bytes]] = {}
        self.memo = _Units(self._unit)
        self.held = 0  # bytes, about, of both
        # With this pattern a lone blank between other characters always begins a piece.
        self.safe = pattern == _USUAL

    def _hold(self, memo: dict, text: str, known: tuple[str, bytes]) -> tuple[str, bytes]:
        """Keeps an entry; long ones aren't worth their bytes, and full memos start anew."""
        if len(text) <= ENTRY:
            self.held += 400 + 4 * len(text) + len(known[0]) + len(known[1])
            if self.held > MEMO:
                self.memo.clear()
                self.pieces.clear()
                self.held = 400 + 4 * len(text) + len(known[0]) + len(known[1])
            memo[text] = known
        return known

    def _encode(self, text: str) -> tuple[str, bytes]:
        ids, token = self.vocabulary.ids(text.encode()), self.vocabulary.bytes
        return " ".join(map(str, ids)), b"".join([token[x] for x in ids])

    def piece(self, text: str) -> tuple[str, bytes]:
        known = self.pieces.get(text)
        return self._hold(self.pieces, text, self._encode(text)) if known is None else known

    def _unit(self, text: str) -> tuple[str, bytes]:
        """A blank and what stands after it; mostly letters and at most one stop or comma: two pieces, without a search."""
        plain = max(text) < _BEYOND
        if plain and text.isalpha():
            known = self._encode(" " + text)
        elif plain and text[-1] in ".," and text[:-1].isalpha():
            (a, x), (b, y) = self.memo[text[:-1]], self.piece(text[-1])
            known = f"{a} {b}", x + y
        else:
            # A piece that begins with a blank and goes on is a unit too, and the only piece of it.
            first, *more = self.find(" " + text)
            found = [self.memo[first[1:]] if more and len(first) > 1 else self._encode(first), *map(self.piece, more)]
            known = " ".join([x[0] for x in found]), b"".join([x[1] for x in found])
        return self._hold(self.memo, text, known)

    def __call__(self, text: str) -> tuple[int, str, bytes]:
        if not text:
            return 0, "", b""
        parts = text.split()
        # Between its parts the text has single blanks or the like, and none at its ends.
        if self.safe and parts and len("".join(parts)) + len(parts) - 1 == len(text):
            first, *rest = text.split(" ")
            found = [self.piece(x) for x in self.find(first)]
            found += map(self.memo.__getitem__, rest)
        else:
            found = [self.piece(x) for x in self.find(text)]
        digits = " ".join([x[0] for x in found])
        return digits.count(" ") + 1, digits, b"".join([x[1] for x in found])


#: From here on letters are left to the pattern.
_BEYOND = "\u0250"
# The public pattern for which blanks are known to begin pieces (see Encoder.safe).
_USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    key = path, pattern
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern)
    return _encoders[key]


def _run(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, pattern)
    for batch in batches:
        counts, ids, decoded = [], [], []
        for text in batch.column(1):
            n, digits, data = encode(text.as_py() or "")
            counts.append(n)
            ids.append(hashlib.sha256(digits.encode()).hexdigest())
            decoded.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(partial(_run, path=path, pattern=pattern), schema)
