"""Token-id files with Elias-Fano encoded document boundaries.

A file holds a segment of the corpus in ascending doc_id order: one concatenated
array of ids, two or four bytes each, and two non-decreasing sequences in
Elias-Fano form: the boundaries (documents + 1 values) and the document ids.
Each takes about 2 + log2(universe / count) bits a value; a sampled select
structure (a 32-bit position for each 256th value) gives any boundary without a
table of 64-bit offsets.

Layout, little-endian: magic, then the header of ``_HEADER`` (bytes per id,
documents, ids, documents with a null id, least doc_id, bytes that follow; fewer
mean that a task was lost while it wrote), the boundaries, the doc_ids less the least, the ids. An Elias-Fano block is a header (count, low
bits, bytes of the low part, bytes of the high part), low bits, high bits,
samples.

Executors write with pyarrow's file systems into the shared folder, each attempt
of a task under names of its own; the manifest, which Spark commits once for each
task, names the files that count. Spark's binaryFile source reads them back.

Row rules: ids are those of the tokenizer's encode(text, add_special_tokens=False),
so an added token's content in a text is that token. Null text is empty (only the end id). Null doc_ids come first.
Repeated ids are ordered by their text's hash; each row is returned. An empty
table makes no file and returns no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import words
from glyphmill.llm.common import new_path, small_batches, trimmed

MAGIC = b"GMTOKEF1"
_HEADER = struct.Struct("<IIQQQqQ")  # bytes per id, reserved, documents, ids, null doc_ids, least doc_id, bytes after the header
_BLOCK = struct.Struct("<QIIQQ")  # count, low bits, reserved, bytes of the low part, bytes of the high part
#: One sample for so many values.
SAMPLE = 256
#: Documents that are read into one batch.
ROWS = 10_000
#: Ids after which a file ends (with the texts that reach it).
SEGMENT_IDS = 4_000_000


class EliasFano:
    """A non-decreasing sequence of non-negative integers, with select."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        spread = (v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(spread.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        mask = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        mask[ones] = 1
        return cls(n, bits, low, np.packbits(mask, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, count ones to the i-th, then add its low bits."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        window = int(self.high[byte]) & (0xFF << (at % 8)) & 0xFF
        while (ones := window.bit_count()) <= left:
            left -= ones
            byte += 1
            window = int(self.high[byte])
        for _ in range(left):
            window &= window - 1
        place = 8 * byte + (window & -window).bit_length() - 1
        value = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= (int(self.low[bit // 8]) >> (bit % 8) & 1) << k
        return (place - i) << self.low_bits | value

    def all(self) -> np.ndarray:
        """Every value, in order."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        out = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            low = np.unpackbits(self.low, count=self.count * self.low_bits, bitorder="little").reshape(-1, self.low_bits)
            out |= (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def dump(self) -> bytes:
        head = _BLOCK.pack(self.count, self.low_bits, 0, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        count, bits, _, n_low, n_high = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        n = -(-count // SAMPLE)
        samples = np.frombuffer(data, "<u4", n, at + n_low + n_high)
        return cls(count, bits, low, high, samples), at + n_low + n_high + 4 * n


def dump_segment(doc_ids: list[int | None], counts: list[int], ids: list[bytes], width: int) -> bytes:
    """The bytes of a file: documents in order, nulls first; counts of ids; ids little-endian, width bytes each."""
    known = [x for x in doc_ids if x is not None]
    least = min(known, default=0)
    bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.uint64)))
    ef = EliasFano.build(np.array([x - least for x in known], dtype=np.uint64))
    body = [EliasFano.build(bounds).dump(), ef.dump(), *ids]
    head = _HEADER.pack(width, 0, len(doc_ids), int(bounds[-1]), len(doc_ids) - len(known), least, sum(map(len, body)))
    return b"".join([MAGIC, head, *body])


def whole(data: bytes) -> bool:
    """Whether these are all bytes of a file."""
    begin = len(MAGIC) + _HEADER.size
    return len(data) >= begin and len(data) == begin + _HEADER.unpack_from(data, len(MAGIC))[-1]


class Segment:
    """A file's documents."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC or not whole(data):
            raise ValueError("not a token file")
        width, _, self.docs, self.n_ids, self.nulls, self.least, _ = _HEADER.unpack_from(view, 8)
        self.bounds, at = EliasFano.load(view, 8 + _HEADER.size)
        self.names, at = EliasFano.load(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [int(x) + self.least for x in self.names.all().tolist()]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


_SPACE, _LETTER, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[65:91] = _CLASS[97:123] = _LETTER


def units(s: words.Slice, marks: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of parts of the texts that are encoded independently, in order.

    The tokenizer drops white space and lower-cases, and no token goes across
    white space or from letters to anything else, but for an apostrophe's. So a
    part is a run of letters (ASCII, or two bytes of Latin-1) or of other
    characters. A run between white space that holds an apostrophe or a character
    beyond Latin-1's letters is one part. Each of marks, starts and ends of added
    tokens in order, is a part of its own, and what is beside it another.
    """
    data = s.data
    kind = _CLASS[data]
    second = np.zeros(len(data), dtype=bool)
    lead = data == 0xC3
    second[1:] = lead[:-1] & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    lead[:-1] &= second[1:]
    lead[-1:] = False
    kind[second | lead] = _LETTER
    odd = np.concatenate(([0], np.cumsum((data == 0x27) | (data >= 0x80) & ~second & ~lead)))
    whole = np.flatnonzero(odd[s.ends] > odd[s.starts])
    if len(whole):
        size = s.ends[whole] - s.starts[whole]
        at = np.repeat(s.starts[whole] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        kind[at] = _LETTER
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[s.offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    if marks is not None:
        for a, b in zip(*(x.tolist() for x in marks)):
            edge[a + 1 : b] = False
            edge[[a, b]] = True
            kind[a] = _OTHER
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    used = kind[starts] != _SPACE if len(starts) else np.zeros(0, dtype=bool)
    return starts[used], ends[used]


# The steps before the merges, and the mark of a word's end, for which ``units`` holds.
_KNOWN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


#: Seed of the second hash of a part.
_SECOND = 0x5EC0D


class Encoder:
    """Whole texts to ids, with a table of the parts seen.

    The table is keyed by a part's 64-bit hash and checked by a second, independent
    one, within a call too; each part has two places, and what finds both taken is
    encoded again when it next occurs. Its size is fixed: TABLE places, and IDS ids.
    A tokenizer whose description isn't the one that ``units`` is made for has
    whole texts as parts, and no table.

    With added, the tokenizer's added tokens are found in the texts, as its own
    encode does unless told otherwise. They are matched in the text as it stands, so
    they bypass the table, which knows no case. Without, they are text like any other.
    """

    TABLE, IDS = 1 << 21, 8_000_000

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        self.cuts = all(about.get(k) == v for k, v in _KNOWN.items())
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        self.cuts &= not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in tokens.values())
        self.added = {t.content.encode(): k for k, t in tokens.items() if t.content}
        # The longest of those that begin at a place.
        self.find = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        # What is left between them is encoded part by part, where none is to be found.
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.TABLE, dtype=np.uint64)
        self.checks = np.zeros(self.TABLE, dtype=np.uint64)
        self.at = np.zeros(self.TABLE, dtype=np.uint32)
        self.size = np.zeros(self.TABLE, dtype=np.uint32)
        self.ids = np.zeros(1 << 16, dtype=f"<u{self.width}")
        self.used = 0

    def _marks(self, s: words.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and ids of added tokens, in order; none goes across two texts."""
        raw = s.data.tobytes()
        found = []
        if any(x in raw for x in self.added):
            for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist()):
                found += [(m.start(), m.end(), self.added[m[0]]) for m in self.find.finditer(raw, a, b)]
        return tuple(np.array(found, dtype=np.int64).reshape(-1, 3).T)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        raw = data.tobytes()
        parts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.ids.dtype) for x in found]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end_id after each, and each text's count."""
        if not self.cuts:
            return self._whole(data, offsets, end_id)
        s = words.Slice(data, offsets)
        mark_starts, mark_ends, mark_ids = self._marks(s)
        all_starts, all_ends = units(s, (mark_starts, mark_ends))
        plain = np.ones(len(all_starts), dtype=bool)
        plain[np.searchsorted(all_starts, mark_starts)] = False
        starts, ends = all_starts[plain], all_ends[plain]
        own, own_check = s.spans(starts, ends), s.spans(starts, ends, seed=_SECOND)
        keys, first, inverse = np.unique(own, return_index=True, return_inverse=True)
        checks = own_check[first]
        if (checks[inverse] != own_check).any():  # two parts of one key: those that aren't the first go by both
            _, first, inverse = np.unique(np.stack([own, own_check], axis=1), axis=0, return_index=True, return_inverse=True)
            keys, checks, inverse = own[first], own_check[first], inverse.ravel()
        mask = np.uint64(self.TABLE - 1)
        one, two = (keys & mask).astype(np.int64), (keys >> np.uint64(40) & mask).astype(np.int64)
        slot = np.where((self.keys[one] == keys) & (self.checks[one] == checks), one, two)
        known = (self.keys[slot] == keys) & (self.checks[slot] == checks) & (self.size[slot] > 0)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        # The end id is a part of its own, after each text's last; so are added tokens, where they stand.
        others, which = np.unique(mark_ids, return_inverse=True)
        found = self._encode(data, starts[first[new]], ends[first[new]]) if len(new) else []
        size[new] = [len(x) for x in found]
        end = self.used + int(size[new].sum())
        at[new] = self.used + np.cumsum(size[new]) - size[new]
        self._room(end + 1 + len(others))
        if found:
            np.concatenate(found, out=self.ids[self.used : end])
        self.ids[end : end + 1 + len(others)] = [end_id, *others]
        place = np.empty(len(all_starts), dtype=np.int64)
        place[plain], place[~plain] = inverse, len(keys) + 1 + which
        count = np.searchsorted(all_starts, offsets[1:])
        part = np.insert(place, count, len(keys))
        every_at, every_size = np.append(at, end + np.arange(1 + len(others))), np.append(size, np.ones(1 + len(others), dtype=np.int64))
        every_at, every_size = every_at[part], every_size[part]
        total = np.concatenate(([0], np.cumsum(every_size)))
        ids = self.ids[np.repeat(every_at - total[:-1], every_size) + np.arange(total[-1])]
        bounds = total[count + np.arange(1, len(count) + 1)]
        self._keep(end, keys[new], checks[new], at[new], size[new], one[new], two[new])
        return ids, np.diff(bounds, prepend=0)

    def _whole(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same, each text by one call of the library."""
        raw = data.tobytes()
        self.tokenizer.encode_special_tokens = not self.added  # added tokens are the library's to find
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        found = [np.array([*x.ids, end_id], dtype=self.ids.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else self.ids[:0], np.array([len(x) for x in found], dtype=np.int64)

    def _room(self, need: int) -> None:
        if need > len(self.ids):
            more = np.zeros(max(need, 2 * len(self.ids)), dtype=self.ids.dtype)
            more[: self.used] = self.ids[: self.used]
            self.ids = more

    def _keep(self, end, keys, checks, at, size, one, two) -> None:
        if end > self.IDS:
            self._clear()
            return
        self.used = end
        for choice in (one, two):
            free = np.flatnonzero((self.size[choice] == 0) & (size > 0))
            _, pick = np.unique(choice[free], return_index=True)
            free = free[pick]
            target = choice[free]
            self.keys[target], self.checks[target] = keys[free], checks[free]
            self.at[target], self.size[target] = at[free], size[free]
            size = size.copy()
            size[free] = 0  # placed


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, added=True)
    return _encoders[path]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
        packed = pa.array([squeeze(x) for x in texts], pa.binary())
        check = pa.array([zlib.crc32(x) for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), check, packed], names=["doc_id", "check", "packed"])


def _write(batches: Iterable[pa.RecordBatch], uri: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSystem

    fs, folder = FileSystem.from_uri(uri)
    fs.create_dir(folder, recursive=True)
    encode = encoder(tokenizer)
    unpack = zstandard.ZstdDecompressor().decompress
    part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
    docs: list[int | None] = []
    counts: list[int] = []
    ids: list[bytes] = []
    seq = total = 0

    def flush() -> pa.RecordBatch:
        name = f"{part:08d}-{seq:06d}-{attempt}.tok"
        with fs.open_output_stream(f"{folder}/{name}") as out:
            out.write(dump_segment(docs, counts, ids, encode.width))
        return pa.RecordBatch.from_pydict(
            {"part": [part], "seq": [seq], "name": [name], "n_docs": [len(docs)], "n_ids": [total]}, schema=_MANIFEST
        )

    for batch in batches:
        for begin in range(0, batch.num_rows, 100):  # few texts at once stay unpacked
            some = batch.slice(begin, 100)
            texts = pa.array([unpack(x.as_py()) for x in some.column(1)], pa.binary())
            for p, q, data, offsets in words.slices(texts):
                found, n = encode(data, offsets, end_id)
                docs += some.column(0).slice(p, q - p).to_pylist()
                counts += n.tolist()
                ids.append(found.tobytes())
                total += len(found)
                if total >= SEGMENT_IDS:
                    yield flush()
                    docs, counts, ids, total, seq = [], [], [], 0, seq + 1
    if docs:
        yield flush()


def _written(batches: Iterable[pa.RecordBatch], uri: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    return trimmed(_write(batches, uri, tokenizer, end_id))


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write(docs: DataFrame, tokenizer: str, end_id: int, uri: str) -> DataFrame:
    """Writes the token files of docs under uri; returns the manifest: part, seq, name, n_docs, n_ids, first_id."""
    spark = docs.sparkSession
    small_batches(spark)
    packed = docs.select("doc_id", "text").mapInArrow(_pack, "doc_id long, check long, packed binary")
    # Also by the check value: one doc_id with very many rows still spreads.
    ordered = packed.repartitionByRange("doc_id", "check").sortWithinPartitions("doc_id", "check").select("doc_id", "packed")
    schema = "part int, seq int, name string, n_docs long, n_ids long"
    run = partial(_written, uri=f"{uri}/files", tokenizer=tokenizer, end_id=end_id)
    ordered.mapInArrow(run, schema).write.parquet(f"{uri}/manifest")
    found = spark.read.schema(schema).parquet(f"{uri}/manifest")
    # One row a file; totals of parts first, so that no task orders all files' rows but those of one part.
    totals = found.groupBy("part").agg(F.sum("n_ids").alias("t"))
    before = F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("inner", F.coalesce(inner, F.lit(0))).join(totals, "part").select(
        "part", "seq", "name", "n_docs", "n_ids", (F.col("before") + F.col("inner")).alias("first_id")
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_buffer().to_pybytes()
            if not whole(data):
                continue  # left by a lost task; the manifest doesn't name it
            seg = Segment(data)
            doc_ids = seg.doc_ids()
            for first in range(0, seg.docs, ROWS):
                some = range(first, min(first + ROWS, seg.docs))
                starts, sizes, crc = [], [], []
                end = seg.bounds.select(first)
                for i in some:
                    start, end = end, seg.bounds.select(i + 1)
                    starts.append(start)
                    sizes.append(end - start)
                    crc.append(zlib.crc32(seg.ids[start:end].astype("<u4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.string()), *(pa.array(x, pa.int64()) for x in (doc_ids[some.start : some.stop], starts, sizes, crc))],
                    names=["name", "doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    spark = manifest.sparkSession
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.tok").load(f"{uri}/files")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = files.mapInArrow(_read, "name string, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(manifest.select("name", "first_id"), "name").select(
        "doc_id", (F.col("first_id") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes docs' token files in the shared folder and returns what they hold."""
    uri = new_path(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, end_id, uri), uri)
