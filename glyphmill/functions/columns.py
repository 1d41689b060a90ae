"""Column expressions on bytes, classes, masks, packed tokens and names. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.spec.artifact import Runtime

#: Capacities of pages in bytes, ascending.
BUCKETS = (4096, 8192, 16384, 32768, 65536)
#: Longest length that a packed token holds.
PACKED_LENGTH = 65535
OVERFLOW = "lex-page-overflow: line exceeds maximum supported page bucket"


def view(text: Column) -> Column:
    """A string of one character for each byte of the text's UTF-8 form."""
    return F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")


def binary_view(data: Column) -> Column:
    """The same of a binary column, whose bytes are taken as they are."""
    return F.decode(F.coalesce(data, F.lit(b"")), "ISO-8859-1")


def byte_class(b: Column, runtime: Runtime) -> Column:
    """The byte's class: a lookup in a literal array of 256."""
    return F.element_at(F.array(*(F.lit(c) for c in runtime.lut)), b.cast("int") + 1)


def in_set(b: Column, runtime: Runtime, set_id: int) -> Column:
    """Whether the byte is in a class set, as ranges of bytes."""
    return in_bytes(b, runtime.bytes_of_set(set_id))


def in_bytes(b: Column, members: list[int]) -> Column:
    ranges: list[list[int]] = []
    for m in sorted(members):
        if ranges and ranges[-1][1] == m - 1:
            ranges[-1][1] = m
        else:
            ranges.append([m, m])
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | ((b == lo) if lo == hi else b.between(lo, hi))
    return out


def shifted(x: Column, k: int, over, pad: int = 0) -> Column:
    """The value k places on, or the pad."""
    return F.lead(x, k, pad).over(over)


def zero_tail(x: Column, valid: Column) -> Column:
    """x where valid, else 0."""
    return F.when(valid, x).otherwise(F.lit(0))


def bucket_of(size: Column) -> Column:
    """The smallest capacity that holds size bytes; null if none does."""
    out = F.lit(None).cast("int")
    for cap in reversed(BUCKETS):
        out = F.when(size <= cap, F.lit(cap)).otherwise(out)
    return out


def pack(start: Column, length: Column, kind: Column, flags: Column) -> Column:
    """A token in 55 bits of a long: start, length (at most 65535), kind, flags."""
    length = F.least(length.cast("long"), F.lit(PACKED_LENGTH).cast("long"))
    out = start.cast("long").bitwiseOR(F.shiftleft(length, 16))
    return out.bitwiseOR(F.shiftleft(kind.cast("long"), 32)).bitwiseOR(F.shiftleft(flags.cast("long"), 48))


def unpack(packed: Column) -> dict[str, Column]:
    """start, length, kind and flags of a packed token."""
    field = lambda at, mask: F.shiftright(packed, at).bitwiseAND(F.lit(mask).cast("long")).cast("int")
    return {"start": field(0, 0xFFFF), "length": field(16, 0xFFFF), "kind": field(32, 0xFFFF), "flags": field(48, 0xFF)}


def padded_rows(packed: Column, capacity: Column) -> Column:
    """An array of packed tokens, filled with zeros to the capacity."""
    return F.concat(packed, F.array_repeat(F.lit(0).cast("long"), F.greatest(capacity - F.size(packed), F.lit(0))))


def fnv1a(text: Column) -> Column:
    """FNV-1a of the text's UTF-8 bytes, in 32 bits."""
    # The product stays below 2^57: a 32-bit hash times 2^24 and a little.
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    chars = F.filter(F.split(view(text), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), step)


def span_error(start: Column, end: Column, size: Column, file: Column, other: Column) -> Column:
    """Why a span isn't valid; null if it is."""
    return (
        F.when(file != other, F.lit("file-mismatch")).when((start < 0) | (end < 0), F.lit("negative-offset"))
        .when(start > end, F.lit("start-after-end")).when(end > size, F.lit("end-beyond-source"))
    )


def kind_name(kind: Column, runtime: Runtime) -> Column:
    pairs = [F.lit(x) for k, name in runtime.kinds.items() for x in (k, name)]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind.cast("int")), F.lit("<unknown>"))
