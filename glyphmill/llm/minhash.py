"""Near duplicates by b-bit MinHash.

1. ``sketch``: each whole text becomes the set of its distinct 5-word shingles
   (64-bit hashes, in numpy). A 128-bit fingerprint of the set names its class;
   texts with equal sets share a class, so that copies cost nothing further.
   Of each MinHash minimum the two low bits are kept and packed; the full minima
   only make band keys.
2. Candidates: each band bucket's smallest class leads it, and every class is
   paired with the least of its buckets' leaders: a pair a class, however large
   the buckets.
3. The packed signatures estimate similarity: equal two-bit fields are counted
   with ``bit_count`` and corrected for the quarter that agree by chance. Pairs
   far below the threshold go (6.5 standard deviations), as do pairs whose set
   sizes exclude the threshold.
4. The rest is confirmed on full sets, in exact integers.
5. Buckets that still hold several components are compared in full, so that no
   link is lost: tasks compare the packed signatures of bounded blocks and give
   back which components may touch, one row a component; then blocks of the full
   sets of such components are compared by a product of their 0/1 matrix with
   itself, which gives exact intersection sizes. Pairs are never rows.

Row rules: a null or blank text has an empty set, is linked with nothing and is
its own component. Null doc_ids are ignored by the component's minimum; a
component of only null ids has a null component_id and its rows are kept.
Repeated rows each get their row. Other columns are not read. A class's set is
read again from one of its rows, told by id and text hash, so that null or
repeated ids cost no more than others. Sets are compared by their shingles'
64-bit hashes, classes by 128 bits: different ones meet by chance alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glyphmill.llm import words
from glyphmill.llm.common import components, groups, materialize, sized_broadcast, small_batches, trimmed

#: Words in a shingle, minima in a band, bits kept of each minimum.
SHINGLE, ROWS, BITS = 5, 6, 2
#: Signatures of a bucket, and sets and their elements together, in half a block of full comparison.
SIGNATURES, SETS, ELEMENTS = 2048, 1024, 400_000
#: Pairs of a block that are compared at once; a worker takes about 250 bytes for each.
PAIRS = 250_000
_FIELDS = 64 // BITS
_LOW = 0x5555555555555555


def _trim(f):
    """f on batches, with freed memory given back at the end of each task."""

    @wraps(f)
    def run(batches, *args, **kwargs):
        return trimmed(f(batches, *args, **kwargs))

    return run



def bands(percent: int, miss: float = 1e-6) -> int:
    """Bands, a multiple of 16, that miss a pair at the threshold with at most this probability."""
    need = math.log(miss) / math.log(1 - (percent / 100) ** ROWS)
    return 16 * math.ceil(need / 16)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    a = words.mix(np.arange(1, count + 1, dtype=np.uint64), 0xA11CE).astype(np.uint32) | np.uint32(1)
    b = words.mix(np.arange(1, count + 1, dtype=np.uint64), 0xB0B).astype(np.uint32)
    return a, b


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def distinct_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes text by text, and each text's count."""
    s, at = words.Slice(data, offsets).shingles(SHINGLE)
    first = words.sort_each(s, at)
    return s[first], np.add.reduceat(np.append(first, False).astype(np.int64), at[:-1]) * (np.diff(at) > 0)


def fingerprints(sets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """16 bytes for each set, whatever its order."""
    out = np.zeros((len(sizes), 2), dtype="<u8")
    full = np.flatnonzero(sizes)
    if len(full):
        at = np.concatenate(([0], np.cumsum(sizes[full])))[:-1]
        for k, salt in enumerate((0xF00D, 0xCAFE)):
            out[full, k] = words.mix(np.add.reduceat(words.mix(sets, salt), at), salt)
    return [x.tobytes() for x in out]


def minima(sets: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """(count, texts) of 32-bit minima; all texts must have a shingle."""
    a, b = _factors(count)
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((count, len(sizes)), dtype=np.uint32)
    step = 1 << 15  # texts' hashes that stay in the cache together
    cuts = [0, *np.flatnonzero(np.diff(at // step)) + 1, len(at)]
    for p, q in zip(cuts[:-1], cuts[1:]):
        part = x[at[p] : at[q] if q < len(at) else len(x)]
        begin = at[p:q] - at[p]
        for k in range(count):
            out[k, p:q] = np.minimum.reduceat(part * a[k] + b[k], begin)
    return out


@_trim
def _sketches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    n_bands = bands(percent)
    count = n_bands * ROWS
    longs = count // _FIELDS
    for batch in batches:
        ids = batch.column(0)
        for p, q, data, offsets in words.slices(batch.column(1)):
            sets, sizes = distinct_shingles(data, offsets)
            full = np.flatnonzero(sizes)
            low = np.zeros((q - p, longs), dtype=np.uint64)
            keys = np.zeros((q - p, n_bands), dtype=np.uint64)
            if len(full):
                m = minima(sets, sizes[full], count)
                bits = (_scramble(m) & np.uint32((1 << BITS) - 1)).astype(np.uint64)
                shift = (np.arange(_FIELDS, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
                low[full] = (bits.reshape(longs, _FIELDS, -1) << shift).sum(axis=1, dtype=np.uint64).T
                rows = m.reshape(n_bands, ROWS, -1).astype(np.uint64)
                odd = words.mix(np.arange(ROWS, dtype=np.uint64), 7)[None, :, None] | np.uint64(1)
                band = words.mix(np.arange(n_bands, dtype=np.uint64), 99)[:, None]
                keys[full] = words.mix((rows * odd).sum(axis=1, dtype=np.uint64) + band).T
            flat = pa.array(keys.view(np.int64).ravel())
            at = pa.array(np.arange(q - p + 1, dtype=np.int32) * n_bands)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(p, q - p), batch.column(2).slice(p, q - p), pa.array(fingerprints(sets, sizes), pa.binary()), pa.array(sizes)]
                + [pa.array(low[:, k].view(np.int64)) for k in range(longs)]
                + [pa.ListArray.from_arrays(at, flat)],
                names=["doc_id", "h", "cls", "n", *(f"s{k}" for k in range(longs)), "bands"],
            )


def _longs(percent: int) -> list[str]:
    return [f"s{k}" for k in range(bands(percent) * ROWS // _FIELDS)]


def sketch(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, hash of the text, class of the shingle set, its size, packed low bits s0.., and band keys of every row."""
    small_batches(docs.sparkSession)
    cols = "".join(f", {s} long" for s in _longs(percent))
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(
        partial(_sketches, percent=percent), f"doc_id long, h long, cls binary, n long{cols}, bands array<long>"
    )


def estimate(left: str, right: str, percent: int) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    count = bands(percent) * ROWS
    off = F.lit(0)
    for s in _longs(percent):
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        off = off + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW)))
    chance = 2.0**-BITS
    return ((count - off) / F.lit(float(count)) - chance) / (1 - chance)


def floor_of_estimate(percent: int) -> float:
    """6.5 standard deviations below the threshold: fewer than one linked pair in 10^10 is lost."""
    count, chance = bands(percent) * ROWS, 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return percent / 100 - 6.5 * math.sqrt(p * (1 - p) / count) / (1 - chance)


def _possible(left: str, right: str, percent: int) -> Column:
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (
        estimate(left, right, percent) >= floor_of_estimate(percent)
    )


@_trim
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: set[int] = set()  # classes read by this task
    for batch in batches:
        new = []
        for r in batch.column(0).to_pylist():
            new.append(r not in done)
            done.add(r)
        batch = batch.filter(pa.array(new, pa.bool_()))
        for p, q, data, offsets in words.slices(batch.column(2)):
            sets, sizes = distinct_shingles(data, offsets)
            same = np.array([x == y for x, y in zip(fingerprints(sets, sizes), batch.column(1).slice(p, q - p).to_pylist())])
            at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(sets.view(np.int64)))
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(p, q - p), lists], names=["rid", "items"])
            yield out.filter(pa.array(same))


def _read_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(rid, items) of needed classes (rid, cls, need_id, need_h: id and text hash of a row of the class), from the texts."""
    count = need.count()
    texts = docs.select("doc_id", "text").join(
        sized_broadcast(need, count), F.col("doc_id").eqNullSafe(F.col("need_id")) & (F.xxhash64("text") == F.col("need_h"))
    )
    sets = materialize(texts.select("rid", "cls", "text").mapInArrow(_sets, "rid long, items array<long>"), "sets")
    if sets.count() > count:  # a repeated row was read by several tasks
        sets = materialize(sets.groupBy("rid").agg(F.first("items").alias("items")), "sets_once")
    return sets


class _Confirm:
    """Confirms pairs of classes on their full sets, read again from the texts."""

    def __init__(self, docs: DataFrame, reps: DataFrame, percent: int):
        self.docs, self.reps, self.percent = docs, reps, percent

    def __call__(self, pairs: DataFrame) -> DataFrame | None:
        """The linked of these (a, b); None if there are no pairs at all."""
        ids = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
        need = ids.join(self.reps, "rid").select("rid", "cls", "need_id", "need_h")
        need = materialize(need, "need")
        if not need.limit(1).count():
            return None
        sets = _read_sets(self.docs, need)
        one = sets.select(F.col("rid").alias("b"), F.col("items").alias("y"))
        two = sets.select(F.col("rid").alias("a"), F.col("items").alias("x"))
        both = F.size(F.array_intersect("x", "y"))
        linked = (
            pairs.select("a", "b").join(one, "b").join(two, "a")
            .withColumn("both", both)
            .where(100 * F.col("both") >= self.percent * (F.size("x") + F.size("y") - F.col("both")))
        )
        return materialize(linked.select("a", "b").distinct(), "links")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, shingle_class for every row; linked at similarity percent/100 or more."""
    s = _longs(percent)
    rows = materialize(sketch(docs, percent), "sketch")
    reps = rows.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.max(F.struct("doc_id", "h")).alias("row"), F.count("*").alias("copies"),
        *(F.first(c).alias(c) for c in ["n", *s, "bands"]),
    )
    row = {"need_id": F.col("row.doc_id"), "need_h": F.col("row.h"), "rid": F.monotonically_increasing_id()}
    reps = materialize(reps.withColumns(row).drop("row"), "classes")
    sig = reps.select("rid", "n", *s)
    confirm = _Confirm(docs, reps, percent)

    exploded = reps.select(F.explode("bands").alias("key"), "rid")
    leaders = exploded.groupBy("key").agg(F.min("rid").alias("a"), F.count("*").alias("c")).where("c > 1").select("key", "a")
    pairs = exploded.join(leaders, "key").where("rid != a").groupBy(F.col("rid").alias("b")).agg(F.min("a").alias("a"))
    pairs = (
        pairs.join(sig.alias("p"), F.col("a") == F.col("p.rid")).join(sig.alias("q"), F.col("b") == F.col("q.rid"))
        .where(_possible("p", "q", percent)).select("a", "b")
    )
    links = confirm(materialize(pairs, "pairs"))
    comps = None if links is None else materialize(components(links, "a", "b"), "comps")
    more = _remaining(docs, reps, exploded, sig, comps, percent)
    if more is not None:
        links = more if links is None else links.unionByName(more)
        comps = materialize(components(links, "a", "b"), "comps")

    classes = reps.select("cls", "rid", "copies", F.col("doc_id").alias("least"))
    if comps is not None:
        classes = classes.join(comps, F.col("rid") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "rid"))
        labels = classes.join(comps.select(F.col("node").alias("rid")), "rid", "left_semi").groupBy("comp").agg(F.min("least").alias("label"))
        classes = classes.join(labels, "comp", "left").withColumn("label", F.coalesce("label", "least"))
        several = (F.col("copies") > 1) | F.col("node").isNotNull()
    else:
        classes = classes.withColumn("label", F.col("least"))
        several = F.col("copies") > 1
    labels = classes.where(several).select("cls", "label", F.lit(True).alias("several"))
    component = F.when(F.coalesce("several", F.lit(False)), F.col("label")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "cls", "n").join(labels, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.hex("cls").alias("shingle_class"),
    )


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of labels a and b, pair by pair; the least label stays."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            x = y
        return x

    for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    values, place = np.unique(labels, return_inverse=True)
    return np.array([root(x) for x in values.tolist()])[place]


@_trim
def _touching(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of components that hold signatures whose estimate reaches the floor, one row for each that isn't least."""
    count, chance = bands(percent) * ROWS, 2.0**-BITS
    least = (floor_of_estimate(percent) * (1 - chance) + chance) * count
    low = np.uint64(_LOW)
    for table in groups(batches):
        comp, n = (table.column(i).to_numpy() for i in (1, 2))
        if (comp == comp[0]).all():
            continue
        sig = np.stack([table.column(i).to_numpy().view(np.uint64) for i in range(3, table.num_columns)])
        label = comp
        step = max(1, PAIRS // len(comp))
        for at in range(0, len(comp), step):
            part = slice(at, at + step)
            off = np.zeros((len(comp[part]), len(comp)), dtype=np.uint16)
            for s in sig:
                x = s[part, None] ^ s[None, :]
                off += np.bitwise_count((x | (x >> np.uint64(1))) & low)
            fit = (count - off >= least) & (label[part, None] != label[None, :])
            fit &= 100 * np.minimum(n[part, None], n[None, :]) >= percent * np.maximum(n[part, None], n[None, :])
            i, j = np.nonzero(fit)
            if len(i):
                label = _merge(label, label[part][i], label[j])
        yield from _edges(comp, label)


def _edges(comp: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
    moved = np.flatnonzero(comp != label)
    if len(moved):
        pairs = np.unique(np.stack([label[moved], comp[moved]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


@_trim
def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of components that hold sets at the threshold or above."""
    for table in groups(batches):
        comp = table.column(1).to_numpy()
        if (comp == comp[0]).all():
            continue
        lists = table.column(2).combine_chunks()
        n = lists.value_lengths().to_numpy()
        items, place, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(n)), n)
        shared = seen[place] > 1
        owner, column = owner[shared], (np.cumsum(seen > 1) - 1)[place[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(n), len(n)), dtype=np.float32)
        width = max(64, 4 * PAIRS // len(n))
        for first in range(0, int((seen > 1).sum()), width):
            p, q = np.searchsorted(column, [first, first + width])
            x = np.zeros((len(n), width), dtype=np.float32)
            x[owner[p:q], column[p:q] - first] = 1
            both += x @ x.T
        label = comp
        step = max(1, PAIRS // len(n))
        for at in range(0, len(n), step):
            part = slice(at, at + step)
            same = both[part].astype(np.int64)
            fit = 100 * same >= percent * (n[part, None] + n[None, :] - same)
            i, j = np.nonzero(fit & (label[part, None] != label[None, :]))
            if len(i):
                label = _merge(label, label[part][i], label[j])
        yield from _edges(comp, label)


def _remaining(
    docs: DataFrame, reps: DataFrame, exploded: DataFrame, sig: DataFrame, comps: DataFrame | None, percent: int
) -> DataFrame | None:
    """Links (a, b) between components that share a bucket; None if there are none."""
    if comps is None:
        own = sig.withColumn("comp", F.col("rid"))
    else:
        own = sig.join(comps, F.col("rid") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "rid"))
    own = own.select("rid", "comp", "n", *_longs(percent))
    members = exploded.join(own.select("rid", "comp"), "rid")
    mixed = members.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = mixed.where("lo != hi").select("key", F.ceil(F.col("c") / SIGNATURES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    m = members.select("key", "rid").join(mixed, "key").withColumn("block", block).join(own, "rid")
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    gid = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    m = m.select(gid.alias("gid"), "comp", "n", *_longs(percent)).repartition("gid").sortWithinPartitions("gid")
    touching = materialize(m.mapInArrow(partial(_touching, percent=percent), "a long, b long"), "touching")
    if not touching.limit(1).count():
        return None

    families = components(touching, "a", "b").select(F.col("node").alias("comp"), F.col("comp").alias("family"))
    need = own.select("rid", "comp", "n").join(families, "comp").join(reps.select("rid", "cls", "need_id", "need_h"), "rid")
    need = materialize(need.withColumn("grade", F.floor(F.log("n") / math.log(100 / percent)).cast("int")), "families")
    sets = _read_sets(docs, need.select("rid", "cls", "need_id", "need_h"))
    # A family of few elements is one block; else it has blocks by grade of size, and only next grades can be linked.
    sizes = need.groupBy("family", "grade").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    blocks = F.greatest(F.ceil(F.col("c") / SETS), F.ceil(F.col("t") / ELEMENTS)).cast("int")
    sizes = sizes.withColumn("blocks", blocks)
    whole = sizes.groupBy("family").agg((F.greatest(F.sum("c") / SETS, F.sum("t") / ELEMENTS) <= 1).alias("whole"))
    sizes = sizes.join(whole, "family")
    one = need.join(sizes.select("family", "grade", "blocks", "whole"), ["family", "grade"])
    near = sizes.select("family", F.explode(F.array(*(F.col("grade") + k for k in (-1, 0, 1)))).alias("grade"), F.col("grade").alias("g2"), F.col("blocks").alias("b2"))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b2") - 1)))
    near = near.groupBy("family", "grade").agg(F.collect_list(F.struct("g2", "other")).alias("partners"))
    small = one.where("whole").select(F.xxhash64("family").alias("gid"), "comp", "rid")
    large = one.where("not whole").join(near, ["family", "grade"])
    here = F.struct(F.col("grade").alias("g2"), F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("other"))
    large = large.withColumn("here", here).withColumn("there", F.explode("partners"))
    gid = F.xxhash64("family", F.least("here", "there"), F.greatest("here", "there"))
    large = large.select(gid.alias("gid"), "comp", "rid")
    rows = small.unionByName(large).join(sets, "rid").select("gid", "comp", "items")
    rows = rows.repartition("gid").sortWithinPartitions("gid")
    out = materialize(rows.mapInArrow(partial(_linked, percent=percent), "a long, b long"), "links")
    return out if out.limit(1).count() else None


def _classified(batches: Iterator[pa.RecordBatch], text: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, q, data, offsets in words.slices(batch.column(text)):
            found = [x.hex().upper() for x in fingerprints(*distinct_shingles(data, offsets))]
            part = batch.slice(p, q - p)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, name])


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: one of each group stays, with all its columns.

    Of rows with a null or a repeated doc_id, one stays for each id and shingle set that is kept.
    """
    found = near_duplicates(docs, percent).select("doc_id", "kept", "shingle_class")
    found = materialize(found, "groups")
    ids = found.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("times"), F.max("kept").alias("any"))
    # Ids whose row doesn't simply stay: far fewer than those whose does.
    other = materialize(ids.where("NOT any OR times > 1 OR id IS NULL").select("id", "any"), "other_ids")
    drop = sized_broadcast(other.select("id"), other.count())
    out = docs.join(drop, docs["doc_id"].eqNullSafe(drop["id"]), "left_anti")
    again = other.where("any").select("id")
    several = again.count()
    if not several:
        return out
    again = sized_broadcast(again, several)
    key = f"_{uuid.uuid4().hex}"  # no column of docs has this name
    keep = found.where("kept").join(again, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    keep = keep.select(F.col("doc_id").alias("id"), F.col("shingle_class").alias("cls")).distinct()
    rest = docs.join(again, docs["doc_id"].eqNullSafe(again["id"]), "left_semi")
    rest = rest.mapInArrow(
        partial(_classified, text=docs.columns.index("text"), name=key), StructType([*docs.schema.fields, StructField(key, StringType())])
    )
    rest = rest.join(keep, rest["doc_id"].eqNullSafe(keep["id"]) & (rest[key] == keep["cls"]), "left_semi")
    return out.unionByName(rest.dropDuplicates(["doc_id", key]).drop(key))
