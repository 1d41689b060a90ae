"""What the operators share: tables in the shared folder, bounded broadcasts, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import bounded_batches, importable

#: A side that takes more bytes than this in a table of keys is never broadcast.
BROADCAST_BYTES = 32 << 20
#: Edges of one node that meet in a task; those of a node with more are dealt out.
HOT = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session of one machine (tests) gets a temporary one; on a cluster that is an error,
    since each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/glyphmill/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back.

    Other executors can read the files, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Marks df (columns of fixed or small size) for broadcast if its counted rows stay under the bound; otherwise Spark shuffles.

    A row takes its key and its value with 16 bytes a column at most, and 24 bytes of the table that holds it.
    """
    return F.broadcast(df) if rows * (24 + 32 * len(df.columns)) <= BROADCAST_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: str = "text") -> Column:
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def small_batches(spark: SparkSession) -> None:
    """What a session needs before its workers get texts: the package, and batches of few rows."""
    importable(spark)
    bounded_batches(spark)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes batches on; at their end, gives memory that this worker has freed back to the system.

    Workers are used again by later tasks, and what the allocator keeps would add
    up beside the executor's heap.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def sample_of_each(df: DataFrame, by: str, bounds: dict[int, int], key: str) -> DataFrame:
    """Of the rows with each value of ``by``, at most so many: those with the smallest hashes of ``key``.

    The bounds are parameters, so what is gathered doesn't grow with the data:
    each partition offers its own smallest, and no value's rows meet in one task.
    """
    parts = [df.where(F.col(by) == v).orderBy(F.xxhash64(key), key).limit(n) for v, n in bounds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _is_star(edges: DataFrame) -> bool:
    """Whether each child has one parent and no parent is a child."""
    n = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
    if n["n"] != n["d"]:
        return False
    return edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").limit(1).count() == 0


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """sample (label_id, ...; of bounded size) with doc_id and text: one text for each id, however often it stands in docs.

    Of different texts of one id that of the smallest hash counts; each partition offers one.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    others = [c for c in sample.columns if c != "label_id"]
    rows = rows.groupBy("doc_id", *others).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return rows.select("doc_id", "text", *others)


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of least (u, m, c), where c counts the edges of u: those of a hot u meet m in several tasks."""
    many = least.where(F.col("c") > HOT).select("u", F.ceil(F.col("c") / HOT).cast("int").alias("parts"))
    count = many.count()
    if not count:
        return edges.join(least.select("u", "m"), "u")
    # At most (edges / HOT) rows.
    many = sized_broadcast(many, count)
    parts = F.coalesce("parts", F.lit(1))
    dealt = edges.join(many, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), parts).cast("int").alias("part"))
    each = least.join(many, "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(each, ["u", "part"]).select("u", "v", "m")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, comp): the smallest node reachable, for each node of an edge; other nodes are their own.

    Alternating large-star and small-star contraction. Neighbour lists are never
    gathered: each star is a grouped minimum, which combines before the shuffle,
    and a join in which the edges of a node with more than HOT are dealt to
    several tasks. Each round is written to the shared folder.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u > v")
        .distinct()
    )
    e = materialize(e, "edges")
    while not _is_star(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        least = materialize(least.select("u", F.least("u", "m").alias("m"), "c"), "least")
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u > v").distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "least")
        small = _with_least(large, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "small")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal first column (a long that isn't null), which must stand together, across batches."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if waiting and key[a] != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
            last = key[a]
    if waiting:
        yield pa.Table.from_batches(waiting)
