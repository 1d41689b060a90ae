"""Packing into optimal length buckets.

Documents longer than ``max_length`` are cut into pieces of that length and a
rest, so nothing is dropped. The histogram of piece lengths, at most
``max_length`` numbers whatever the corpus, goes to the driver, where dynamic
programming chooses at most ``buckets`` boundaries that minimise padding: a
piece is padded to the boundary at or above its length. Of equal choices the
smaller lower boundary wins. Batches of ``budget`` tokens form inside each
bucket: budget // boundary sequences (one at least), by doc_id and piece. Row
numbers come from counts of ranges of the order and their running sums, so no
task has to order a whole bucket.

A document's length is its number of words and one end token: null or blank text
has length 1. Row rules: null doc_ids come first; rows that share a doc_id are
ordered by length, and each row is packed. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize

#: Longest sequence, number of buckets, tokens of a batch.
MAX_LENGTH, BUCKETS, BUDGET = 2048, 8, 16384


def words_and_end(text: Column) -> Column:
    """Words of a text, and one. Trimming first leaves as many parts as words, or one empty part."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.lit(1)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")) + 1).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least padding in all.

    best[k][j]: least padding of the first j distinct lengths in k buckets. A bucket
    over lengths i+1..j costs length_j * pieces - tokens. Exact, by all i for each j.
    """
    if not lengths:
        return []
    size = np.array(lengths, dtype=np.float64)
    count = np.array(counts, dtype=np.float64)
    pieces = np.concatenate(([0], np.cumsum(count)))
    tokens = np.concatenate(([0], np.cumsum(count * size)))
    n = len(lengths)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    history = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (pieces[j] - pieces[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        history.append((new, cut))
        best = new
    out, j = [], n
    for _, cut in reversed(history):
        out.append(lengths[j - 1])
        j = int(cut[j])
        if not j:
            break
    return out[::-1]


def pack(
    docs: DataFrame, length: Column | None = None, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bucket, padded, batch, slot of every piece of every row."""
    length = words_and_end(F.col("text")) if length is None else length
    sized = docs.select("doc_id", length.cast("long").alias("length"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / max_length)))
    pieces = sized.where("length > 0").withColumn("piece", piece).select(
        "doc_id", "piece", (F.col("piece") * max_length).alias("first_token"),
        F.least(F.lit(max_length).cast("long"), F.col("length") - F.col("piece") * max_length).alias("n_tokens"), "length",
    )
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = sorted((r["n_tokens"], r["c"]) for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("c")).collect())
    bounds = boundaries([n for n, _ in histogram], [c for _, c in histogram], buckets) or [max_length]
    bucket, padded = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for k in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)
        padded = F.when(F.col("n_tokens") <= bounds[k], F.lit(bounds[k])).otherwise(padded)

    # Ranges of the wanted order, numbered as they are written; equal rows are told apart by the row's own number.
    order = ["bucket", "doc_id", "piece", "length", "row"]
    placed = pieces.withColumn("bucket", bucket).withColumn("padded", padded.cast("long"))
    placed = placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "placed")
    counts = placed.groupBy("bucket", "part").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("bucket", "part", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(*order[1:])) - 1 + F.col("before")
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded")))
    return placed.join(counts, ["bucket", "part"]).withColumn("at", at).select(
        "doc_id", "piece", "first_token", "n_tokens", F.col("bucket").cast("long").alias("bucket"), "padded",
        F.floor(F.col("at") / fit).alias("batch"), (F.col("at") % fit).alias("slot"),
    )


def oracle_sql(max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """DuckDB SQL for ``pack`` over the table documents; one CTE for each number of buckets."""
    steps = [
        "docs AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS length FROM documents)",
        f"pieces AS (SELECT doc_id, length, unnest(range(0, CAST(floor((length - 1) / {max_length}) AS BIGINT) + 1)) AS piece FROM docs)",
        f"sized AS (SELECT *, least({max_length}, length - piece * {max_length}) AS n FROM pieces)",
        "hist AS (SELECT n, count(*) AS c, row_number() OVER (ORDER BY n) AS j FROM sized GROUP BY n)",
        "cum AS (SELECT j, n, sum(c) OVER (ORDER BY j) AS p, sum(c * n) OVER (ORDER BY j) AS t FROM hist"
        " UNION ALL SELECT 0, 0, 0, 0)",
        "dp0 AS (SELECT 0 AS j, 0 AS cost, []::BIGINT[] AS bounds)",
    ]
    for k in range(1, buckets + 1):
        steps.append(
            f"dp{k} AS (SELECT j, cost, bounds FROM (SELECT b.j, d.cost + b.n * (b.p - a.p) - (b.t - a.t) AS cost,"
            " list_append(d.bounds, b.n) AS bounds,"
            " row_number() OVER (PARTITION BY b.j ORDER BY d.cost + b.n * (b.p - a.p) - (b.t - a.t), a.j) AS r"
            f" FROM dp{k - 1} d JOIN cum a ON a.j = d.j JOIN cum b ON b.j > a.j) WHERE r = 1)"
        )
    last = " UNION ALL ".join(f"SELECT {k} AS k, j, bounds FROM dp{k}" for k in range(1, buckets + 1))
    steps += [
        f"best AS (SELECT bounds FROM ({last}) WHERE j = (SELECT max(j) FROM hist)"
        f" AND k = least({buckets}, (SELECT max(j) FROM hist)))",
        "limits AS (SELECT unnest(bounds) AS padded, unnest(range(0, len(bounds))) AS bucket FROM best)",
        f"placed AS (SELECT s.*, l.padded, l.bucket, greatest(1, CAST(floor({budget} / l.padded) AS BIGINT)) AS fit FROM sized s JOIN limits l"
        " ON l.padded = (SELECT min(padded) FROM limits m WHERE m.padded >= s.n))",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, piece, length) - 1 AS place"
        " FROM placed)",
    ]
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, piece::BIGINT AS piece, (piece * {max_length})::BIGINT AS first_token,"
        " n::BIGINT AS n_tokens, bucket::BIGINT AS bucket, padded::BIGINT AS padded, CAST(floor(place / fit) AS BIGINT) AS batch,"
        " (place % fit)::BIGINT AS slot FROM numbered"
    )
