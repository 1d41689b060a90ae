"""Nearest neighbours by a robust-pruned directed graph (Vamana) in each shard.

Equal vectors are one node of the graph, named by their length and a 128-bit
hash, with their smallest ids beside it: no list of neighbours can need more than
k + 1 ids of one vector. Nodes are dealt to shards by that hash. In each shard
every node in turn is looked for by a greedy search from the shard's medoid; the
nodes it came by are the candidates for its neighbours. Pruning takes the nearest
candidate, drops all others that are nearer to it, by a factor ``alpha``, than to
the node, and goes on with the next; so edges stay few and lead in all
directions. Back edges are added, and a node that has half as many again as it
may keep is pruned alike. Two passes, the second with alpha over 1. Searches of
many nodes run side by side in numpy.

Each vector that a query asks for is looked for once in each shard by beam
search, in blocks of a bounded number of vectors; distances of what it finds are
computed anew in double precision on the original vectors, and the shards'
findings are merged.

Row rules: rows with a null id, or a vector that is null, empty, zero, or holds a
null or non-finite component, take no part. Vectors of different lengths are no
neighbours. Rows that share an id are one candidate, by their nearest vector, and
one query: a repeated row counts once, and of an id with several vectors the
nearest to any of them count. A query without other ids of its length has no
results. An empty table gives none.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize
from glyphmill.session import importable

#: Nodes of a shard on average; neighbours of a node; width of the beam in building and in searching.
SHARD, DEGREE, BUILD, SEARCH = 16384, 32, 48, 128
ALPHAS = (1.0, 1.2)
#: Queries that one task holds; more come in blocks, for each of which a shard's graph is built.
QUERIES = 200_000
#: Nodes expanded at once, searches side by side.
EXPAND, SIDE = 8, 256
_FAR = np.float32(np.inf)


def _distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of rows q to the nodes ids, row by row; infinite for id -1."""
    d = norms[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0] + np.einsum("md,md->m", q, q)[:, None]
    return np.where(ids < 0, _FAR, np.maximum(d, 0))


class Graph:
    def __init__(self, x: np.ndarray, degree: int = DEGREE, build: int = BUILD, seed: int = 7):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.norms = np.einsum("nd,nd->n", self.x, self.x)
        n = len(x)
        self.degree = degree
        rng = np.random.default_rng(seed)
        self.medoid = int(np.argmin(self.norms - 2 * self.x @ self.x.mean(axis=0)))
        # Room for half as many back edges, so that they are pruned together.
        self.out = np.full((n, degree + degree // 2), -1, dtype=np.int32)
        self.out[:, :degree] = rng.integers(0, n, (n, degree), dtype=np.int32)
        self.out[self.out == np.arange(n)[:, None]] = -1
        for alpha in ALPHAS:
            order = rng.permutation(n)
            for at in range(0, n, SIDE):
                self._insert(order[at : at + SIDE], build, alpha)
        many = np.flatnonzero((self.out >= 0).sum(axis=1) > degree)
        for at in range(0, len(many), SIDE):
            self.out[many[at : at + SIDE]] = self._prune(many[at : at + SIDE], self.out[many[at : at + SIDE]], ALPHAS[-1])
        self.out = np.ascontiguousarray(-np.sort(-self.out, axis=1)[:, :degree])

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the beam at the end, nearest first; -1 where it has fewer. Also keeps ``self.seen``."""
        m, n = len(q), len(self.x)
        rows = np.arange(m)
        beam = np.full((m, width), -1, dtype=np.int32)
        near = np.full((m, width), _FAR, dtype=np.float32)
        done = np.ones((m, width), dtype=bool)
        beam[:, 0], near[:, 0], done[:, 0] = self.medoid, _distances(self.x, self.norms, q, np.full((m, 1), self.medoid))[:, 0], False
        met = np.zeros((m, n), dtype=bool)
        met[:, self.medoid] = True
        size = np.einsum("md,md->m", q, q)
        expanded = []
        while not done.all():
            # The nearest open nodes of each beam; beams are sorted.
            rank = np.cumsum(~done, axis=1)
            pick = ~done & (rank <= EXPAND)
            done |= pick
            slot = np.full((m, EXPAND), -1, dtype=np.int32)
            i, j = np.nonzero(pick)
            slot[i, rank[i, j] - 1] = beam[i, j]
            expanded.append(slot)
            new = np.where(slot[:, :, None] < 0, -1, self.out[slot]).reshape(m, -1)
            new[met[rows[:, None], new] | (new < 0)] = -1
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.sort(new, axis=1)[:, ::-1][:, : max(1, int((new >= 0).sum(axis=1).max()))]  # few are new
            i, j = np.nonzero(new >= 0)
            ids = new[i, j]
            met[i, ids] = True
            d = np.full(new.shape, _FAR, dtype=np.float32)
            d[i, j] = np.maximum(self.norms[ids] - 2 * np.einsum("nd,nd->n", self.x[ids], q[i]) + size[i], 0)
            beam, near = np.concatenate([beam, new], axis=1), np.concatenate([near, d], axis=1)
            done = np.concatenate([done, new < 0], axis=1)
            part = np.argpartition(near, width - 1, axis=1)[:, :width]
            part = np.take_along_axis(part, np.argsort(np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)
            beam, near, done = (np.take_along_axis(z, part, 1) for z in (beam, near, done))
        self.seen = np.concatenate(expanded, axis=1) if expanded else np.zeros((m, 0), dtype=np.int32)
        return beam, near

    def _prune(self, nodes: np.ndarray, found: np.ndarray, alpha: float) -> np.ndarray:
        """The pruned neighbours of nodes among found (-1: none), a row each."""
        q = self.x[nodes]
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[found == nodes[:, None]] = -1
        d = _distances(self.x, self.norms, q, found)
        order = np.argsort(d, axis=1, kind="stable")[:, : 4 * self.degree]
        found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
        out = np.full((len(nodes), self.out.shape[1]), -1, dtype=np.int32)
        open_ = found >= 0
        rows = np.arange(len(nodes))
        limit = np.float32(alpha * alpha)
        c = self.x[found]
        norms = self.norms[found]
        for k in range(self.degree):
            best = np.argmax(open_, axis=1)  # sorted: the first open one is nearest
            live = open_[rows, best]
            if not live.any():
                break
            out[live, k] = found[rows, best][live]
            between = norms + norms[rows, best][:, None] - 2 * np.matmul(c, c[rows, best][:, :, None])[:, :, 0]
            open_ &= ~((limit * between <= d) & live[:, None])
            open_[rows, best] = False
        return out

    def _insert(self, nodes: np.ndarray, build: int, alpha: float) -> None:
        beam, _ = self.search(self.x[nodes], build)
        found = np.concatenate([self.seen, beam, self.out[nodes]], axis=1)
        self.out[nodes] = self._prune(nodes, found, alpha)
        # Back edges, grouped by the node they start from.
        back = self.out[nodes]
        i, j = np.nonzero(back >= 0)
        start, target = back[i, j], nodes[i]
        order = np.lexsort((target, start))
        start, target = start[order], target[order]
        own, first, count = np.unique(start, return_index=True, return_counts=True)
        rank = np.arange(len(start)) - np.repeat(first, count)
        extra = np.full((len(own), int(count.max()) if len(own) else 0), -1, dtype=np.int32)
        extra[np.repeat(np.arange(len(own)), count), rank] = target
        # Those with room take them; the others are pruned.
        for at in range(0, len(own), SIDE):
            part = own[at : at + SIDE]
            new = extra[at : at + SIDE]
            known = (new[:, :, None] == self.out[part][:, None, :]).any(axis=2)
            new = np.where(known, -1, new)
            both = np.concatenate([self.out[part], new], axis=1)
            full = (both >= 0).sum(axis=1) > self.out.shape[1]
            both = -np.sort(-both, axis=1)
            self.out[part[~full]] = both[~full][:, : self.out.shape[1]]
            if full.any():
                self.out[part[full]] = self._prune(part[full], both[full], alpha)


def _vectors(table: pa.Table, column: str) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _search(nodes: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """q1, q2, k1, k2, least, score: the nodes that one shard finds for each vector, until they hold k + 1 least ids."""
    if not nodes.num_rows or not queries.num_rows:
        return pa.Table.from_pydict({f.name: [] for f in _FOUND}, schema=_FOUND)
    key = [nodes.column(c).to_numpy() for c in ("k1", "k2")]
    order = np.lexsort(key[::-1])  # the same graph whatever the order of the rows
    k1, k2, least = (x[order] for x in (*key, nodes.column("least").to_numpy()))
    x = _vectors(nodes, "embedding")[order]
    q, names = _vectors(queries, "embedding"), [queries.column(c).to_numpy() for c in ("q1", "q2")]
    graph = Graph(x)
    out = []
    for at in range(0, len(q), SIDE):
        beam, _ = graph.search(q[at : at + SIDE].astype(np.float32), max(SEARCH, 4 * (k + 1)))
        exact = x[beam].astype(np.float64) - q[at : at + SIDE, None, :].astype(np.float64)
        d = np.where(beam < 0, np.inf, np.sqrt((exact * exact).sum(axis=2)))
        best = np.lexsort((least[beam], d), axis=1)
        d, found = np.take_along_axis(d, best, 1), np.take_along_axis(beam, best, 1)
        keep = np.isfinite(d) & (_earlier(least[found]) <= k)
        i, j = np.nonzero(keep)
        n = found[i, j]
        out.append((names[0][at + i], names[1][at + i], k1[n], k2[n], least[n], d[i, j]))
    return pa.Table.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], schema=_FOUND)


def _earlier(ids: np.ndarray) -> np.ndarray:
    """How many distinct ids stand before each place of its row."""
    order = np.argsort(ids, axis=1, kind="stable")
    row = np.take_along_axis(ids, order, 1)
    first = np.ones(ids.shape, dtype=np.int64)
    first[:, 1:] = row[:, 1:] != row[:, :-1]
    new = np.empty_like(first)
    np.put_along_axis(new, order, first, 1)
    return np.cumsum(new, axis=1) - new


_FOUND = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("least", pa.int64()), ("score", pa.float64())])


def usable(vec_id: str = "vec_id", embedding: str = "embedding") -> Column:
    """Whether a row takes part."""
    e = F.col(embedding)
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(vec_id).isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, among all rows but its own."""
    importable(vectors.sparkSession)
    rows = vectors.where(usable()).select(
        "vec_id", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), "embedding",
    )
    # A row for each id and vector, combined before the shuffle; then the smallest ids of each vector, limited before it too.
    rows = rows.groupBy("dim", "k1", "k2", "vec_id").agg(F.max("asks").alias("asks"), F.first("embedding").alias("embedding"))
    rows = materialize(rows, "vectors")
    by = Window.partitionBy("dim", "k1", "k2").orderBy("vec_id")
    few = rows.select("dim", "k1", "k2", "vec_id", "embedding").withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    few = materialize(few.withColumn("embedding", F.when(F.col("r") == 1, F.col("embedding"))), "classes")
    nodes = few.where("r = 1").select("dim", "k1", "k2", F.col("vec_id").alias("least"), "embedding")
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), "dim", F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    asked = asking.select("dim", F.col("q1").alias("k1"), F.col("q2").alias("k2")).distinct()
    asked = materialize(nodes.join(asked, ["dim", "k1", "k2"], "left_semi"), "asked")
    # A row for each length of vector: its shards, and the blocks its queries come in.
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard).alias("shards"))
    sizes = sizes.join(asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")), "dim")
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    place = F.xxhash64("dim", "s", "block").alias("place")
    dealt = nodes.join(sizes, "dim").withColumn("s", F.pmod(F.xxhash64("k1"), F.col("shards"))).withColumn("block", up_to("blocks"))
    dealt = dealt.select(place, "k1", "k2", "least", "embedding")
    queries = asked.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("k2"), F.col("blocks"))).withColumn("s", up_to("shards"))
    queries = queries.select(place, F.col("k1").alias("q1"), F.col("k2").alias("q2"), "embedding")
    found = dealt.groupBy("place").cogroup(queries.groupBy("place")).applyInArrow(
        partial(_search, k=k), "q1 long, q2 long, k1 long, k2 long, least long, score double"
    )
    # Over all shards the same as in each: nodes until they hold k + 1 least ids.
    asks = ["q1", "q2"]
    first = F.row_number().over(Window.partitionBy(*asks, "least").orderBy("score", "k1", "k2"))
    found = found.repartition(*asks).withColumn("new", (first == 1).cast("int"))
    nearest = Window.partitionBy(*asks).orderBy("score", "least", "k1", "k2")
    before = F.sum("new").over(nearest.rowsBetween(Window.unboundedPreceding, 0)) - F.col("new")
    found = found.withColumn("before", before).where(F.col("before") <= k).select(*asks, "k1", "k2", "score")
    pairs = found.join(few.select("k1", "k2", "vec_id"), ["k1", "k2"]).groupBy(*asks, "vec_id").agg(F.min("score").alias("score"))
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy(*asks).orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    # At most k + 1 for each vector; a query leaves out itself.
    lists = ranked.groupBy(*asks).agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))
    own = asking.join(lists, asks).select("query_id", F.explode("near").alias("n")).select("query_id", "n.vec_id", "n.score")
    own = own.where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
