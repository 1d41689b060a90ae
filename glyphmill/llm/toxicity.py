"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over
the presence of words and of word beginnings of 3 to 10 bytes; each later model
also gets the earlier categories' probabilities. The models are trained with
out-of-fold probabilities: those of a row come from models that haven't seen it,
so later models learn how much the earlier ones can be trusted on new rows.

Training uses a bounded sample: at most SAMPLE labelled texts with the last
category and twice as many without, those with the smallest hashes, in one task.
FEATURES hashed features are kept, by chi-square over all categories.

Row rules: null text is empty and gets the models' base rate. Rows of labels
with a null id or category are not learned from; if an id has several, the
largest value of each category counts, and of an id with several texts one. Without labelled rows every probability is
0. Each row of docs is returned; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import words
from glyphmill.llm.common import sample_of_each, sampled_texts, small_batches, trimmed

#: Sampled rows with the last category, features kept, folds, weight of the penalty.
SAMPLE, FEATURES, FOLDS, PENALTY = 2000, 512, 3, 0.3
#: Probability of the last category from which a document is rejected.
THRESHOLD = 0.4
_BITS = 22
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each feature, feature): words and word beginnings, hashed to 22 bits."""
    for p, q, data, offsets in words.slices(pc.utf8_lower(pc.fill_null(column, ""))):
        s = words.Slice(data, offsets, _LETTERS[data])
        size = s.ends - s.starts
        own, out = [s.doc_of_word], [s.spans(s.starts, s.ends)]
        for n in range(3, 11):
            long = np.flatnonzero(size > n)
            own.append(s.doc_of_word[long])
            out.append(words.mix(s.spans(s.starts[long], s.starts[long] + n), n))
        yield p, q, np.concatenate(own), (np.concatenate(out) >> np.uint64(64 - _BITS)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a penalised logistic model, bias last and free, by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    penalty = np.full(x1.shape[1], PENALTY)
    penalty[-1] = 1e-6
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x1.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    for _ in range(25):
        p = _sigmoid(x1 @ w)
        gradient = x1.T @ (p - y) + penalty * w
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def train_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """A model for each column of y; the k-th takes x and the probabilities of the k categories before."""
    models = []
    for k in range(y.shape[1]):
        models.append(fit(x, y[:, k]))
        out = np.zeros(len(x))
        for f in range(FOLDS):
            test = fold == f
            if test.any():
                seen = fit(x[~test], y[~test, k]) if (~test).any() else models[-1]
                out[test] = predict(x[test], seen)
        x = np.hstack([x, out[:, None]])
    return models


def _train(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    """From doc_id, text and categories to rows: place of a weight, feature (-1: a probability or bias), weight."""
    rows, found, labels, ids, total = [], [], [], [], 0
    for batch in batches:
        for p, q, own, feature in features(batch.column(1)):
            pairs = np.unique((own << _BITS) | feature)
            rows.append(((pairs >> _BITS) + total + p).astype(np.int32))
            found.append((pairs & ((1 << _BITS) - 1)).astype(np.int32))
        labels.append(np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(count)], axis=1))
        ids.append(batch.column(0).to_numpy())
        total += batch.num_rows
    if not total:
        return
    y, ids = np.concatenate(labels).astype(np.float64), np.concatenate(ids)
    order = np.argsort(ids, kind="stable")  # the same sums whatever the order of the rows
    place = np.empty(total, dtype=np.int64)
    place[order] = np.arange(total)
    y, ids = y[order], ids[order]
    # Counts over all hashed features, slice by slice: no copy of all pairs.
    seen = np.zeros(1 << _BITS, dtype=np.int32)
    hits = np.zeros((count, 1 << _BITS), dtype=np.int32)
    for k, (row, feature) in enumerate(zip(rows, found)):
        rows[k] = row = place[row].astype(np.int32)
        seen += np.bincount(feature, minlength=1 << _BITS).astype(np.int32)
        for c in range(count):
            hits[c] += np.bincount(feature[y[row, c] > 0], minlength=1 << _BITS).astype(np.int32)
    some = np.flatnonzero(seen >= 3)
    best = np.zeros(len(some))
    for c in range(count):
        n1, n = y[:, c].sum(), seen[some].astype(np.float64)
        expected = n * n1 / total
        spread = np.maximum(expected * (1 - n1 / total) * (1 - n / total), 1e-9)
        best = np.maximum(best, (hits[c, some] - expected) ** 2 / spread)
    kept = np.sort(np.argsort(-best, kind="stable")[:FEATURES])
    values = some[kept[best[kept] > 10.8]]  # chi-square of one degree at 0.001
    slot = np.full(1 << _BITS, -1, dtype=np.int16)
    slot[values] = np.arange(len(values))
    x = np.zeros((total, len(values)))
    for row, feature in zip(rows, found):
        hit = slot[feature] >= 0
        x[row[hit], slot[feature[hit]]] = 1
    fold = (words.mix(ids.view(np.uint64), 5) % np.uint64(FOLDS)).astype(np.int64)
    out_k, out_i, out_f, out_w = [], [], [], []
    for k, w in enumerate(train_chain(x, y, fold)):
        out_k += [k] * len(w)
        out_i += range(len(w))
        out_f += [*values.tolist(), *[-1] * (len(w) - len(values))]
        out_w += w.tolist()
    yield pa.RecordBatch.from_pydict({"k": out_k, "i": out_i, "feature": out_f, "w": out_w}, schema=_MODEL)


def _trained(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    return trimmed(_train(batches, count))


_MODEL = pa.schema([("k", pa.int32()), ("i", pa.int32()), ("feature", pa.int32()), ("w", pa.float64())])


class Chain:
    """Trained models: kept features and their weights for each category."""

    def __init__(self, rows: list, categories: list[str]):
        self.categories = categories
        by: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["k"], r["i"])):
            by.setdefault(r["k"], []).append((r["feature"], r["w"]))
        self.kept = np.array([f for f, _ in by.get(0, []) if f >= 0], dtype=np.int64)
        self.weights = [np.array([w for _, w in by[k]]) for k in sorted(by)]
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def __call__(self, column: pa.Array) -> np.ndarray:
        """(rows, categories) of probabilities."""
        out = np.zeros((len(column), len(self.categories)))
        if not self.weights:
            return out
        if self._table is None:
            self._table = np.full(1 << _BITS, -1, dtype=np.int16)
            self._table[self.kept] = np.arange(len(self.kept))
        n = len(self.kept)
        for p, q, own, feature in features(column):
            slot = self._table[feature]
            hit = np.flatnonzero(slot >= 0)
            pairs = np.unique(own[hit] * max(n, 1) + slot[hit])
            row, slot = pairs // max(n, 1), pairs % max(n, 1)
            for k, w in enumerate(self.weights):
                score = np.bincount(row, weights=w[slot], minlength=q - p) + out[p:q, :k] @ w[n : n + k] + w[-1]
                out[p:q, k] = _sigmoid(score)
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str]) -> Chain:
    """A chain over categories: name to a SQL expression over labels that is 0 or 1, in order."""
    names = list(categories)
    cols = [F.expr(e).cast("int").alias(f"c{k}") for k, e in enumerate(categories.values())]
    known = labels.select("doc_id", *cols).where("doc_id is not null").dropna()
    known = known.groupBy("doc_id").agg(*(F.max(f"c{k}").alias(f"c{k}") for k in range(len(names))))
    last = f"c{len(names) - 1}"
    sample = sample_of_each(known, last, {1: SAMPLE, 0: 2 * SAMPLE}, "doc_id").withColumnRenamed("doc_id", "label_id")
    rows = sampled_texts(docs, sample).repartition(1)  # at most 3 * SAMPLE rows, in one task
    found = rows.mapInArrow(partial(_trained, count=len(names)), "k int, i int, feature int, w double").collect()
    return Chain(found, names)


def _score(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = chain(batch.column(1))
        toxic = p[:, -1] >= THRESHOLD
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(toxic), pa.array(~toxic)],
            names=["doc_id", *(f"p_{c}" for c in chain.categories), "toxic", "kept"],
        )


#: The two categories of the table labels; the last one decides.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """doc_id, a probability p_<category> of each category, toxic, kept of every row."""
    small_batches(docs.sparkSession)
    chain = train(docs, labels, categories or CATEGORIES)
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories) + ", toxic boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(partial(_score, chain=chain), schema)


def _keep(batches: Iterator[pa.RecordBatch], chain: Chain, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(chain(batch.column(text))[:, -1] < THRESHOLD))


def not_toxic(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    small_batches(docs.sparkSession)
    chain = train(docs, labels, categories or CATEGORIES)
    return docs.mapInArrow(partial(_keep, chain=chain, text=docs.columns.index("text")), docs.schema)
