"""Quality by line labels: a linear-chain conditional random field.

Each line of a text with a word is described by binary features (lengths,
symbols, capitals, repetition, punctuation). Viterbi decoding gives the most
likely sequence of labels, content or boilerplate, and the share of the words
that stand in content lines decides whether the text is kept. Before that, base
rules reject texts that are very short or repeat themselves.

The field is fitted by maximum likelihood to a bounded sample: at most SAMPLE
texts of each quality in the table labels, those with the smallest hashes, in
one task. Their lines, from the first to the last, are cut into runs of RUN lines,
of which at most RUNS of each quality are fitted, those with the smallest hashes.
A line's label in training is its text's quality; since a text has one, CHAIN runs
of different texts are strung together, so that the field sees labels change.

Everything that is counted is counted over whole texts. Words are
``[^\\x20\\x09-\\x0D]+``, as written. Row rules: null text is empty, has no words
and fails the base rules. Without labels all lines are content. Each row of docs
is returned; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import words
from glyphmill.llm.common import sample_of_each, sampled_texts, small_batches, trimmed

#: Texts of each quality, lines of a run, runs of each quality, runs in a sequence; steps and penalty of the fit.
SAMPLE, RUN, RUNS, CHAIN, STEPS, PENALTY = 1500, 10, 6000, 4, 100, 1.0
#: Least words, most percent of repeated words, least share of words in content lines.
LEAST_WORDS, REPEATED, SHARE = 50, 50, 0.5
BOILERPLATE, CONTENT = 0, 1

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[0xC0:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?:;,")] = True


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))


def _first_of_equals(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Mask of what hasn't the same group and value as something earlier."""
    order = np.lexsort((value, group))  # stable: earlier first
    new = np.ones(len(order), dtype=bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (value[order][1:] != value[order][:-1])
    out = np.empty(len(order), dtype=bool)
    out[order] = new
    return out


class Lines:
    """Counts of texts and features of their lines."""

    NAMES = (
        "bias", "1-3 words", "4-10 words", "over 40 words", "symbols in a tenth of the words", "in half of them",
        "capitals a third", "capitals two thirds", "few distinct words", "very few", "repeated line",
        "ends in punctuation", "punctuation in few words", "bars in a fifth of the words", "digits a fifth", "short words", "exclamations",
    )

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        s = words.Slice(data, offsets)
        docs = s.docs
        # Lines: from each text's start or after \n to the next \n or the text's end.
        breaks = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        ends = np.sort(np.concatenate([breaks, offsets[1:]]))
        # A \n at a text's very end, and empty texts, leave pairs of no bytes that hold no word.
        first = np.searchsorted(s.starts, starts)
        last = np.searchsorted(s.starts, ends)
        used = last > first
        self.starts, self.ends, first, last = starts[used], ends[used], first[used], last[used]
        self.doc = s.doc_of_word[first]
        self.words = last - first
        line_of_word = np.repeat(np.arange(len(first)), self.words)
        raw = s.words(lower=False)
        cont = _sums((data & 0xC0) == 0x80)
        symbols, upper, alpha, digit = (_sums(m[data]) for m in (_SYMBOL, _UPPER, _ALPHA, _DIGIT))
        word_offsets = s.word_offsets
        chars = _sums_of(s.ends - s.starts - (cont[s.ends] - cont[s.starts]))

        self.n_words = s.counts
        self.word_chars = chars[word_offsets[1:]] - chars[word_offsets[:-1]]
        self.n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
        same = ~_first_of_equals(self.doc, s.spans(self.starts, self.ends, lower=False))
        self.n_dup_lines = np.bincount(self.doc[same], minlength=docs)
        self.n_repeat_words = self._repeated(s, raw)

        size = self.words.astype(np.float64)
        within = lambda c: c[self.ends] - c[self.starts]
        letters = np.maximum(within(alpha), 1)
        distinct = np.bincount(line_of_word[_first_of_equals(line_of_word, raw)], minlength=len(size))
        has = symbols[s.ends] > symbols[s.starts]
        marked = np.bincount(line_of_word, weights=has, minlength=len(size)) / size
        ending = _STOP[data[s.ends - 1]] if len(s.ends) else np.zeros(0, dtype=bool)
        stops = np.bincount(line_of_word, weights=ending, minlength=len(size)) / size
        lone = data[s.starts] == 124 if len(s.starts) else np.zeros(0, dtype=bool)
        bars = np.bincount(line_of_word, weights=lone & (s.ends - s.starts == 1), minlength=len(size)) / size
        bang = data[s.ends - 1] == 33 if len(s.ends) else np.zeros(0, dtype=bool)
        bangs = np.bincount(line_of_word, weights=bang, minlength=len(size)) / size
        length = (chars[last] - chars[first]) / size
        ratio = distinct / size
        self.x = np.stack(
            [
                np.ones(len(size), dtype=bool), size <= 3, (size > 3) & (size <= 10), size > 40, marked >= 0.1, marked >= 0.5,
                within(upper) >= letters / 3, within(upper) >= letters / 1.5, (ratio < 0.5) & (size >= 8), (ratio < 0.2) & (size >= 8), same,
                ending[last - 1], (stops < 0.02) & (size >= 20), bars >= 0.2, within(digit) * 4 >= letters, length < 3, bangs >= 0.3,
            ],
            axis=1,
        ) if len(size) else np.zeros((0, len(self.NAMES)), dtype=bool)
        #: Where each text's lines begin.
        self.offsets = np.searchsorted(self.doc, np.arange(docs + 1))

    def _repeated(self, s: words.Slice, raw: np.ndarray) -> np.ndarray:
        """Words of each text in windows of three that are found twice or more."""
        n = len(raw) - 2
        if n <= 0:
            return np.zeros(s.docs, dtype=np.int64)
        at = np.flatnonzero(s.doc_of_word[:n] == s.doc_of_word[2:])
        window = words.mix(raw[at], 1) + words.mix(raw[at + 1], 2) * np.uint64(3) + words.mix(raw[at + 2], 3) * np.uint64(5)
        doc = s.doc_of_word[at]
        order = np.lexsort((window, doc))
        same = (doc[order][1:] == doc[order][:-1]) & (window[order][1:] == window[order][:-1])
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        begin = at[order[twice]]
        hit = np.zeros(len(raw), dtype=bool)
        for k in range(3):
            hit[begin + k] = True
        return np.bincount(s.doc_of_word[hit], minlength=s.docs)


def _sums_of(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))


class Field:
    """Weights: (features, 2) of states, (2, 2) from state to state."""

    def __init__(self, state: np.ndarray, move: np.ndarray):
        self.state, self.move = state, move

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels of a text's lines; of equal ones, content."""
        score = (x @ self.state).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        b, c = score[0]
        for s0, s1 in score[1:]:
            from_c0, from_c1 = c + m10 >= b + m00, c + m11 >= b + m01
            back.append((from_c0, from_c1))
            b, c = (c + m10 if from_c0 else b + m00) + s0, (c + m11 if from_c1 else b + m01) + s1
        out = [int(c >= b)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return np.array(out[::-1])


def fit(sequences: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """Maximum likelihood by gradient steps (Adam) over sequences of (features, labels), padded together."""
    size = np.array([len(y) for _, y in sequences])
    steps, n, k = int(size.max()), len(sequences), sequences[0][0].shape[1]
    x = np.zeros((steps, n, k), dtype=np.float32)
    y = np.zeros((steps, n), dtype=np.int64)
    for i, (a, b) in enumerate(sequences):
        x[: len(b), i], y[: len(b), i] = a, b
    live = np.arange(steps)[:, None] < size[None, :]
    gold = np.eye(2)[y] * live[..., None]
    gold_state = np.einsum("tnk,tns->ks", x, gold)
    gold_move = np.einsum("tna,tnb->ab", gold[:-1], gold[1:])
    w = np.zeros(2 * k + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for it in range(1, STEPS + 1):
        state, move = w[: 2 * k].reshape(k, 2), w[2 * k :].reshape(2, 2)
        score = (x @ state).astype(np.float64)
        alpha, beta = np.zeros((steps, n, 2)), np.zeros((steps, n, 2))
        alpha[0] = score[0]
        for t in range(1, steps):
            new = np.logaddexp(alpha[t - 1][:, :1] + move[0], alpha[t - 1][:, 1:] + move[1]) + score[t]
            alpha[t] = np.where(live[t][:, None], new, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            z = beta[t + 1] + score[t + 1]
            new = np.logaddexp(move[:, 0] + z[:, :1], move[:, 1] + z[:, 1:])
            beta[t] = np.where(live[t + 1][:, None], new, 0)
        total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        p = np.exp(alpha + beta - total[None, :, None]) * live[..., None]
        pair = alpha[:-1, :, :, None] + move[None, None] + (score[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]
        pair = np.exp(pair) * live[1:, :, None, None]
        g = np.concatenate([(gold_state - np.einsum("tnk,tns->ks", x, p)).ravel(), (gold_move - pair.sum(axis=(0, 1))).ravel()])
        g = (g - PENALTY * w) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.1 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return Field(w[: 2 * k].reshape(k, 2), w[2 * k :].reshape(2, 2))


def _runs(ids: list[int], good: list[int], column: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(quality, hash, id, features) of each run of lines of the texts."""
    for p, _, data, offsets in words.slices(column):
        lines = Lines(data, offsets)
        for i in range(len(offsets) - 1):
            begin, end = lines.offsets[i : i + 2].tolist()
            at = np.arange(begin, end, RUN)
            name = words.mix(np.array([ids[p + i]], dtype=np.int64).view(np.uint64), 1)
            keys = words.mix(name + np.arange(len(at), dtype=np.uint64), 2).tolist()
            for key, a in zip(keys, at.tolist()):
                yield good[p + i], key, ids[p + i], lines.x[a : min(a + RUN, end)].copy()


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for quality, *run in _runs(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
            own = found.setdefault(quality, [])
            own.append((*run[:2], quality, run[2]))
            if len(own) > 2 * RUNS:
                own.sort(key=lambda f: f[:2])
                del own[RUNS:]
    # By hash: qualities mix, and sums are the same whatever the order of the rows.
    runs = sorted((r for own in found.values() for r in sorted(own, key=lambda f: f[:2])[:RUNS]), key=lambda f: f[:2])
    if runs:
        chains = [runs[i : i + CHAIN] for i in range(0, len(runs), CHAIN)]
        field = fit([(np.concatenate([x for *_, x in c]), np.concatenate([np.full(len(x), q) for _, _, q, x in c])) for c in chains])
        yield pa.RecordBatch.from_pydict({"w": np.concatenate([field.state.ravel(), field.move.ravel()])})


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return trimmed(_train(batches))


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    known = labels.select("doc_id", F.col("quality").cast("int").alias("good")).where("doc_id is not null").dropna()
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("good").alias("good"))
    sample = sample_of_each(known, "good", {0: SAMPLE, 1: SAMPLE}, "label_id")
    rows = sampled_texts(docs, sample).repartition(1)  # at most 2 * SAMPLE rows, in one task
    w = np.array([r["w"] for r in rows.mapInArrow(_trained, "w double").collect()])
    return Field(w[:-4].reshape(-1, 2), w[-4:].reshape(2, 2)) if len(w) else None


def _judge(batches: Iterator[pa.RecordBatch], field: Field | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, q, data, offsets in words.slices(batch.column(1)):
            s = Lines(data, offsets)
            share = np.ones(q - p)
            for i in np.flatnonzero(s.n_words).tolist():
                part = slice(s.offsets[i], s.offsets[i + 1])
                if field is not None:
                    label = field.viterbi(s.x[part])
                    share[i] = s.words[part][label == CONTENT].sum() / s.n_words[i]
            failed = (s.n_words < LEAST_WORDS) | (100 * s.n_repeat_words > REPEATED * s.n_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(p, q - p)]
                + [pa.array(x.astype(np.int64)) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)]
                + [pa.array(failed), pa.array(share), pa.array(~failed & (share >= SHARE))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
            )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed, content_share and kept of every row."""
    small_batches(docs.sparkSession)
    field = train(docs, labels)
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, content_share double, kept boolean"
    )
    return docs.select("doc_id", "text").mapInArrow(partial(_judge, field=field), schema)
