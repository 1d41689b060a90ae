import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import common, words
from glyphmill.llm import minhash as M
from glyphmill.llm.common import components, groups

SCHEMA = "doc_id long, text string, cls string, rid long, keep_id long"  # clashing extra columns


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent):
    """doc_id to (set size, component) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)


def corpus(seed, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 160))]
        for _ in range(rng.choice([1, 1, 4, 25])):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    passage = " ".join(word() for _ in range(60))
    for _ in range(20):
        rows.append((n, " ".join(word() for _ in range(rng.randint(5, 40))) + " " + passage))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("percent", "seed"), [(85, 1), (80, 2)])
def test_components_equal_brute_force(spark, percent, seed):
    rows = corpus(seed, 4)
    got = M.near_duplicates(table(spark, rows), percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    # Tasks run this process's functions, so the bounds hold where plans are made.
    for name, value in (("SIGNATURES", 4), ("SETS", 3), ("ELEMENTS", 200)):
        monkeypatch.setattr(M, name, value)
    rows = corpus(3, 6)
    got = M.near_duplicates(table(spark, rows), 80).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 80)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [
        (5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE\ttwo"), (9, "ONE\ttwo"), (10, "one two three"), (None, "one two"),
        (None, "x y z"), (None, "x y z"), (3, long), (4, long + " end"), (11, "Élan élan"), (12, "élan élan"),
    ]
    got = M.near_duplicates(table(spark, rows), 85).collect()
    seen = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str)
    assert seen == sorted(
        [
            (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (9, 1, 8, False), (10, 1, 10, True),
            (None, 1, 8, False), (None, 1, None, True), (None, 1, None, True), (3, 119_996, 3, True), (4, 119_997, 3, False),
            (11, 1, 11, True), (12, 1, 12, True),
        ],
        key=str,
    )
    # One row of each group stays: repeated rows and null ids count once.
    kept = M.one_of_each(table(spark, rows), 85)
    assert kept.columns == ["doc_id", "text", "cls", "rid", "keep_id"]
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([5, 6, 7, 8, 10, None, 3, 11, 12], key=str)


def test_patterned_words_do_not_meet(spark):
    flip = lambda n, k: "".join("ab"[(i.bit_count() + k) & 1] for i in range(n))
    rows = [(10 * n + k, " ".join([flip(n, k)] * 7 + [flip(n, k) + str(j) for j in range(3)])) for n in (1024, 4096) for k in (0, 1)]
    got = M.near_duplicates(table(spark, rows), 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 85)
    assert all(r["kept"] for r in got)


def test_null_and_repeated_ids_cost_no_more(spark):
    """Each class is read from one row, so that ids of many rows make no product of rows."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(700):
        w = [word() for _ in range(30)]
        rows += [(None if i % 2 else 7, " ".join(w)), (None if i % 3 else 7, " ".join(w[:-1] + [word()]))]
    rows += [rows[0]] * 50
    df = table(spark, rows).repartition(5)
    got = M.near_duplicates(df, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 85)
    need = df.select("doc_id", "text").distinct().selectExpr("monotonically_increasing_id() AS rid", "doc_id AS need_id", "xxhash64(text) AS need_h", "text")
    cls = M.sketch(df, 85).select("doc_id", "h", "cls").distinct()
    need = need.join(cls, need["need_id"].eqNullSafe(cls["doc_id"]) & (need["need_h"] == cls["h"])).select("rid", "cls", "need_id", "need_h")
    need = common.materialize(need, "need")
    assert M._read_sets(df, need).count() == need.count() == 1400


def test_empty_table(spark):
    assert M.near_duplicates(table(spark, []), 85).count() == 0
    assert M.one_of_each(table(spark, []), 80).count() == 0


def test_hashes_do_not_depend_on_place():
    texts = ["b c d e f g", "a b c d e f g", "x", "B C D E F G", "b c d e f", "", "b c", "c b", "b c d e"]
    whole, at = words.Slice(*next(words.slices(pa.array(texts)))[2:]).shingles(5)
    parts = [set(whole[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    assert parts[0] == parts[3] and parts[0] < parts[1] and parts[4] < parts[0] and parts[5] == set()
    assert len({frozenset(p) for p in parts[6:]} | {frozenset(parts[2])}) == 4 and all(len(p) == 1 for p in parts[6:])
    alone = [set(words.Slice(*next(words.slices(pa.array([t])))[2:]).shingles(5)[0].tolist()) for t in texts]
    assert alone == parts


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(4)
    for overlap in (30, 85, 97):
        common = rng.integers(0, 2**63, overlap * 20).astype(np.uint64)
        other = [rng.integers(0, 2**63, (100 - overlap) * 10).astype(np.uint64) for _ in range(2)]
        sets = [np.concatenate([common, o]) for o in other]
        truth = len(common) / (len(common) + sum(map(len, other)))
        m = M.minima(np.concatenate(sets), np.array([len(s) for s in sets]), 576)
        bits = M._scramble(m) & np.uint32(3)
        estimate = ((bits[:, 0] == bits[:, 1]).mean() - 0.25) / 0.75
        assert abs(estimate - truth) < 0.1
    assert (1 - 0.85**M.ROWS) ** M.bands(85) < 1e-6 and (1 - 0.8**M.ROWS) ** M.bands(80) < 1e-6


def test_components_of_paths_and_stars(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 8)  # the stars below are dealt to several tasks
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 139)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in [*range(100, 140), 200]}


def test_groups_across_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1, 2], [1, 2, 3]), ([2], [4]), ([], []), ([2, 3], [5, 6]))]
    batches[2] = pa.RecordBatch.from_pydict({"k": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    assert [(g.column(0)[0].as_py(), g.column(1).to_pylist()) for g in groups(iter(batches))] == [(1, [1, 2]), (2, [3, 4, 5]), (3, [6])]


def test_a_full_block_of_like_signatures_is_compared_in_little_memory():
    """Signatures of one hot band, all alike and in components of their own: each pair fits, and all become one."""
    n, rng, columns = 2 * M.SIGNATURES, np.random.default_rng(2), [pa.array(np.zeros(2 * M.SIGNATURES, np.int64))]
    columns += [pa.array(np.arange(n)), pa.array(np.full(n, 300))]
    names = ["gid", "comp", "n", *M._longs(80)]
    columns += [pa.array(np.where(rng.random(n) < 0.97, rng.integers(1 << 62), rng.integers(1 << 62, size=n))) for _ in names[3:]]
    batches = pa.table(columns, names).to_batches(max_chunksize=1000)
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(list(M._touching(iter(batches), percent=80)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(got["a"].to_pylist()) == {0} and got["b"].to_pylist() == list(range(1, n))
    assert peak < 100_000_000
