import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import ann, langid, quality, toxicity
from glyphmill.llm.common import sampled_texts

GOOD = "The text of the day is what we want to have, and it goes on for a while. It is good."


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:420] = x[7]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.neighbours(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=10, shard=300).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in mine)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & set(order))
    assert hit >= 0.9 * 90
    # All ten nearest of the hot vector's member are its copies of smallest id.
    assert [i for _, i, _ in sorted(found[300])] == [7, *range(301, 310)]


def nearest(rows, asks, k):
    """query_id, rank, vec_id, score by all pairs: an id's nearest vector counts, to any vector of the query's id."""
    by = {}
    for i, v in rows:
        by.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = []
    for q in filter(asks, by):
        d = sorted((min(float(np.sqrt(((a - b) ** 2).sum())) for a in by[q] for b in by[i]), i) for i in by if i != q)
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d[:k])]
    return sorted(out)


def test_repeated_rows_and_ids_with_several_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, size=(260, 6)).astype(np.float32)  # whole numbers: many ties
    x[x.sum(axis=1) == 0, 0] += 1
    x[~x.any(axis=1), 0] = 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0]] * 2 + [rows[100]] * 30  # query rows twice and more
    rows += [(200, x[5].tolist()), (9, x[100].tolist()), (9, (x[9] + 100).tolist())]  # a query and a candidate with several vectors
    rows += [(7, (x[200] + k / 64).tolist()) for k in range(1, 40)] + [(300 + k, x[11].tolist()) for k in range(40)]  # an id with many near vectors; a hot vector
    got = ann.neighbours(vectors(spark, rows).repartition(4), F.col("vec_id") % 100 == 0, k=10, shard=80).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    want = nearest(rows, lambda i: i % 100 == 0, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_recall_over_full_shards(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(7000, 32)).astype(np.float32)
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = ann.neighbours(df, F.col("vec_id") % 100 == 0, k=10, shard=2048).collect()
    hit = 0
    for q in range(0, 7000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 700 and hit >= 0.9 * 700


def test_vectors_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]),
        (7, [0.0, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (200, [5.0, 5.0]),
    ]
    got = ann.neighbours(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=3).collect()
    found = {q: [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100, 200)}
    assert found[0] == [(1, 8), (2, 7), (3, 200)] and found[100] == [] and [i for _, i in found[200]] == [0, 7, 8]
    assert ann.neighbours(vectors(spark, []), F.lit(True)).count() == 0
    assert ann.neighbours(vectors(spark, rows[:1]), F.lit(True)).count() == 0


def test_pruned_graph_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    g = ann.Graph(x)
    assert ((g.out >= 0).sum(axis=1) <= ann.DEGREE).all() and (g.out != np.arange(3000)[:, None]).all()
    beam, _ = g.search(x[:100], 64)
    d = ((x[:100, None].astype(float) - x[None]) ** 2).sum(axis=2)
    truth = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len(set(beam[i, :10]) & set(truth[i])) / 10 for i in range(100)]) > 0.9


# Quality.


def plain_counts(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    three = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if three[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_counts_against_a_plain_version():
    rng = random.Random(4)
    pieces = ["a", "b", "the", "é漢", " ", " ", "\n", "\t", "#", "|", "a b c", "x\ny", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["", "\n", "a", "\n\na\n\n"]
    got = []
    for _, _, data, offsets in quality.words.slices(pa.array(texts)):
        s = quality.Lines(data, offsets)
        got += list(zip(*(x.tolist() for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words))))
    assert got == [plain_counts(t) for t in texts]


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, k = int(rng.integers(1, 8)), 3
        field = quality.Field(rng.normal(size=(k, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, k))

        def score(y):
            return sum((x[i] @ field.state)[y[i]] for i in range(n)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))

        best = max(([(m >> i) & 1 for i in range(n)] for m in range(2**n)), key=score)
        assert field.viterbi(x).tolist() == best


def test_field_learns_sequences():
    rng = np.random.default_rng(6)
    seqs = []
    for _ in range(60):
        y = np.repeat(rng.integers(0, 2, 3), 4)
        noisy = y ^ (rng.random(12) < 0.2)
        seqs.append((np.stack([np.ones(12), noisy], axis=1), y))
    field = quality.fit(seqs)
    right = np.mean([(field.viterbi(x) == y).mean() for x, y in seqs])
    assert right > 0.8 and field.move[0, 0] > field.move[0, 1]


def test_quality_of_a_table(spark):
    rng = random.Random(7)
    words = "the of and to in is it that was for on are with as his they at be this from have or by one had not but what all were".split()
    prose = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(12)) + "."
    junk = lambda: " | ".join(rng.choice(words) + rng.choice(words) for _ in range(80))
    rows = [(i, prose() if i % 2 else junk()) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    odd = [(100, None), (101, ""), (102, "word"), (103, "a b c " * 100), (None, prose()), (104, (prose() + " ") * 400)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, good int")
    got = {r["doc_id"]: r for r in quality.judge(df, labels).collect()}
    assert all(got[i]["kept"] == bool(i % 2) and not got[i]["base_failed"] for i in range(60))
    assert [got[i]["base_failed"] for i in (100, 101, 102, 103)] == [True] * 4 and not got[100]["kept"] and got[None]["kept"]
    assert got[104]["n_repeat_words"] == got[104]["n_words"]
    none = quality.judge(df, labels.limit(0)).collect()
    assert len(none) == 66 and all(r["kept"] != r["base_failed"] for r in none)
    assert quality.judge(df.limit(0), labels).count() == 0


def prose_and_junk(seed):
    rng = random.Random(seed)
    words = "the of and to in is it that was for on are with as his they at be this from have or by one had not but what all were".split()
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(8, 16))).capitalize() + "."
    junk = lambda: " | ".join(rng.choice(words).upper() for _ in range(rng.randint(3, 9)))
    return rng, prose, junk


def test_lines_of_mixed_texts(spark):
    """Trained on texts of one kind, the field labels the lines of texts of both, short runs too."""
    rng, prose, junk = prose_and_junk(12)
    rows = [(i, "\n".join((prose if i % 2 else junk)() for _ in range(rng.randint(6, 25)))) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    field = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    right, lines, shares = 0, 0, []
    for _ in range(60):
        gold, text = [], []
        for k in range(rng.randint(2, 5)):
            n = rng.randint(2, 8)
            gold += [k % 2] * n
            text += [(prose if k % 2 else junk)() for _ in range(n)]
        data = "\n".join(text).encode()
        found = quality.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        label = field.viterbi(found.x)
        right, lines = right + (label == np.array(gold)).sum(), lines + len(gold)
        shares.append(found.words[label == 1].sum() / found.words.sum())
    assert right >= 0.95 * lines and sum(0.1 < s < 0.9 for s in shares) > 30


def test_lines_after_the_hundredth_are_learned(spark):
    """Texts that differ only far behind their beginnings; runs are bounded, texts aren't cut."""
    rng, prose, junk = prose_and_junk(13)
    same = [prose() for _ in range(20)]
    rows = [(i, "\n".join(same * 6 + [(prose if i % 2 else junk)() for _ in range(400)])) for i in range(10)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    field = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    data = "\n".join(junk() for _ in range(30)).encode()
    assert not field.viterbi(quality.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)])).x).any()


def test_a_repeated_id_is_one_text_in_training(spark):
    many = spark.range(100_000).selectExpr("IF(id % 2 = 0, 3L, 4L) AS doc_id", "IF(id % 7 = 0, 'other text', 'a text of some words') AS text")
    sample = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, 1)], "label_id long, c0 int, c1 int")
    got = sampled_texts(many, sample)
    assert got.columns == ["doc_id", "text", "c0", "c1"] and sorted((r["doc_id"], r["c0"]) for r in got.collect()) == [(3, 1), (4, 0)]
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(many, labels) is not None and len(toxicity.train(many, labels, toxicity.CATEGORIES).weights) == 2


# Toxicity.


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(8)
    x = (rng.random((400, 3)) < 0.5).astype(float)
    first = (x[:, 0] > 0).astype(float)
    y = np.stack([first, first], axis=1)
    models = toxicity.train_chain(x, y, rng.integers(0, 3, 400))
    assert len(models[0]) == 4 and len(models[1]) == 5 and models[1][3] > 0.5
    assert ((toxicity.predict(x, models[0]) > 0.5) == (first > 0)).all()


def test_fit_equals_gradient_zero():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(200, 4)), (rng.random(200) < 0.3).astype(float)
    w = toxicity.fit(x, y)
    g = np.hstack([x, np.ones((200, 1))]).T @ (toxicity.predict(x, w) - y)
    assert np.abs(g[:4] + toxicity.PENALTY * w[:4]).max() < 1e-4


def test_toxic_documents(spark):
    rng = random.Random(10)
    bad, words = ["moron", "scumlike", "scumbag"], [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad).upper())
        rows.append((i, " ".join(w)))
        if i < 300:
            labels.append((i, 1 - int(i % 7 == 0), int(toxic)))
    labels += [(None, 1, 1), (5, None, 0), (900, 1, 0)]
    rows += [(1000, None), (1001, ""), (1002, "fine scumbags " + "wab " * 50_000), (None, "moron"), (1003, "wab"), (1003, "wab")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, c0 int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(df, lab)
    assert got.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic", "kept"]
    out = {r["doc_id"]: r["toxic"] for r in got.collect()}
    wrong = [i for i in range(400) if out[i] != (i % 4 == 0)]
    assert len(wrong) <= 4 and not any(i >= 300 for i in wrong[4:])
    assert [out[i] for i in (1000, 1001, 1002, None, 1003)] == [False, False, True, True, False]
    kept = toxicity.not_toxic(df, lab)
    assert kept.columns == df.columns and kept.count() == got.where("kept").count()
    untrained = toxicity.score(df, lab.limit(0)).agg(F.max("p_toxic"), F.count("*")).first()
    assert tuple(untrained) == (0.0, 406)
    assert toxicity.score(df.limit(0), lab).count() == 0
    chain = toxicity.train(df, lab, {"insult": "toxic", "threat": "toxic * quality", "toxic": "toxic"})
    assert len(chain.weights) == 3 and len(chain.weights[2]) == len(chain.kept) + 3


# Language.


def language_rows():
    rng = random.Random(11)
    stems = {"en": "the of and that with this have from", "de": "und der nicht eine werden schön über für", "fr": "les des une dans être élève pour avec"}
    rows = []
    for i in range(300):
        lang = ["en", "en", "de", "fr"][i % 4]
        w = stems[lang].split()
        rows.append((i, " ".join(rng.choice(w) + rng.choice(["", "", rng.choice(w)]) for _ in range(rng.randint(8, 80))), lang))
    return rows


def test_language(spark):
    rows = language_rows()
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!! ___", "fr"), (1003, "und der nicht eine " * 20_000, None), (None, "the of and that with", "xx"), (2000, "une dans être", "fr"), (2000, "une dans être", "fr")]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, lang string, score int")
    got = langid.identify(df).collect()
    assert len(got) == 307
    right = [r["lang_pred"] == rows[r["doc_id"]][2] for r in got if r["doc_id"] is not None and r["doc_id"] < 300]
    assert np.mean(right) > 0.97
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "fr", "und")
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None, 2000)] == ["und", "und", "und", "de", "en", "fr"]
    assert by[1000]["score"] == 0 and not by[1000]["kept"] and by[1003]["kept"]
    kept = langid.accepted(df)
    assert kept.columns == df.columns and kept.where("text IS NULL OR doc_id = 1002").count() == 0
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == 307
    assert langid.identify(df.limit(0)).count() == 0


def test_nothing_is_learned_from_held_out_rows(spark):
    df = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    fake = df.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.identify(x).collect())) for x in (df, fake))
    assert a == b


def test_every_language_is_learned(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    stems = {f"l{k:02d}": [word() for _ in range(12)] for k in range(70)}
    # The later a language, the fewer its texts.
    rows = [(k, " ".join(rng.choice(w) for _ in range(30)), k) for k, w in stems.items() for _ in range(6 + (k < "l40") + (k < "l20"))]
    rows = [(i, text, lang) for i, (_, text, lang) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == rows[r["doc_id"]][2] for r in got)
    assert langid.accepted(df).count() == len(rows)


def test_groups_of_languages_equal_one(monkeypatch):
    raw = {k: (f"{k} {k}{k} alpha {k}beta " * 40).encode() for k in "abcdefg"}
    some = ["a aa alpha", None, "12", "gbeta g " * 300, "alpha", "cbeta fbeta alpha " * 9]
    want = list(langid.Classifier(raw).each(some))
    monkeypatch.setattr(langid, "GROUP", 3)
    for size in (1, 100, 10**6):
        monkeypatch.setattr(langid, "PASS", size)
        assert list(langid.Classifier(raw).each(some)) == want


def test_blocks_cover_the_whole_text():
    c = langid.Classifier({"a": b"alpha beta gamma " * 50, "b": b"uno dos tres " * 50})
    text = "alpha beta " * 3000
    assert c(text)[0] == "a" and c("uno dos tres")[0] == "b"
    assert c("alpha beta gamma " * 200 + "uno dos tres " * 2000)[0] == "b"
    assert math.isclose(c("zzz")[1], 0.5) and not c("zzz")[2] and not c("zyx wvu " * 60)[2]
    assert langid.letters("A1b, É") == " a b é ".encode() and langid.letters("12") == b""
    # Numerals are no letters; marks belong to the letter before them.
    assert langid.letters("½²③ Ⅷ 五") == " 五 ".encode() and c("½²③")[0] == "und" and not c("½²③")[2]
    assert langid.letters("हिन्दी, ภาษาไทย\u0301") == " हिन्दी ภาษาไทย\u0301 ".encode() and langid.letters("\u0301") == b""


def test_mixed_texts_are_rejected():
    rows = [r for r in language_rows() if r[0] < 200]
    raw = {k: b"".join(langid.letters(t) for _, t, lang in rows if lang == k) for k in ("en", "de", "fr")}
    c = langid.Classifier(raw)
    texts = {k: [t for i, t, lang in language_rows() if lang == k and i >= 200] for k in raw}
    alone = [c(t) for k in raw for t in texts[k]]
    assert np.mean([x[2] for x in alone]) > 0.97
    mixed = [c(f"{a} {b[: len(a.encode())]}") for a, b in zip(texts["de"], texts["fr"])]
    assert np.mean([x[1] for x in mixed]) < np.mean([x[1] for x in alone])
    rng = random.Random(3)
    other = [" ".join("".join(rng.choice("aeioukpt") for _ in range(6)) for _ in range(60)) for _ in range(20)]
    assert np.mean([c(t)[2] for t in other]) < 0.3  # a language that wasn't learned


def test_pieces_cover_whole_texts(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 7)
    for text in (" a bb ccc dddd ", " " + "é" * 20 + " x ", "", " abcdefghijklmnop qr "):
        cut = list(langid._cuts(text.encode()))
        assert b"".join(cut) == text.encode() and all(0 < len(x) <= 7 and x.decode() for x in cut)


def test_late_parts_of_texts_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 3)
    rows = [(i, "mu " * 3000 + "".join(f"{w}{i} " for w in ("kala", "vesi")) + ("tuli maa " * 2500), "fi") for i in range(12)]
    rows += [(100 + i, "mu " * 3000 + "hus vann " * 2500, "no") for i in range(12)]
    df = spark.createDataFrame([*rows, (500, "tuli maa tuli maa", None), (501, "hus vann hus vann", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert got[500] == "fi" and got[501] == "no"


def test_good_prose_is_english_enough():
    assert len(quality.Lines.NAMES) == quality.Lines(np.frombuffer(GOOD.encode(), np.uint8), np.array([0, len(GOOD)])).x.shape[1]


@pytest.mark.parametrize("column", [pa.array([], pa.string()), pa.array([None, ""], pa.string()), pa.chunked_array([["a b"], ["c"]])])
def test_slices(column):
    found = list(quality.words.slices(column))
    assert sum(q - p for p, q, _, _ in found) == len(column)
