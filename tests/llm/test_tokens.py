import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from glyphmill.llm import prefix_bpe as B  # noqa: E402
from glyphmill.llm import token_file as T  # noqa: E402
from glyphmill.llm import words  # noqa: E402

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = [
    "aaaa", "Don't", "it's", "The", " ", " ", "  ", "é", "É", "×", "é", "İ", "Σ", "ß", "12", "a1", "'s", "!!", "漢", "\t", "\n", "\x1c",
    "\x85", "\xa0", "ª", "Ⅷ", "the,", "<|endoftext|>", "é,", "ÿ", "ŀ", "µ", "ing", "\r\n", "🙂", "'", "̀",
]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(B.load_ranks(RANKS))


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [3, 3, 9, 9, 10], list(range(0, 5000, 7)), [0] * 700 + [2**40]])
def test_elias_fano(values):
    e, end = T.EliasFano.load(memoryview(T.EliasFano.build(np.array(values, dtype=np.uint64)).dump()), 0)
    assert e.all().tolist() == values and [e.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(0, 10**9, 100_000))
    assert len(T.EliasFano.build(v).dump()) * 8 / len(v) < 2 + np.log2(10**9 / len(v)) + 0.5


def test_segments():
    ids = [np.array(x, "<u2").tobytes() for x in ([5, 1], [1], [7, 8, 9, 1])]
    s = T.Segment(T.dump_segment([None, -3, 40], [2, 1, 4], ids, 2))
    assert s.doc_ids() == [None, -3, 40] and [s.document(i).tolist() for i in range(3)] == [[5, 1], [1], [7, 8, 9, 1]]
    with pytest.raises(ValueError):
        T.Segment(b"something else entirely")


def test_rows_come_by_select(monkeypatch):
    docs = [None, *range(-3, 700)]
    ids = [np.arange(i % 5 + 1, dtype="<u2") for i in range(len(docs))]
    data = T.dump_segment(docs, [len(x) for x in ids], [x.tobytes() for x in ids], 2)
    seen, select, every = [], T.EliasFano.select, T.EliasFano.all
    monkeypatch.setattr(T.EliasFano, "select", lambda self, i: seen.append(i) or select(self, i))
    monkeypatch.setattr(T.EliasFano, "all", lambda self: seen.append(self.count) or every(self))
    monkeypatch.setattr(T, "ROWS", 300)
    rows = pa.RecordBatch.from_pydict({"name": ["f"], "content": [data]})
    got = [tuple(r.values()) for b in T._read([rows]) for r in b.to_pylist()]
    start = np.cumsum([0] + [len(x) for x in ids]).tolist()
    assert got == [("f", d, s, len(x), zlib.crc32(x.astype("<u4"))) for d, s, x in zip(docs, start, ids)]
    assert set(range(len(docs) + 1)) <= set(seen) and seen.count(len(docs) + 1) == 0  # no table of the boundaries


def test_encoder_equals_the_library(tokenizer):
    encode = T.Encoder(WORDS)
    for some in (texts(1, 3000), texts(1, 300), ["", "", "a"], ["x" * 5000 + " " + "y" * 5000]):
        found = []
        for _, _, data, offsets in words.slices(pa.array(some)):
            ids, n = encode(data, offsets, 1)
            found += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert found == [tokenizer.encode(x, add_special_tokens=False).ids + [1] for x in some]


def test_a_full_table_still_encodes(tokenizer, monkeypatch):
    monkeypatch.setattr(T.Encoder, "TABLE", 4)
    monkeypatch.setattr(T.Encoder, "IDS", 60)
    encode, some = T.Encoder(WORDS), texts(2, 200)
    for _ in range(2):
        for x in some:
            ids, _ = encode(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]), 1)
            assert ids.tolist() == tokenizer.encode(x, add_special_tokens=False).ids + [1]


ADDED = [
    "a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y's<|endoftext|>", "<|EndOfText|> <|ENDOFTEXT|>", "<|endof", "text|>", "", "<|endoftext|>",
    "漢<|endoftext|>'s", "!!<|endoftext|><|endoftext|>!!", "<|<|endoftext|>|>", "<|endoftext|>\u0301 e<|startoftext|>\u0301", None,
]


def test_added_tokens_equal_the_unmodified_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    ids = lambda x: plain.encode(x or "", add_special_tokens=False).ids + [1]
    encode = T.Encoder(WORDS, added=True)
    assert ids("a <|endoftext|> b") == [320, 49407, 321, 1]
    for some in (ADDED, ADDED[::-1], texts(6, 2000), ADDED):
        found = []
        for _, _, data, offsets in words.slices(pa.array(some)):
            got, n = encode(data, offsets, 1)
            found += [x.tolist() for x in np.split(got, np.cumsum(n)[:-1])]
        assert found == [ids(x) for x in some]
    df = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string").repartition(3)
    start = np.cumsum([0] + [len(ids(x)) for x in ADDED]).tolist()
    want = [(i, start[i], len(ids(x)), zlib.crc32(np.array(ids(x), "<u4").tobytes())) for i, x in enumerate(ADDED)]
    assert sorted(map(tuple, T.round_trip(df, WORDS).collect())) == want


def test_patterned_words_are_parts_of_their_own():
    """Words that a hash by one modulus of 2^64 can't tell apart, and texts in which all keys or checks meet."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    flip = lambda n, k: "".join("ab"[(i.bit_count() + k) & 1] for i in range(n))
    some = [f"y {flip(n, 0)} {flip(n, 1)}" for n in (1024, 2048, 4096)] + [f"{flip(1024, 1)} {flip(1024, 0)}"]
    want = [plain.encode(x, add_special_tokens=False).ids + [1] for x in some]
    data = "".join(some).encode()
    offsets = np.cumsum([0] + [len(x) for x in some])
    ids, n = T.Encoder(WORDS)(np.frombuffer(data, np.uint8), offsets, 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_colliding_keys_are_told_apart(tokenizer, monkeypatch):
    real = words.Slice.spans

    def few(self, starts, ends, lower=True, seed=0):
        found = real(self, starts, ends, lower, seed)
        return found if seed else found % np.uint64(3)

    monkeypatch.setattr(words.Slice, "spans", few)
    encode = T.Encoder(WORDS)
    for some in (texts(8, 200), texts(9, 200)):
        for _, _, data, offsets in words.slices(pa.array(some)):
            ids, n = encode(data, offsets, 1)
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tokenizer.encode(x, add_special_tokens=False).ids + [1] for x in some]


def test_another_tokenizer_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(WORDS)
    other.normalizer = normalizers.NFKC()
    other.save(str(tmp_path / "other.json"))
    encode, some = T.Encoder(str(tmp_path / "other.json"), added=True), [*texts(7, 200), *filter(None, ADDED)]
    assert not encode.cuts and T.Encoder(WORDS).cuts
    for _, _, data, offsets in words.slices(pa.array(some)):
        ids, n = encode(data, offsets, 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [other.encode(x, add_special_tokens=False).ids + [1] for x in some]


def test_files_of_lost_tasks_are_left_out(spark, tokenizer, tmp_path):
    df = spark.createDataFrame([(i, f"the text {i}") for i in range(50)], "doc_id long, text string").repartition(3)
    uri = f"file://{tmp_path}/tokens"
    manifest = T.write(df, WORDS, 1, uri)
    want = sorted(map(tuple, T.read(manifest, uri).collect()))
    files = sorted((tmp_path / "tokens" / "files").glob("*.tok"))
    data = files[0].read_bytes()
    for name, some in (("00000000-000000-lost.tok", data[:-5]), ("00000000-000000-gone.tok", data[:20]), ("00000001-000000-twice.tok", data), ("0.tok", b"")):
        (files[0].parent / name).write_bytes(some)
    assert sorted(map(tuple, T.read(manifest, uri).collect())) == want and len(want) == 50


def test_token_files(spark, tokenizer, monkeypatch):
    rows = [(9, "the end"), (None, "nothing"), (-4, "Ééé, Don't"), (3, None), (3, ""), (7, "a b c " * 20_000), (5, "same"), (5, "same")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, name int").repartition(3)
    got = T.round_trip(df, WORDS).collect()
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert T.round_trip(df.limit(0), WORDS).count() == 0


def test_vocabulary_halves(vocabulary):
    assert len(vocabulary.halves) == len(vocabulary.ranks) - 256
    for rank, (a, b) in list(vocabulary.halves.items())[::997]:
        assert vocabulary.bytes[a] + vocabulary.bytes[b] == vocabulary.bytes[rank] and max(a, b) < rank


def test_encoding_equals_the_library(encoding):
    encode = B.Encoder(RANKS, P.PATTERN)
    for x in [*texts(3, 1500), "a" * 3000, " " * 500 + "x", "", "Hello, world. It's"]:
        n, digits, data = encode(x)
        ids = encoding.encode_ordinary(x)
        assert (n, digits, data) == (len(ids), " ".join(map(str, ids)), x.encode())


def test_appends_and_edits(encoding, vocabulary):
    rng = random.Random(5)
    for x in texts(4, 300):
        t = B.Text(vocabulary, P.PATTERN, x)
        for _ in range(3):
            a = rng.randint(0, len(t.text))
            t.edit(a, min(len(t.text), a + rng.randint(0, 4)), rng.choice(PIECES))
            assert t.ids() == encoding.encode_ordinary(t.text)
        t.append("ing the")
        assert t.ids() == encoding.encode_ordinary(t.text)
        table = B.PrefixTable(vocabulary, b"hell")
        table.append(b"o world")
        table.edit(2, 4, b"LL")
        assert table.ids() == B.PrefixTable(vocabulary, b"heLLo world").ids()


def test_edits_search_near_their_place_only(encoding, vocabulary):
    rng = random.Random(9)
    text = " ".join(rng.choice(PIECES) + rng.choice(["word", "ing", "'"]) for _ in range(4000))
    t = B.Text(vocabulary, P.PATTERN, text)
    for _ in range(60):
        a = rng.randint(0, len(t.text))
        t.edit(a, min(len(t.text), a + rng.randint(0, 6)), rng.choice(PIECES))
        assert t.searched < 20
    assert t.ids() == encoding.encode_ordinary(t.text)
    for size in (0, 1, 5):
        t.edit(0, size, "'")
        t.edit(len(t.text) - size, len(t.text), "re")
    assert t.ids() == encoding.encode_ordinary(t.text)
    t.edit(0, len(t.text), "")
    assert t.ids() == []
    t.append("'l")
    t.append("l")
    assert t.ids() == encoding.encode_ordinary("'ll")


def test_memos_are_bounded_in_bytes_on_every_path(encoding, monkeypatch):
    monkeypatch.setattr(B, "MEMO", 50_000)
    encode, sizes = B.Encoder(RANKS, P.PATTERN), []
    for k in range(300):
        for x in (f"a{k}b  double blank{k}q", f" outer{k}xyz", f"single blank{k}z x{k}", "w" * 3000 + str(k)):
            ids = encoding.encode_ordinary(x)
            assert encode(x)[:2] == (len(ids), " ".join(map(str, ids)))
        sizes.append(len(encode.memo) + len(encode.pieces))
    assert max(sizes) * 400 <= 50_000 and encode.held <= 50_000
    assert not any(len(x) > B.ENTRY for x in [*encode.memo, *encode.pieces])


def test_encode_documents(spark, encoding):
    rows = [(1, "the cat's é"), (2, None), (2, ""), (None, "x"), (4, "long " * 30_000), (5, "a"), (5, "a")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_tokens int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [tuple(r) for r in B.encode_documents(df, RANKS, P.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert B.encode_documents(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_a_table_is_filled_where_it_is_asked_for(vocabulary):
    """Ids read off from the end are those of the whole table, at fewer looks into the vocabulary."""
    pieces = [x.encode() for t in texts(11, 200) for x in t.split(" ")] + [b"a" * 3000, b"", b" withanonheor", b"antidisestablishmentarianism"]
    assert [vocabulary.ids(x) for x in pieces] == [B.PrefixTable(vocabulary, x).ids() for x in pieces]

    class Counted(dict):
        looks = 0

        def get(self, *args):
            self.looks += 1
            return super().get(*args)

    plain, looks = vocabulary.ranks, []
    for f in (lambda x: B.PrefixTable(vocabulary, x).ids(), vocabulary.ids):
        vocabulary.ranks = Counted(plain)
        try:
            f(b" antidisestablishmentarianism")
            looks.append(vocabulary.ranks.looks)
        finally:
            vocabulary.ranks = plain
    assert 0 < 2 * looks[1] <= looks[0]


def test_words_are_held_once(encoding):
    """A word between blanks takes one entry, with a stop behind it one more, and none of them changes the ids."""
    encode, words_ = B.Encoder(RANKS, P.PATTERN), ["withanonheor", "eaenin", "ththntwh", "Ororno"]
    for x in ("x " + " ".join(words_), "x " + ". ".join(words_), " ".join(words_) + ".\nOf,x it's 12 ...", "a\x1cb c", "\u2028 a", "a\u00a0 b", "x 's"):
        n, digits, data = encode(x)
        ids = encoding.encode_ordinary(x)
        assert (n, digits, data) == (len(ids), " ".join(map(str, ids)), x.encode())
    assert sum(x.strip() in words_[1:] for x in [*encode.memo, *encode.pieces]) == len(words_) - 1
