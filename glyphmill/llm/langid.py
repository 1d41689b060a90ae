"""Language by compression with per-language zstandard dictionaries.

For each language a raw-content dictionary is made of a bounded sample of
labelled texts. Of texts, here as there, letters count, with the marks that
follow them: they are lower-cased, and whatever stands between them becomes one
blank. A text is cut into blocks, each block is compressed once with each
dictionary, and the language whose blocks sum to the fewest bytes wins.
Blocks keep the dictionary near however long the text is, and every byte of the
text is in one. Equal sums go to the language with more distinct texts, then to the
first by name. If the runner-up needs less than MARGIN more bytes, the text is
rejected, however short; the prediction is still given.

The sample: at most SAMPLE distinct texts of each language, those with the
smallest hashes. Their letters are cut into pieces of PIECE bytes from beginning
to end, and of all pieces those with the smallest hashes make the dictionary,
DICTIONARY bytes at most. Distinct texts count once, so a text with very many
copies doesn't fill it. Every language is learned; where there are more than
GROUP, a worker makes the compressors of GROUP languages at a time and texts pass
all groups in turn.

Row rules: null text, or text without a letter (digits, fractions and other
numerals are none), is ``und`` with score 0 and is rejected. Without any labelled
text all rows are. Where only one language is learned nothing is rejected for its
margin. A null doc_id is not learned from and not held out. Each row is returned.
lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import small_batches

#: Bounds of what is learned from each language: texts, bytes of a piece of them, bytes of the dictionary.
SAMPLE, PIECE, DICTIONARY = 200, 1000, 200_000
#: Languages whose compressors a worker holds together, bytes of letters that pass them in turn.
GROUP, PASS = 64, 16_000_000
#: Bytes of a block, level of compression.
BLOCK, LEVEL = 1024, 6
#: A text is rejected if the runner-up needs less than this share more.
MARGIN = 0.04
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def letters(text: str) -> bytes:
    """Runs of letters in lower case, with a blank before and after each; nothing if there are none."""
    found = _LETTERS.findall(text.lower())
    return f" {' '.join(found)} ".encode() if found else b""


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _below(share: Column) -> Column:
    """The 64-bit value that this share of all hashes doesn't exceed."""
    return F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))


def dictionaries(docs: DataFrame, learn: Column) -> dict[str, bytes]:
    """A raw dictionary for each language of the rows that may be learned from."""
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("lang", F.xxhash64("text").alias("h"), "doc_id")
    once = rows.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    # A row for each language: the commonest comes first, which settles equal sums.
    sizes = {r["lang"]: r["n"] for r in once.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    # Hashes are uniform: the smallest are below a bound by the language's size, so few rows are ranked.
    table = docs.sparkSession.createDataFrame(list(sizes.items()), "lang string, n long")
    bounds = F.broadcast(table.select("lang", _below(F.lit(4.0 * SAMPLE) / F.col("n")).alias("bound")))
    few = once.join(bounds, "lang").where(F.col("h") <= F.col("bound")).drop("bound")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    ids = few.withColumn("r", rank).where(F.col("r") <= SAMPLE)
    ids = ids.select("doc_id", "h", F.col("lang").alias("of"))
    # At most SAMPLE rows for each language.
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.xxhash64("text") == F.col("h"))
    pieces = texts.select("of", "h", "text").mapInArrow(_pieces, "of string, h long, k int, piece binary")
    # A row that is repeated counts once; DICTIONARY / PIECE pieces for each language are gathered.
    by = Window.partitionBy("of").orderBy(F.xxhash64("h", "k"), "h", "k")
    pieces = pieces.groupBy("of", "h", "k").agg(F.first("piece").alias("piece")).withColumn("r", F.row_number().over(by))
    found: dict[str, list[tuple[int, int, bytes]]] = {}
    for r in pieces.where(F.col("r") <= DICTIONARY // PIECE).collect():
        found.setdefault(r["of"], []).append((r["h"], r["k"], bytes(r["piece"])))
    return {k: b"".join(piece for _, _, piece in sorted(found[k])) for k in order if k in found}


def _cuts(data: bytes) -> Iterator[bytes]:
    """All of data, cut at blanks into pieces of at most PIECE bytes; a longer word is cut between characters."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            end = data.rfind(b" ", at + 1, at + PIECE + 1)
            if end < 0:
                end = at + PIECE
                while data[end] & 0xC0 == 0x80:
                    end -= 1
        yield data[at:end]
        at = end


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column(2)):
            parts = list(_cuts(letters(text.as_py())))
            of, h = (batch.column(k).slice(i, 1).to_pylist() * len(parts) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.string()), pa.array(h, pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                names=["of", "h", "k", "piece"],
            )


class Classifier:
    def __init__(self, raw: dict[str, bytes]):
        self.languages, self.raw = list(raw), list(raw.values())
        self.all = self._compressors(0) if len(raw) <= GROUP else None

    def _compressors(self, first: int) -> list:
        found = []
        for raw in self.raw[first : first + GROUP]:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            found.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)
        return found

    def sizes(self, datas: list[bytes]) -> list[list[int]]:
        """Of each text, the sum of its blocks with each language."""
        found: list[list[int]] = [[] for _ in datas]
        for first in range(0, len(self.raw), GROUP):
            compressors = self.all or self._compressors(first)
            for data, own in zip(datas, found):
                blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
                own += [sum([len(c(b)) for b in blocks]) for c in compressors]
        return found

    def _judge(self, data: bytes, sizes: list[int]) -> tuple[str, float, bool]:
        if not sizes or not data:
            return "und", 0.0, False
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :]
        margin = (min(rest) - sizes[best]) / sizes[best] if rest else 1.0
        return self.languages[best], 1 - 0.5 * math.exp(-50 * margin), margin >= MARGIN

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, whether the margin is wide enough."""
        return next(self.each([text]))

    def each(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float, bool]]:
        """The same of each text; texts of about PASS bytes go through the groups of languages together."""
        datas: list[bytes] = []
        held = 0
        for text in texts:
            datas.append(letters(text) if text and self.languages else b"")
            held += len(datas[-1])
            # With a single group nothing is made anew, so no text has to wait.
            if self.all is not None or held >= PASS:
                yield from map(self._judge, datas, self.sizes(datas))
                datas, held = [], 0
        yield from map(self._judge, datas, self.sizes(datas))


_classifiers: dict[tuple, Classifier] = {}


def _predict(batches: Iterator[pa.RecordBatch], raw: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    key = tuple(raw.items())
    if key not in _classifiers:
        _classifiers.clear()
        _classifiers[key] = Classifier(raw)
    classify = _classifiers[key]
    for batch in batches:
        found = list(classify.each(x.as_py() for x in batch.column(batch.num_columns - 1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_())))]
            if found
            else [batch.column(0), batch.column(1), pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.bool_())],
            names=["doc_id", "held_out", "lang_pred", "score", "kept"],
        )


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, kept of every row, learned from the rows that aren't held out."""
    small_batches(docs.sparkSession)
    raw = dictionaries(docs, ~held_out())
    schema = "doc_id long, held_out boolean, lang_pred string, score double, kept boolean"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(partial(_predict, raw=raw), schema)


def _keep(batches: Iterator[pa.RecordBatch], raw: dict[str, bytes], text: int) -> Iterator[pa.RecordBatch]:
    classify = Classifier(raw)
    for batch in batches:
        yield batch.filter(pa.array([x[2] for x in classify.each(x.as_py() for x in batch.column(text))], pa.bool_()))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is certain, with all their columns."""
    small_batches(docs.sparkSession)
    raw = dictionaries(docs, ~held_out())
    return docs.mapInArrow(partial(_keep, raw=raw, text=docs.columns.index("text")), docs.schema)
