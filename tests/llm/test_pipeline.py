import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import langid, minhash, packing, toxicity
from glyphmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with toxic, wordless, repeated and null rows."""
    d = str(tmp_path_factory.mktemp("sf"))
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    rows = []
    for i in range(80):
        text = " ".join(words[(i * 37 + k * (i + 3)) % len(words)][:: 1 if i % 2 else -1] for k in range(40))  # two languages
        rows.append((i, text + (" vilest" if i % 8 == 0 else ""), "xx" if i % 2 else "yy", "s", len(text)))
    rows += [(90, rows[1][1], "xx", "s", 1), (91, rows[1][1] + " more", "xx", "s", 1), (92, None, "xx", None, None), (93, "1234", "xx", "s", 4)]
    rows += [(None, rows[3][1] + " and other ends here", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(i % 8 == 0)) for i in range(0, 72)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_run_equals_the_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, labels).where("toxic").collect()}
    assert toxic == {i for i in range(80) if i % 8 == 0}
    one = docs.where(~F.coalesce(F.col("doc_id").isin(list(toxic)), F.lit(False)))
    sure = [(r["doc_id"], r["kept"]) for r in langid.identify(one).collect()]
    assert (92, False) in sure and (93, False) in sure
    known = [i for i, ok in sure if ok]
    two = one.where(F.col("doc_id").isin([i for i in known if i is not None]) | (F.col("doc_id").isNull() & F.lit(None in known)))
    kept = minhash.near_duplicates(two, 80).where("kept").count()
    assert minhash.one_of_each(two, 80).count() == kept
    want = sorted(map(str, packing.pack(minhash.one_of_each(two, 80)).collect()))
    got = sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert got == want and len({r["doc_id"] for r in packing.pack(minhash.one_of_each(two, 80)).collect()}) > 50
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert not ids & (toxic | {90, 91, 92, 93})


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_corpus(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_on_the_drivers_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()
