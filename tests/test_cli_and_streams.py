import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from glyphmill.cli import Outside, main, seed_for
from glyphmill.sources.text import from_memory, read_files
from glyphmill.spec.builtin import builtin_artifact
from glyphmill.spec.compiler import compile_spec
from glyphmill.spec.dsl import Spec
from glyphmill.spec.pattern import alt, literal
from glyphmill.streaming.lex import kind_counts, lex_stream


class Fake:
    def __init__(self, spark=None, files=None, artifact=builtin_artifact):
        self.text, self.files = "", files or {}
        self.outside = Outside(
            read=self.files.__getitem__, write=self.files.__setitem__, out=self.add, environment=lambda: {"A": "1", "GLYPHMILL_RUNTIME": "test"},
            now=lambda: datetime(2023, 12, 29, 10, 33, 20, tzinfo=UTC), session=lambda: spark, artifact=artifact,
        )

    def add(self, text):
        self.text += text

    def run(self, *argv):
        return main(list(argv), self.outside)


def test_doctor_and_seeds():
    f = Fake()
    assert f.run("doctor") == 0 and f.text == "doctor\nstatus: ok\nos: test\ntime: 2023-12-29T10:33:20Z\n"
    f = Fake()
    assert f.run("doctor", "--json") == 0 and json.loads(f.text)["environment"] == {"A": "1", "GLYPHMILL_RUNTIME": "test"}
    f = Fake()
    assert f.run("seeds") == 0 and f.text.splitlines()[1:4] == ["schemaVersion: 1", "globalSeed: 20260306", "seed(bench): 150"]
    assert f.text.splitlines()[-1] == "seed(wasm): 149"
    f = Fake(files={"m": json.dumps({"schemaVersion": 2, "globalSeed": 5, "corpusSeeds": {"bench": 1}}).encode()})
    assert f.run("seeds", "--json", "--path", "m") == 0 and json.loads(f.text)["globalSeed"] == 5
    assert seed_for({"globalSeed": 5, "corpusSeeds": {"bench": 1}}, "wasm") == 5
    with pytest.raises(ValueError):
        seed_for({"globalSeed": 5, "corpusSeeds": {}}, "other")


def test_artifact_commands():
    f = Fake()
    assert f.run("artifact", "dump", "--output", "a") == 0 and f.text == "artifact dump: wrote a\n"
    assert f.run("artifact", "check", "--path", "a") == 0 and f.text.endswith("artifact check: ok\n")
    f.files["a"] = f.files["a"].replace(b'"ws"', b'"WS"')
    assert f.run("artifact", "check", "--path", "a") == 1 and f.text.endswith("artifact check: mismatch\n")
    g = Fake()
    assert g.run("artifact", "dump", "--pretty") == 0 and json.loads(g.text) == builtin_artifact()


def test_lex_command(spark):
    f = Fake(spark, {"x.src": "let é = 1 // c\n".encode()})
    assert f.run("lex", "x.src", "--observe") == 0
    out = json.loads(f.text)
    assert [(t["kind"], t["startByte"], t["endByte"], t["flags"]) for t in out["tokens"]] == [("kwLet", 0, 3, 0), ("eq", 7, 8, 0), ("int", 9, 10, 0)]
    assert out["errorSpans"] == [{"start": 4, "end": 6}] and out["tokenCount"] == 3 and out["overflows"] == []
    assert out["observation"]["traceID"] == f"f{out['fileID']}-b16-p1-t3-e1-o0" and out["observation"]["pageBucketDistribution"] == {"4096": 1}
    h = 2166136261
    for c in b"x.src":
        h = (h ^ c) * 16777619 % 2**32
    assert out["fileID"] == h


def test_lex_command_refuses_artifacts_it_cannot_run(spark):
    spec = Spec("w")
    spec.token("pair", alt(literal("ab"), literal("cd")))
    f = Fake(spark, {"x": b"ab"}, lambda: compile_spec(spec))
    assert f.run("lex", "x") == 1
    assert json.loads(f.text) == {
        "status": "artifact-capability-error",
        "diagnostics": [{"ruleID": 0, "ruleName": "pair", "family": "localWindow", "message": "localWindow-present"}],
    }


def test_smoke(spark):
    f = Fake(spark)
    assert f.run("smoke", "--json") == 0
    assert json.loads(f.text) == {"status": "ok", "literalRows": 3, "runRows": 4, "prefixedRows": 2}


def test_files_and_memory(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff\r\n")
    (tmp_path / "b.bin").write_bytes(b"\0")
    rows = {r["path"].rsplit("/", 1)[1]: bytes(r["bytes"]) for r in read_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": b"\xff\r\n", "b.bin": b"\0"}
    assert read_files(spark, str(tmp_path), "*.txt").count() == 1
    same = from_memory(spark, {"x": b"a"}).first()
    assert same["file_id"] == from_memory(spark, {"x": b"b"}).first()["file_id"]


def test_streams(spark, tmp_path):
    rows = [(1, "let x = 1", "2024-01-01 00:00:10"), (2, "if y", "2024-01-01 00:00:50"), (3, "z", "2024-01-01 00:05:00")]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "doc_id long, text string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(src)

    def run(stream, name, mode):
        q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    read = lambda: spark.readStream.schema(df.schema).parquet(src)
    pages = run(lex_stream(read()), "pages", "append")
    assert sorted((r["doc_id"], r["row_count"]) for r in pages.collect()) == [(1, 4), (2, 2), (3, 1)]
    counts = {(str(r["window_start"]), r["kind"]): r["n"] for r in run(kind_counts(read(), "ts"), "counts", "complete").collect()}
    assert counts == {
        ("2024-01-01 00:00:00", "kwLet"): 1, ("2024-01-01 00:00:00", "ident"): 2, ("2024-01-01 00:00:00", "eq"): 1,
        ("2024-01-01 00:00:00", "int"): 1, ("2024-01-01 00:00:00", "kwIf"): 1, ("2024-01-01 00:05:00", "ident"): 1,
    }
