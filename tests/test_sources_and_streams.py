"""Files and streams."""

import base64

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomspark.operators import ledger
from loomspark.sources import files
from loomspark.streaming import events as stream

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType())])


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    with open(path, "w") as f:
        f.write('{"id": 1, "name": "é"}\n{"id": 2}\n{broken\n')
    good, bad = files.read_jsonl_checked(spark, path, SCHEMA)
    assert sorted(r.id for r in good.collect()) == [1, 2] and bad.first().line == "{broken" and bad.first().file.endswith("a.jsonl")
    assert files.read_jsonl(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, SCHEMA).collect()
    files.write_jsonl(good, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), SCHEMA).where("id = 1").first().name == "é"


def test_pages_and_vectors(spark, tmp_path):
    for name, text in (("a/x.md", "X"), ("a/b/y.md", "Ü"), ("no/z.md", "Z"), ("a/t.txt", "T")):
        p = tmp_path / "site" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r.path: r.text for r in files.read_pages(spark, str(tmp_path / "site"), excluded=("no/",)).collect()}
    assert got == {"a/x.md": "X", "a/b/y.md": "Ü"}
    want = [0.0, 1.0, -2.5, 3.1415927, 1e-30, 65504.0]
    df = spark.createDataFrame([(base64.b64encode(files.encode_vector(want)).decode(),), (None,), ("",)], "v string")
    rows = [r.v for r in files.decode_vectors(df, "v").collect()]
    assert rows[1] is None and rows[2] == [] and all(abs(a - b) <= 1e-6 * max(1, abs(b)) for a, b in zip(rows[0], want))


def test_caches_results_and_tables(spark, tmp_path):
    cache = str(tmp_path / "cache")
    for seq, v in ((1, "old"), (2, "new")):
        files.append(spark.createDataFrame([("k", v, seq)], "key string, value string, seq int"), cache)
    assert files.read_latest(spark, cache, ["key"], "seq").first().value == "new"
    root = str(tmp_path / "results")
    files.write_results(spark.range(3), root, "retrieval", "dev", "base")
    files.write_results(spark.range(2), root, "generation", "dev", "base")
    assert [tuple(r) for r in files.list_results(spark, root, "retrieval").collect()] == [("dev", "base", 3)]
    files.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string"), str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a", "b"]


ROWS = [(i, f"u{i % 3}", f"2031-01-01 {i // 6:02d}:{(i * 7) % 60:02d}:00") for i in range(60)]


@pytest.fixture
def source(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, who string, t string").withColumn("ts", F.to_timestamp("t"))
    path = str(tmp_path / "events")
    df.coalesce(1).write.parquet(path)
    return df, lambda: spark.readStream.schema(df.schema).parquet(path)


def run(spark, df, name, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_equals_batch(spark, source, tmp_path):
    batch, live = source
    counts = run(spark, stream.tumbling_counts(live(), "ts", "who"), "tumbling", tmp_path, "complete")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, stream.tumbling_counts(batch, "ts", "who").collect()))
    admitted = run(spark, stream.limited(live(), "who", "ts", "id", 2, 1800), "limited", tmp_path, "append")
    assert sorted(map(tuple, admitted.collect())) == sorted(map(tuple, ledger.admitted(batch, "who", "ts", "id", 2, 1800).collect()))
    assert run(spark, stream.once(live(), "ts", ["who"]), "once", tmp_path, "append").count() == 3
    assert stream.session_counts(batch, "ts", "who").agg(F.sum("events")).first()[0] == 60


def test_append_log(spark, source, tmp_path):
    _, live = source
    for _ in range(2):
        stream.append_log(live(), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 60
