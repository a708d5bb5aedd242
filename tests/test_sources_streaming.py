"""The container source and the streaming forms of the stateful codecs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lamina.operators import delta, dictionary
from lamina.sources import ContainerSource, read_container
from lamina.streaming import decode_deltas, decode_dictionary, encode_deltas, encode_dictionary


def test_container(spark, tmp_path):
    spark.dataSource.register(ContainerSource)
    df = spark.createDataFrame([(i, "x" * i if i % 3 else None, [float(i)], {"k": i}) for i in range(50)], "id long, s string, a array<double>, m map<string,int>")
    path = str(tmp_path / "box")
    df.repartition(3).write.format("lamina").mode("append").save(path)
    back = spark.read.format("lamina").load(path)
    assert back.schema["s"].dataType.typeName() == "string"
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    some = read_container(spark, f"file://{path}", ["m", "id"])
    assert some.columns == ["m", "id"] and sorted((r.id, r.m) for r in some.collect()) == sorted((r.id, r.m) for r in df.collect())
    assert spark.read.format("lamina").load(f"file://{path}").count() == 50
    df.limit(4).write.format("lamina").mode("overwrite").save(path)
    assert spark.read.format("lamina").load(path).count() == 4
    file = next((tmp_path / "box").glob("*.lmna"))
    data = bytearray(file.read_bytes())
    data[-20] ^= 1
    file.write_bytes(bytes(data))
    for broken in (spark.read.format("lamina").load(path), read_container(spark, path)):
        with pytest.raises(Exception, match="InvalidData"):
            broken.collect()
    with pytest.raises(Exception, match="InvalidData"):
        read_container(spark, str(tmp_path))


def _drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream"))
    rows = [(i, i % 3, ("blob %d " % (i // 5)) * 20, "abcd"[i * i % 4]) for i in range(60)]
    for k in range(0, 60, 20):  # one file, and so one micro-batch, after the other
        spark.createDataFrame(rows[k : k + 20], "pos long, k long, b string, x string").select("pos", "k", F.col("b").cast("binary").alias("b"), "x").coalesce(1).write.mode("append").parquet(path)
    return path


def _read(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_delta_streams(spark, files, tmp_path):
    batch = delta.encode(spark.read.parquet(files), "k", "pos", "b")
    wires = _drain(encode_deltas(_read(spark, files), "k", "pos", "b"), "wires")
    assert sorted((r.pos, bytes(r.wire)) for r in wires.collect()) == sorted((r.pos, bytes(r.wire)) for r in batch.collect())
    path = str(tmp_path / "wires")
    for low in (0, 30):
        wires.filter(F.col("pos").between(low, low + 29)).coalesce(1).write.mode("append").parquet(path)
    blobs = _drain(decode_deltas(_read(spark, path), "k", "pos"), "blobs")
    assert sorted((r.pos, bytes(r.blob)) for r in blobs.collect()) == sorted((r.pos, bytes(r.b)) for r in batch.collect())


def test_dictionary_streams(spark, files):
    batch = dictionary.encode(spark.read.parquet(files), "x", "pos", ["k"])
    ids = _drain(encode_dictionary(_read(spark, files), "k", "pos", "x"), "ids")
    assert sorted((r.pos, r.wire_id) for r in ids.collect()) == sorted((r.pos, r.wire_id) for r in batch.collect())


def test_dictionary_streams_back(spark, files, tmp_path):
    """Frozen values first, then the scope's own; ids decode to what was encoded, over several micro-batches."""
    table = spark.createDataFrame([("", "c", 1), ("", "a", 2)], "type string, value string, id long")
    batch = dictionary.encode(spark.read.parquet(files), "x", "pos", ["k"], frozen=table)
    done = _drain(encode_dictionary(_read(spark, files), "k", "pos", "x", frozen=["c", "a"]), "frozen_ids")
    assert sorted((r.pos, r.wire_id) for r in done.collect()) == sorted((r.pos, r.wire_id) for r in batch.collect())
    path = str(tmp_path / "ids")
    wire = done.select("pos", "k", "wire_id", F.when(F.col("wire_id") == 0, F.col("x")).alias("x"))
    for low in (0, 30):
        wire.filter(F.col("pos").between(low, low + 29)).coalesce(1).write.mode("append").parquet(path)
    back = _drain(decode_dictionary(_read(spark, path), "k", "pos", "x", frozen=["c", "a"]), "values_back")
    assert sorted((r.pos, r.x) for r in back.collect()) == sorted((r.pos, r.x) for r in done.collect())
    with pytest.raises(Exception, match="InvalidData"):
        _drain(decode_dictionary(_read(spark, path), "k", "pos", "x"), "no_frozen")
