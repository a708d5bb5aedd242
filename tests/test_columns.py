"""Column codecs of any descriptor against the scalar codec, with and without contexts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_records import VALUES

from lamina.functions import wide
from lamina.functions import wire as w
from lamina.operators import columns, delta, records, structural


def _round(spark, kind, values):
    """Values as columns to bytes and back; the bytes must be the scalar codec's."""
    taken = columns.to_spark(kind)
    df = spark.createDataFrame([(i, taken(v) if not isinstance(kind, w.MapOf) else v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", columns.spark_type(kind))]))
    df = df.withColumn("wire", columns.encode_value(F.col("v"), kind)).withColumn("back", columns.decode_value(F.col("wire"), kind))
    for r in df.collect():
        assert bytes(r.wire) == kind.dumps(values[r.i]) and r.back == r.v


KINDS = {
    "u64": (w.U64, [0, 127, 2**63, 2**64 - 1]), "u128": (w.U128, [0, 2**128 - 1, 300]), "i128": (w.I128, [-(2**127), -1, 5]), "u256": (w.U256, [1 << 200, 2**256 - 1]),
    "f32": (w.F32, [1.5, -0.25]), "array": (w.Array(w.U16, 2), [[1, 65535], [0, 300]]), "set": (w.SetOf(w.I32), [[-5, 3], []]), "map": (w.MapOf(w.STR, w.U8), [{"a": 1, "b": 255}, {}]),
    "range": (w.range_of(w.U32), [{"start": 1, "end": 500}]), "from": (w.range_from(w.I8), [{"start": -3}]), "tuple": (w.tuple_of(w.U8, w.STR), [(1, "x"), (2, "y" * 200)]),
    "result": (w.Result(w.UNIT, w.STR), [(True, None), (False, "no")]), "enum": (w.Enum("A", ("B", w.U64), ("C", w.tuple_of(w.U8, w.U8)), ("D", w.UNIT)), ["A", ("B", 7), ("C", (1, 2))]),
    "plain": (w.Enum("L", "R", numbers=[5, 300]), ["L", "R"]), "nonzero": (w.non_zero(w.U32), [1, 2**32 - 1]), "option": (w.Vec(w.Option(w.U64)), [[None, 2**64 - 1], []]),
}


@pytest.mark.parametrize("name", KINDS)
def test_round_trips(spark, name):
    _round(spark, *KINDS[name])


def test_records(spark):
    for name, value in VALUES.items():
        kind = records.RECORDS[name]
        assert len(records.schema_of(name))
        _round(spark, kind, [value, value])
    assert records.schema_of("Reward")["lamports"].dataType == T.LongType()


def test_errors(spark):
    rows = spark.createDataFrame([(bytes.fromhex(x),) for x in ("05", "0000", "", "820000")], "wire binary")
    got = rows.select(columns.decode_value(F.col("wire"), w.Enum("A", ("B", w.U8)), strict=False).alias("d")).collect()
    assert [r.d.error_class for r in got] == ["InvalidData", "InvalidData", "ReaderOutOfData", None]
    with pytest.raises(Exception, match="WriterOutOfSpace"):
        rows.select(columns.fits(F.col("wire"), 1)).collect()
    with pytest.raises(Exception, match="IncorrectLength"):
        rows.limit(1).select(columns.unpack_value(F.concat("wire", "wire"), w.U8)).collect()
    with pytest.raises(TypeError):
        columns.pack_value(F.col("wire"), w.STR)
    assert rows.limit(0).select(columns.decode_value(F.col("wire"), w.U8)).collect() == []
    unsigned = spark.createDataFrame([(-1, -1)], "a short, b long").select(structural.wire_hex(F.col("a"), T.ShortType(), False, {"unsigned": True}).alias("h"))
    assert unsigned.first().h == "82FFFF"
    with pytest.raises(Exception, match="InvalidData"):
        spark.range(70_000, 70_001).select(structural.uint_wire(F.col("id"), 16)).collect()


def test_registered_codecs_in_schemas(spark):
    if "test.point" not in w.registry.types:
        w.registry.register("test.point", w.tuple_of(w.I32, w.U8))
    shape = columns.spark_type("test.point")
    kind = T.StructType([T.StructField("p", shape, True, {"codec": "test.point"}), T.StructField("many", T.ArrayType(shape, False), False, {"codec": "test.point"}), T.StructField("n", T.IntegerType(), False)])
    df = spark.createDataFrame([((-2, 9), [(1, 2), (3, 4)], 5), (None, [], 6)], T.StructType([T.StructField(f.name, f.dataType, True) for f in kind]))
    whole = F.struct(*df.columns)
    got = df.select("*", structural.wire_hex(whole, kind).alias("h")).withColumn("b", structural.decode_column(F.unhex("h"), kind)).orderBy("n").collect()
    assert [r.h for r in got] == ["01" + "03" + "09" + "02" + "0202" + "0604" + "0A", "00" + "00" + "0C"]
    assert [(r.b.p, r.b.many, r.b.n) for r in got] == [(r.p, r.many, r.n) for r in got]


NESTED = w.Struct(("id", w.U32), ("keys", w.Vec(w.Keyed("k", w.FixedBytes(2, delta=False)))), ("name", w.Option(w.Keyed("n", w.U16))), ("body", w.BYTES), ("mark", w.FixedBytes(3)))


def test_contexts(spark):
    """Rows of several scopes folded like the scalar codec with a context that the controls act on."""
    rng = random.Random(4)
    rows = []
    for pos in range(200):
        value = (pos, [rng.choice([b"aa", b"bb", b"cc"]) for _ in range(rng.randrange(4))], rng.choice([None, 1, 2]), rng.choice([b"x" * 90, b"x" * 80 + b"y" * 10, b""]), rng.choice([b"abc", b"abd"]))
        rows.append((pos, rng.choice([None, 1, 2]), rng.choice([None, 7, 8]), rng.random() < 0.03, rng.choice([None] * 20 + ["k"]), rng.random() < 0.05, None if pos == 50 else value))
    shape = T.StructType().add("pos", "long").add("scope", "long").add("key", "long").add("clear", "boolean").add("clear_type", "string").add("remove", "boolean").add("v", columns.spark_type(NESTED))
    df = spark.createDataFrame(rows, shape).repartition(5)
    frozen = [("k", b"cc"), ("n", (2).to_bytes(2, "little"))]
    for base in (None, frozen):
        options = {"key": "key", "clear": "clear", "clear_type": "clear_type", "remove_key": "remove", "frozen": base}
        wire = columns.encode_rows(df, "v", NESTED, "pos", "scope", **options)
        got = {r.pos: r.wire if r.wire is None else bytes(r.wire) for r in wire.collect()}
        made = lambda: w.Context(w.Dictionary.primed(base, True) if base else w.Dictionary(), w.Versions())  # noqa: B023, E731
        contexts = {}
        for pos, scope, key, clear, kind, remove, value in rows:
            context = contexts.setdefault(scope, made())
            if clear:
                context = contexts[scope] = made()
            if kind:
                context.dictionary.clear_kind(kind)
            context.versions.key = key
            if remove:
                context.versions.blobs.pop(key, None)
            assert got[pos] == (None if value is None else NESTED.dumps(value, context)), pos
        back = columns.decode_rows(wire.withColumnRenamed("v", "was"), "wire", NESTED, "pos", "scope", **options, value="v")
        assert back.filter(~F.col("v").eqNullSafe(F.col("was"))).isEmpty() and back.count() == 200
    assert columns.encode_rows(df.limit(0), "v", NESTED, "pos").count() == 0
    with pytest.raises(Exception, match="InvalidData"):
        columns.decode_rows(spark.createDataFrame([(1, b"\x05")], "pos long, wire binary"), "wire", w.Keyed("k", w.U8), "pos").collect()


def test_delta_epochs_and_removal(spark):
    rows = [(i, i % 2, i // 6, i % 5 == 0, bytes([i % 7]) * 50) for i in range(30)] + [(100, None, 0, False, b"z")]
    df = spark.createDataFrame(rows, "pos long, k long, epoch long, forget boolean, b binary")
    done = delta.encode(df, ["k", "epoch"], "pos", "b", remove="forget")
    whole = {r.pos for r in done.collect() if r.mode == 0}
    assert {i for i in range(30) if i % 5 == 0 or i % 6 < 2} | {100} <= whole
    back = delta.decode(done.drop("b"), ["k", "epoch"], "pos", remove="forget")
    assert sorted((r.pos, bytes(r.blob)) for r in back.collect()) == [(r[0], r[4]) for r in rows]


def test_own_integer_scheme(spark):
    """Another varint in the place of the usual one, for every integer type that is given it."""

    def write(value):
        out = bytearray()
        while value > 127:
            out.append(value & 127 | 128)
            value >>= 7
        return bytes([*out, value])

    def read(reader, width):
        value = shift = 0
        while True:
            byte = reader.take(1)[0]
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    scheme = w.Scheme(write, read)
    _round(spark, w.Int(64, scheme=scheme), [0, 300, 2**64 - 1])
    _round(spark, w.Vec(w.Int(32, True, scheme=scheme)), [[-1, 5, -(2**31)], []])
    assert w.Int(16, scheme=scheme).dumps(300) == b"\xac\x02" and w.U16.dumps(300) == b"\x82\x2c\x01"


def test_wide_and_slices(spark):
    big = [0, 1, 2**64 - 1, 2**127, 2**200 + 5, 2**255]
    df = spark.createDataFrame([(i, x.to_bytes(32, "little"), 13 * i) for i, x in enumerate(big)], "i int, v binary, k int")
    v, k = F.col("v"), F.col("k")
    got = df.select("i", "k", wide.shift_left(v, k).alias("l"), wide.shift_right(v, k).alias("r"), wide.number_hex(v).alias("h")).collect()
    for r in got:
        x = big[r.i]
        assert (int.from_bytes(r.l, "little"), int.from_bytes(r.r, "little"), r.h) == ((x << r.k) % 2**256, x >> r.k, f"{x:X}")
    with pytest.raises(Exception, match="InvalidData"):
        df.select(wide.subtract(wide.from_long(F.lit(1)), wide.from_long(F.lit(2)))).collect()
    with pytest.raises(Exception, match="InvalidData"):
        df.select(wide.add(v, v)).collect()
    for kind, values in ((w.U64, [[1, 2**64 - 1], [], None]), (w.U16, [[65535, 0]]), (w.F32, [[1.5], [0.25, 2.0]]), (w.FixedBytes(2), [[b"ab", b"cd"]]), (w.I8, [[-128, 127]])):
        taken = columns.to_spark(kind)
        rows = spark.createDataFrame([(i, None if x is None else [taken(y) for y in x]) for i, x in enumerate(values)], T.StructType().add("i", "integer").add("v", T.ArrayType(columns.spark_type(kind))))
        rows = rows.withColumn("p", columns.pack_slices(F.col("v"), kind)).withColumn("b", columns.unpack_vecs(F.col("p"), F.size("v"), kind))
        for r in rows.collect():
            assert r.b == r.v and (r.p is None if r.v is None else bytes(r.p) == b"".join(map(kind.pack, values[r.i])))
    with pytest.raises(Exception, match="InvalidData"):
        spark.createDataFrame([([70_000],)], "v array<int>").select(columns.pack_slices(F.col("v"), w.U16)).collect()
    stored = spark.createDataFrame([(1, 7, b"abc"), (2, 7, b"ab"), (3, None, b"x")], "pos long, k long, b binary")
    assert [tuple(r) for r in delta.keys(stored, "k", "pos", "b").collect()] == [(7, 2)] and delta.contains_key(stored, "k", 7) and not delta.contains_key(stored, "k", 8)
