"""DataFrame operators against the scalar codec, SQL oracles and each other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import deltas
from lamina.functions import varint as v
from lamina.functions import wire as w
from lamina.operators import delta, dictionary, flagged, structural

EDGES = [0, 1, 127, 128, 255, 256, 65535, 65536, 2**31, 2**63 - 1, -1, -64, -65, -(2**63)]


def test_varint_columns(spark):
    rows = spark.createDataFrame([(x,) for x in EDGES], "x long")
    x = F.col("x")
    rows = rows.select("x", v.varint_hex(x).alias("u"), v.varint_len(x).alias("n"), v.int_wire(x).alias("s"), v.zigzag_inverse(v.zigzag(x)).alias("back"), v.le_hex(x, 8).alias("p"))
    rows = rows.withColumn("d", v.decode_varint(F.unhex("u"))).withColumn("unpacked", v.unpack_int(F.unhex("p")))
    for r in rows.collect():
        wire = w.varint(r.x % 2**64)
        assert (r.u, r.n, r.back, r.d.value, r.d.next_offset, r.d.error_class, r.unpacked) == (wire.hex().upper(), len(wire), r.x, r.x, len(wire), None, r.x)
        assert r.s == w.I64.dumps(r.x).hex().upper() and r.p == (r.x % 2**64).to_bytes(8, "little").hex().upper()


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_narrow_integers(spark, bits):
    low = -(1 << (bits - 1))
    values = [low, low + 1, -1, 0, 1, -low - 1]
    rows = spark.createDataFrame([(x,) for x in values], "x long").select("x", v.int_wire(F.col("x"), bits).alias("s"), v.unpack_int(F.unhex(v.pack_int(F.col("x"), bits)), bits).alias("back"))
    for r in rows.collect():
        assert r.s == w.Int(bits, True).dumps(r.x).hex().upper() and r.back == r.x


def test_varint_errors(spark):
    cases = [("83", 8, "ReaderOutOfData"), ("", 8, "ReaderOutOfData"), ("80", 8, "InvalidData"), ("8901020304050607080910", 8, "InvalidData"), ("83010203", 2, "InvalidData"), ("8105", 8, None)]
    for text, width, error in cases:
        rows = spark.range(1).select(v.decode_varint(F.unhex(F.lit(text)), 0, 8 * width).alias("d"), v.decode_varint(F.unhex(F.lit(text)), 0, 8 * width, canonical=True).alias("c"))
        r = rows.first()
        assert r.d.error_class == error and (error or r.d.value == 5)
        assert r.c.error_class == (error or "InvalidData")
    assert spark.range(1).select(v.decode_bool(F.unhex(F.lit("02"))).alias("d")).first().d.error_class == "InvalidData"
    with pytest.raises(Exception, match="InvalidData"):
        spark.range(1).select(v.nonzero(F.col("id"))).collect()


SCHEMA = T.StructType([
    T.StructField("a", T.LongType(), True), T.StructField("b", T.StringType(), True), T.StructField("c", T.ArrayType(T.StringType(), True), False),
    T.StructField("d", T.MapType(T.StringType(), T.IntegerType(), False), False), T.StructField("e", T.DoubleType(), True), T.StructField("f", T.BinaryType(), False, {"fixed": 2}),
    T.StructField("g", T.ArrayType(T.FloatType(), False), False), T.StructField("h", T.BooleanType(), True), T.StructField("i", T.ByteType(), False),
    T.StructField("j", T.StructType([T.StructField("k", T.ShortType(), False), T.StructField("l", T.ArrayType(T.LongType(), True), True)]), False),
    T.StructField("m", T.BinaryType(), True), T.StructField("n", T.IntegerType(), False, {"unsigned": True}),
])


def test_structural_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        maybe = lambda x: None if rng.random() < 0.2 else x
        rows.append((
            maybe(rng.randrange(-(2**63), 2**63)), maybe("né" * rng.randrange(60)), [maybe("x" * rng.randrange(90)) for _ in range(rng.randrange(4))], {f"k{i}": rng.randrange(-99, 99) for i in range(rng.randrange(4))},
            maybe(rng.random()), rng.randbytes(2), [float(rng.randrange(9)) for _ in range(rng.randrange(5))], maybe(rng.random() < 0.5), rng.randrange(-128, 128),
            (rng.randrange(-999, 999), maybe([maybe(rng.randrange(-999, 999)) for _ in range(rng.randrange(3))])), maybe(rng.randbytes(rng.randrange(200))), rng.randrange(2**31),
        ))
    df = spark.createDataFrame(rows, SCHEMA)
    whole = F.struct(*df.columns)
    got = df.select(whole.alias("v"), F.unhex(structural.wire_hex(whole, SCHEMA)).alias("wire")).withColumn("back", structural.decode_column(F.col("wire"), SCHEMA))
    codec = structural.codec_of(SCHEMA)
    for r in got.collect():
        value = r.v.asDict(True)
        assert bytes(r.wire) == codec.dumps(value)
        assert r.back == r.v
    wide = structural.encode_columns(df, ["a", "c"])
    assert wide.columns[-2:] == ["a_wire", "c_wire"] and wide.filter("a is null and hex(a_wire) <> '00'").isEmpty()


def test_structural_errors(spark):
    kind = T.ArrayType(T.LongType(), False)
    rows = spark.createDataFrame([(bytes.fromhex(x),) for x in ("0102", "01", "010203", "880000000000000001")], "wire binary")
    got = [r.d.error_class for r in rows.select(structural.decode_column(F.col("wire"), kind, strict=False).alias("d")).collect()]
    assert got == [None, "ReaderOutOfData", "InvalidData", "ReaderOutOfData"]
    with pytest.raises(Exception, match="InvalidData"):
        spark.createDataFrame([(None,)], "x long").select(structural.wire_hex(F.col("x"), T.LongType())).collect()
    with pytest.raises(Exception, match="IncorrectLength"):
        spark.createDataFrame([(b"abc",)], "x binary").select(structural.wire_hex(F.col("x"), T.BinaryType(), False, {"fixed": 2})).collect()
    with pytest.raises(TypeError):
        structural.wire_hex(F.col("x"), T.DateType())


def test_sets_results_enums_headers(spark):
    df = spark.range(1)
    hexes = df.select(
        structural.set_hex(F.array(F.lit(3), F.lit(1), F.lit(3)).cast("array<bigint>"), T.ArrayType(T.LongType(), False)).alias("set"),
        structural.result_hex(F.lit(False), F.lit(1), F.lit("x"), T.IntegerType(), T.StringType()).alias("result"),
        structural.enum_hex(F.lit("R"), {"L": None, "R": None}, {"L": 5, "R": 300}).alias("enum"), structural.header_hex(F.lit(2), F.lit(0), F.lit(2)).alias("header"),
    ).first()
    assert tuple(hexes) == ("020206", "000278", "822C01", "83020002")
    with pytest.raises(Exception, match="unknown variant"):
        df.select(structural.enum_hex(F.lit("Z"), {"L": None})).collect()


def test_flagged(spark):
    rng = random.Random(1)
    data = [b"", b"a", b"A" * 63, b"A" * 64, bytes(range(80)), rng.randbytes(300), bytes(10000), b"word " * 100, None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x binary")
    rows = rows.withColumn("wire", flagged.flagged(F.col("x"))).withColumn("back", flagged.read_flagged(F.col("wire"))).withColumn("gate", flagged.looks_incompressible(F.col("x")))
    for r in rows.collect():
        if r.x is None:
            assert r.wire is None
            continue
        assert bytes(r.wire) == w.flagged(bytes(r.x)) and bytes(r.back) == bytes(r.x) and r.gate == w.looks_incompressible(bytes(r.x))
    with pytest.raises(Exception, match="InvalidData"):
        spark.createDataFrame([(b"\x02\xff",)], "x binary").select(flagged.read_flagged(F.col("x"), True)).collect()


def test_dictionary_matches_the_scalar_codec(spark):
    rng = random.Random(4)
    stream = [(i, i // 40, rng.choice("ab"), rng.choice([None, *"uvwxyz"])) for i in range(160)]
    df = spark.createDataFrame(stream, "pos long, epoch long, t string, x string")
    for scope in ([], ["epoch"]):
        for frozen in (None, [("a", "u"), ("a", "v"), ("b", "u")]):
            table = None if frozen is None else spark.createDataFrame([(t, x, i) for i, (t, x) in enumerate(frozen, 1)], "type string, value string, id long")
            got = {r.pos: r.wire_id for r in dictionary.encode(df, "x", "pos", scope, "t", table).collect()}
            books, want = {}, {}
            for pos, epoch, t, x in stream:
                book = books.setdefault(epoch if scope else 0, w.Dictionary.primed(frozen, True) if frozen else w.Dictionary())
                want[pos] = book.lookup(t, x) or 0
            assert got == want
            wire = dictionary.encode(df, "x", "pos", scope, "t", table).select("pos", "epoch", "t", "wire_id", F.when(F.col("is_new"), F.col("x")).alias("x"))
            back = dictionary.decode(wire, "x", "pos", scope, "t", table)
            assert sorted((r.pos, r.x) for r in back.collect()) == [(p, x) for p, _, _, x in stream]
    with pytest.raises(Exception, match="InvalidData"):
        dictionary.decode(spark.createDataFrame([(1, 5, None)], "pos long, wire_id long, x string"), "x", "pos").collect()


def test_dictionary_tools(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([42, 123, 42, 456, 123, 789, 42])], "pos long, x long")
    done = dictionary.encode(df, "x", "pos")
    wire = done.select("pos", dictionary.wire(done, v.pack_int(F.col("x"), 32)).alias("h"), dictionary.wire_size(4).alias("n")).orderBy("pos").collect()
    assert "".join(r.h for r in wire).lower() == "002a000000007b0000000100c801000002001503000001" and sum(r.n for r in wire) == 23
    book = dictionary.dictionary_of(done, "x")
    assert tuple(dictionary.stats(book).first()) == (4, 1, 32) and dictionary.values_for_type(book, "").count() == 4
    primed = dictionary.prime(df, "pos", "x")
    assert sorted((r.value, r.id) for r in primed.collect()) == [(42, 1), (123, 2), (456, 3), (789, 4)]
    marks = dictionary.clear_type_epochs(df.withColumn("clear", F.col("x") == 456), "pos", "clear")
    assert [r.epoch for r in marks.orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1, 1]
    nested = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["b", "c"])], "pos long, xs array<string>")
    assert {r.pos: r.wire_ids for r in dictionary.encode_nested(nested, "xs", "pos").collect()} == {1: [0, 0, 1], 2: [], 3: [2, 0]}


def test_delta_matches_the_scalar_codec(spark):
    rng = random.Random(5)
    rows, last = [], {}
    for pos in range(80):
        key = rng.choice([None, 1, 2])
        blob = bytearray(last.get(key) or rng.randbytes(rng.randrange(200)))
        for _ in range(rng.randrange(4)):
            if blob:
                blob[rng.randrange(len(blob))] = rng.randrange(256)
        last[key] = bytes(blob) + rng.randbytes(rng.choice([0, 0, 5]))
        rows.append((pos, key, last[key]))
    df = spark.createDataFrame(rows, "pos long, k long, b binary")
    done = delta.encode(df, "k", "pos", "b")
    store: dict = {}
    for r in done.orderBy("pos").collect():
        old = store.get(r.k) if r.k is not None else None
        assert bytes(r.wire) == deltas.delta(old, bytes(r.b)) and r.mode == r.wire[0]
        store[r.k] = bytes(r.b)
    back = delta.decode(done.drop("b", "mode"), "k", "pos")
    assert sorted((r.pos, bytes(r.blob)) for r in back.collect()) == [(p, b) for p, _, b in rows]
    assert tuple(delta.store_stats(df, "k", "pos", "b").first()) == (2, len(store[1]) + len(store[2]))
    with pytest.raises(Exception, match="InvalidData"):
        delta.decode(done.filter("mode = 1").drop("b", "mode").limit(1), "k", "pos").collect()


def test_decode_stream(spark):
    wire = b"".join(w.Struct(("a", w.I64), ("b", w.STR)).dumps((i, "x" * i)) for i in range(5))
    kind = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType(), False)])
    got = structural.decode_stream(spark.createDataFrame([(1, wire), (2, b"")], "id long, wire binary"), kind).orderBy("position").collect()
    assert [(r.id, r.position, r.value.a, r.value.b) for r in got] == [(1, i, i, "x" * i) for i in range(5)] and got[-1].next_offset == len(wire)
