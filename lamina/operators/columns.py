"""Any codec as a column codec: descriptors of lamina.functions.wire over DataFrame columns, with contexts.

A descriptor has a Spark type (spark_type): integers up to 64 bits the narrowest type that holds them (u64: the bit pattern
of a long), wider ones binary of their full width, least byte first; options are nulls; results struct(ok, value, error);
enums without bodies strings, others struct(tag, and a field for each variant with a body); keyed leaves what they hold.
A descriptor may be given by the name under which it is registered.

Values by themselves go through an Arrow UDF, a batch at a time.  Values whose bytes depend on the ones before them, that is
with dictionary leaves or deltas anywhere inside, are folded in order by encode_rows and decode_rows: a scope is a stream of
its own, sorted inside its partition and folded row by row, holding nothing but its dictionary and the last blob of each key.
A stream without scope is one task, as every id depends on all rows before it; a single leaf column needs no fold
(see dictionary.encode and delta.encode).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wire as w

_UNSIGNED = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.LongType()}
_SIGNED = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
#: Frozen dictionaries are held by every task of a fold; larger ones are refused.
FROZEN_VALUES = 1_000_000


def resolve(kind: w.Type | str) -> w.Type:
    return w.registry[kind] if isinstance(kind, str) else kind


def _bodies(kind: w.Enum) -> list[tuple[str, w.Type]]:
    return [(n, b) for n, b in zip(kind.names, kind.bodies, strict=True) if b is not None and not isinstance(b, w._Unit)]


def spark_type(kind: w.Type | str) -> T.DataType:
    """The Spark type of a descriptor's values. Units have none: fields of that type are left out."""
    kind = resolve(kind)
    field = lambda name, of: T.StructField(name, spark_type(of), True)
    if isinstance(kind, w.Int):
        return (_SIGNED if kind.signed else _UNSIGNED).get(kind.bits, T.BinaryType())
    if isinstance(kind, w.Float):
        return T.FloatType() if kind.bits == 32 else T.DoubleType()
    if isinstance(kind, w._Bool):
        return T.BooleanType()
    if isinstance(kind, w._Str):
        return T.StringType()
    if isinstance(kind, (w.Bytes, w.FixedBytes)):
        return T.BinaryType()
    if isinstance(kind, (w.Array, w.Vec, w.SetOf)):
        return T.ArrayType(spark_type(kind.of))
    if isinstance(kind, w.MapOf):
        return T.MapType(spark_type(kind.key), spark_type(kind.value))
    if isinstance(kind, (w.Option, w.Keyed)):
        return spark_type(kind.of)
    if isinstance(kind, w.Mapped):
        return spark_type(kind.shape if kind.shape is not None else kind.of)
    if isinstance(kind, w.Result):
        return T.StructType([T.StructField("ok", T.BooleanType()), *[field(n, t) for n, t in (("value", kind.ok), ("error", kind.error)) if not isinstance(t, w._Unit)]])
    if isinstance(kind, w.Struct):
        return T.StructType([field(n, t) for n, t in zip(kind.names, kind.types, strict=True) if not isinstance(t, w._Unit)])
    if isinstance(kind, w.Enum):
        return T.StructType([T.StructField("tag", T.StringType()), *[field(n, b) for n, b in _bodies(kind)]]) if _bodies(kind) else T.StringType()
    raise TypeError(f"no Spark type for {type(kind).__name__}")


def _same(x):
    return x


def _optional(f: Callable) -> Callable:
    return f if f is _same else lambda x: None if x is None else f(x)


def from_spark(kind: w.Type) -> Callable:
    """Function from a value as Arrow gives it to the value that the descriptor encodes."""
    if isinstance(kind, w.Int):
        if kind.bits > 64:
            return lambda x: int.from_bytes(x, "little", signed=kind.signed)
        return _same if kind.signed else lambda x: x if x >= 0 else x + (1 << kind.bits)  # a bit pattern
    if isinstance(kind, (w.Array, w.Vec, w.SetOf)):
        of = from_spark(kind.of)
        return _same if of is _same else lambda x: [of(y) for y in x]
    if isinstance(kind, w.MapOf):
        key, value = from_spark(kind.key), from_spark(kind.value)
        return lambda x: {key(k): value(v) for k, v in (x.items() if isinstance(x, dict) else x)}
    if isinstance(kind, (w.Option, w.Keyed)):
        return _optional(from_spark(kind.of)) if isinstance(kind, w.Option) else from_spark(kind.of)
    if isinstance(kind, w.Mapped):
        return from_spark(kind.shape if kind.shape is not None else kind.of)
    if isinstance(kind, w.Result):
        good, bad = from_spark(kind.ok), from_spark(kind.error)
        return lambda x: (True, good(x.get("value"))) if x["ok"] else (False, bad(x.get("error")))
    if isinstance(kind, w.Struct):
        parts = [(n, from_spark(t)) for n, t in zip(kind.names, kind.types, strict=True)]
        return lambda x: [f(x.get(n)) for n, f in parts]
    if isinstance(kind, w.Enum):
        bodies = {n: from_spark(b) for n, b in _bodies(kind)}
        if not bodies:
            return _same
        return lambda x: (x["tag"], bodies[x["tag"]](x[x["tag"]])) if x["tag"] in bodies else x["tag"]
    return _same


def to_spark(kind: w.Type, pattern: bool = False) -> Callable:
    """Inverse of from_spark; pattern: unsigned integers of any width as the bit pattern of a signed type as wide."""
    if isinstance(kind, w.Int):
        if kind.bits > 64:
            return lambda x: x.to_bytes(kind.bits // 8, "little", signed=kind.signed)
        return (lambda x: x - (1 << kind.bits) if x >> (kind.bits - 1) else x) if not kind.signed and (pattern or kind.bits == 64) else _same
    if isinstance(kind, (w.Array, w.Vec, w.SetOf)):
        of = to_spark(kind.of, pattern)
        return _same if of is _same else lambda x: [of(y) for y in x]
    if isinstance(kind, w.MapOf):
        key, value = to_spark(kind.key, pattern), to_spark(kind.value, pattern)
        return lambda x: [(key(k), value(v)) for k, v in x.items()]
    if isinstance(kind, (w.Option, w.Keyed)):
        return _optional(to_spark(kind.of, pattern)) if isinstance(kind, w.Option) else to_spark(kind.of, pattern)
    if isinstance(kind, w.Mapped):
        return to_spark(kind.shape if kind.shape is not None else kind.of, pattern)
    if isinstance(kind, w.Result):
        good, bad = to_spark(kind.ok, pattern), to_spark(kind.error, pattern)
        return lambda x: {"ok": True, "value": good(x[1])} if x[0] else {"ok": False, "error": bad(x[1])}
    if isinstance(kind, w.Struct):
        parts = [(n, to_spark(t, pattern)) for n, t in zip(kind.names, kind.types, strict=True) if not isinstance(t, w._Unit)]
        if kind.as_tuple:
            return lambda x: {n: f(y) for (n, f), y in zip(parts, x, strict=True)}
        return lambda x: {n: f(x[n]) for n, f in parts}
    if isinstance(kind, w.Enum):
        bodies = {n: to_spark(b, pattern) for n, b in _bodies(kind)}
        if not bodies:
            return _same
        return lambda x: {"tag": x} if isinstance(x, str) else {"tag": x[0], x[0]: bodies[x[0]](x[1])}
    return _same


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def encode_value(value: Column, kind: w.Type | str) -> Column:
    """Wire bytes of a column; null gives null."""
    kind = resolve(kind)
    given = from_spark(kind)

    @F.arrow_udf(T.BinaryType())
    def encode(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else kind.dumps(given(x)) for x in values.to_pylist()], pa.binary())

    return encode(value)


def decode_value(wire: Column, kind: w.Type | str, strict: bool = True, shape: T.DataType | None = None) -> Column:
    """Decode binary; strict: an error fails the query, else struct(value, error_class). All bytes must be used up.

    shape: the Spark type to return where it isn't spark_type(kind); unsigned integers are then bit patterns.
    """
    kind = resolve(kind)
    taken = to_spark(kind, shape is not None)
    shape = spark_type(kind) if shape is None else shape
    out = shape if strict else T.StructType([T.StructField("value", shape), T.StructField("error_class", T.StringType())])
    arrow = _arrow(out)

    def one(data):
        try:
            reader = w.Reader(data)
            value = taken(kind.decode(reader))
            if reader.left():
                raise w.InvalidData(f"{reader.left()} bytes too many")
        except w.WireError as e:
            if strict:
                raise
            return {"value": None, "error_class": e.error_class}
        return value if strict else {"value": value, "error_class": None}

    @F.arrow_udf(out)
    def decode(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x) for x in values.to_pylist()], arrow)

    return decode(wire)


def pack_value(value: Column, kind: w.Type | str) -> Column:
    """Fixed-width bytes of a column of a type that has them (integers, floats, fixed bytes, arrays and structs of such)."""
    kind = resolve(kind)
    if kind.width is None:
        raise TypeError("the type has no fixed width")
    given = from_spark(kind)

    @F.arrow_udf(T.BinaryType())
    def pack(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else kind.pack(given(x)) for x in values.to_pylist()], pa.binary())

    return pack(value)


def unpack_value(packed: Column, kind: w.Type | str) -> Column:
    """Inverse of pack_value; bytes cut short or left over are errors."""
    kind = resolve(kind)
    if kind.width is None:
        raise TypeError("the type has no fixed width")
    shape, taken = spark_type(kind), to_spark(kind)
    arrow = _arrow(shape)

    def one(data):
        if len(data) > kind.width:
            raise w.IncorrectLength(f"{len(data)} bytes, {kind.width} wanted")
        return taken(kind.unpack(w.Reader(data)))

    @F.arrow_udf(shape)
    def unpack(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x) for x in values.to_pylist()], arrow)

    return unpack(packed)


def pack_slices(values: Column, kind: w.Type | str) -> Column:
    """Fixed-width forms of an array's elements in a row, without a length; numbers of a whole batch at once."""
    kind = resolve(kind)
    if kind.width is None:
        raise TypeError("the type has no fixed width")
    given, name = from_spark(kind), w.numpy_type(kind)

    @F.arrow_udf(T.BinaryType())
    def pack(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        if name is not None and not flat.null_count:
            # bit patterns of unsigned numbers are what a cast to the signed type of the same width gives
            data = flat.to_numpy(zero_copy_only=False)
            info = None if name[1] == "f" else np.iinfo(name)
            if info is not None and len(data) and (int(data.max()) > info.max or int(data.min()) < -(1 << (kind.bits - 1))):
                raise w.InvalidData(f"a value does not fit {kind.bits} bits")
            raw, size = data.astype(name).tobytes(), lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(size) * kind.width
            return pa.array([None if m else raw[e - n * kind.width : e] for e, n, m in zip(ends.tolist(), size.tolist(), lists.is_null().to_pylist(), strict=True)], pa.binary())
        return pa.array([None if x is None else w.pack_slice(kind, [given(y) for y in x]) for x in lists.to_pylist()], pa.binary())

    return pack(values)


def unpack_vecs(packed: Column, count: Column, kind: w.Type | str) -> Column:
    """Inverse of pack_slices: arrays of count elements; fewer or more bytes are errors."""
    kind = resolve(kind)
    if kind.width is None:
        raise TypeError("the type has no fixed width")
    shape, taken = T.ArrayType(spark_type(kind)), to_spark(kind)
    arrow = _arrow(shape)

    def one(data, n):
        if len(data) > n * kind.width:
            raise w.IncorrectLength(f"{len(data)} bytes, {n * kind.width} wanted")
        return [taken(x) for x in w.unpack_vec(kind, data, n)]

    @F.arrow_udf(shape)
    def unpack(values: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([None if x is None or n is None else one(x, n) for x, n in zip(values.to_pylist(), counts.to_pylist(), strict=True)], arrow)

    return unpack(packed, count)


def fits(wire: Column, capacity: int) -> Column:
    """wire, or the error WriterOutOfSpace where it is longer than the capacity."""
    return F.when(F.octet_length(wire) <= capacity, wire).when(wire.isNotNull(), F.raise_error(F.lit(f"WriterOutOfSpace: capacity is {capacity}")))


# ---- contexts


def frozen_values(dictionary: DataFrame) -> list[tuple[str, bytes]]:
    """(type, packed value) of a dictionary (type, value: packed binary, id) in order of id, for the folds below."""
    rows = dictionary.select("id", "type", "value").limit(FROZEN_VALUES + 1).collect()
    if len(rows) > FROZEN_VALUES:
        raise ValueError(f"a frozen dictionary of more than {FROZEN_VALUES} values; encode its leaf with dictionary.encode")
    return [(r["type"], bytes(r["value"])) for r in sorted(rows, key=lambda r: r["id"])]


class _State:
    """The context of a scope, and the controls that rows give."""

    def __init__(self, dictionary: bool, keyed: bool, frozen):
        self.dictionary, self.keyed, self.frozen = dictionary, keyed, w.Dictionary.primed(frozen) if frozen else None
        self.fresh()

    def fresh(self) -> None:
        base = w.Dictionary(frozen=self.frozen, issued=self.frozen.issued) if self.frozen else w.Dictionary()
        self.context = w.Context(base if self.dictionary else None, w.Versions() if self.keyed else None)

    def before(self, row: dict, names: dict) -> None:
        if names["clear"] and row[names["clear"]]:
            self.fresh()
        if names["clear_type"] and row[names["clear_type"]] is not None and self.dictionary:
            self.context.dictionary.clear_kind(row[names["clear_type"]])
        if self.keyed:
            self.context.versions.key = row[names["key"]]
            if names["remove_key"] and row[names["remove_key"]]:
                self.context.versions.blobs.pop(row[names["key"]], None)


def _folded(rows: DataFrame, order_by: str, scope, names: dict, frozen, dictionary: bool, into: T.StructField, source: str, work) -> DataFrame:
    scope = [scope] if isinstance(scope, str) else list(scope or [])
    kept = [c for c in rows.columns if c.lower() != into.name.lower()]
    needed = list(dict.fromkeys([*scope, *[n for n in names.values() if n], source]))
    rows = rows.select(*dict.fromkeys([*kept, source]))
    dealt = (rows.repartition(*scope) if scope else rows.repartition(1)).sortWithinPartitions(*scope, order_by)
    arrow, schema = _arrow(into.dataType), T.StructType([*[rows.schema[c] for c in kept], into])
    keyed = names["key"] is not None

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, here = _State(dictionary, keyed, frozen), None
        for batch in batches:
            out = []
            for row in batch.select(needed).to_pylist():
                at = tuple(row[c] for c in scope)
                if at != here:
                    state.fresh()
                    here = at
                state.before(row, names)
                out.append(None if row[source] is None else work(row[source], state.context))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, arrow)], names=[*kept, into.name])

    return dealt.mapInArrow(fold, schema)


def encode_rows(
    rows: DataFrame, value: str, kind: w.Type | str, order_by: str, scope: str | list[str] | None = None, *, dictionary: bool = True, key: str | None = None,
    clear: str | None = None, clear_type: str | None = None, remove_key: str | None = None, frozen: list[tuple[str, bytes]] | None = None, wire: str = "wire",
) -> DataFrame:
    """rows with wire: the bytes of value in the context that the scope's rows before it, by order_by, have left.

    dictionary: keyed leaves anywhere inside share one dictionary, ids in order of rows and fields.  key (a long column):
    byte leaves are deltas to the key's last blob; a null key encodes them as they are.  Before a row, clear (boolean)
    empties the whole context, clear_type (string) forgets that type's values while ids go on, and remove_key (boolean)
    forgets the row's key.  frozen: see frozen_values().  A null value gives null and leaves the context as it is.
    """
    kind = resolve(kind)
    given = from_spark(kind)
    names = {"key": key, "clear": clear, "clear_type": clear_type, "remove_key": remove_key}
    return _folded(rows, order_by, scope, names, frozen, dictionary, T.StructField(wire, T.BinaryType()), value, lambda x, context: kind.dumps(given(x), context))


def decode_rows(
    rows: DataFrame, wire: str, kind: w.Type | str, order_by: str, scope: str | list[str] | None = None, *, dictionary: bool = True, key: str | None = None,
    clear: str | None = None, clear_type: str | None = None, remove_key: str | None = None, frozen: list[tuple[str, bytes]] | None = None, value: str = "value",
) -> DataFrame:
    """rows with value: inverse of encode_rows with the same arguments; an id or a key that isn't known is InvalidData."""
    kind = resolve(kind)
    taken = to_spark(kind)
    names = {"key": key, "clear": clear, "clear_type": clear_type, "remove_key": remove_key}

    def one(data, context):
        reader = w.Reader(data)
        out = taken(kind.decode(reader, context))
        if reader.left():
            raise w.InvalidData(f"{reader.left()} bytes too many")
        return out

    return _folded(rows, order_by, scope, names, frozen, dictionary, T.StructField(value, spark_type(kind)), wire, one)
