"""Columns to wire bytes and back, directed by the Spark schema.

Encoding builds one Column expression from the type (built-in functions; only floats, and strings or binary that may be
compressed, pass through an Arrow UDF).  Decoding compiles the type into a codec once and runs it in an Arrow UDF.

Spark type -> wire type: tinyint i8, smallint i16, int i32, bigint i64 (field metadata {"unsigned": true}: u8 .. u64),
boolean, float f32, double f64, string, binary (metadata {"fixed": n}: n raw bytes), array vec, map ordered map, struct
its fields in order.  A nullable field is an option; a null where the schema allows none is an error.  Metadata
{"codec": name}: the codec registered under that name, for the field or, in an array, its elements (see columns.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wire as w
from ..functions.varint import bool_wire, int_wire, uint_wire, varint_hex
from . import columns
from .flagged import flagged_hex

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _float_udf(kind: str):
    @F.pandas_udf(T.StringType())
    def bits(values: pd.Series) -> pd.Series:
        raw = values.to_numpy(dtype=kind)
        text = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize)
        return pd.Series([None if m else x.tobytes().hex().upper() for x, m in zip(text, values.isna() & ~np.isnan(raw), strict=True)])

    return bits


def float_hex(value: Column, bits: int = 64) -> Column:
    """IEEE bytes of a float or double, least first (hex)."""
    return _float_udf("<f4" if bits == 32 else "<f8")(value)


@F.pandas_udf(T.StringType())
def _float_list_hex(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes().hex().upper())


@F.pandas_udf(T.StringType())
def _double_list_hex(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else np.asarray(v, dtype="<f8").tobytes().hex().upper())


def needs_python(kind: T.DataType) -> bool:
    """Whether a value of the type may hold floats, or strings or binary to compress."""
    if isinstance(kind, T.ArrayType):
        return needs_python(kind.elementType)
    if isinstance(kind, T.MapType):
        return needs_python(kind.keyType) or needs_python(kind.valueType)
    if isinstance(kind, T.StructType):
        return any("codec" in f.metadata or needs_python(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.FloatType, T.DoubleType, T.StringType, T.BinaryType))


def _whole_hex(value: Column, kind: T.DataType, metadata: dict) -> Column:
    """Wire form (hex) by the scalar codec: lambdas take no UDF, so collections of such elements are encoded whole."""
    return F.hex(columns.encode_value(value, codec_of(kind, False, metadata)))


def wire_hex(value: Column, kind: T.DataType, nullable: bool = False, metadata: dict | None = None) -> Column:
    """Wire form (hex) of a column of the given type."""
    if nullable:
        return F.when(value.isNull(), "00").otherwise(F.concat(F.lit("01"), wire_hex(value, kind, False, metadata)))
    metadata = metadata or {}
    bits = _BITS.get(type(kind))
    if "codec" in metadata and not isinstance(kind, (T.ArrayType, T.MapType)):
        out = F.hex(columns.encode_value(value, metadata["codec"]))
    elif bits:
        out = uint_wire(value, bits) if metadata.get("unsigned") else int_wire(value, bits)
    elif isinstance(kind, T.BooleanType):
        out = bool_wire(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = float_hex(value, 32 if isinstance(kind, T.FloatType) else 64)
    elif isinstance(kind, T.BinaryType) and "fixed" in metadata:
        out = F.when(F.octet_length(value) == metadata["fixed"], F.hex(value)).when(value.isNotNull(), F.raise_error(F.lit("IncorrectLength: binary of another length")))
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        out = flagged_hex(value, isinstance(kind, T.StringType))
    elif isinstance(kind, T.ArrayType):
        head = varint_hex(F.size(value))
        if not kind.containsNull and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            out = F.concat(head, (_float_list_hex if isinstance(kind.elementType, T.FloatType) else _double_list_hex)(value))
        elif needs_python(kind) or "codec" in metadata:
            out = _whole_hex(value, kind, metadata)
        else:
            out = F.concat(head, F.array_join(F.transform(value, lambda x: wire_hex(x, kind.elementType, kind.containsNull, metadata)), ""))
    elif isinstance(kind, T.MapType) and needs_python(kind):
        out = _whole_hex(value, kind, metadata)
    elif isinstance(kind, T.MapType):
        one = lambda e: F.concat(wire_hex(e["key"], kind.keyType), wire_hex(e["value"], kind.valueType, kind.valueContainsNull))
        out = F.concat(varint_hex(F.size(value)), F.array_join(F.transform(F.array_sort(F.map_entries(value)), one), ""))
    elif isinstance(kind, T.StructType):
        parts = [wire_hex(value[f.name], f.dataType, f.nullable, f.metadata) for f in kind.fields]
        out = F.when(value.isNotNull(), F.concat(*parts) if parts else F.lit(""))
    else:
        raise TypeError(f"no wire form for {kind.simpleString()}")
    return F.when(out.isNull(), F.raise_error(F.lit("InvalidData: null where the schema allows none"))).otherwise(out)


def set_hex(value: Column, kind: T.ArrayType) -> Column:
    """An array as a set: distinct, ascending."""
    return wire_hex(F.array_sort(F.array_distinct(value)), kind)


def result_hex(ok: Column, value: Column, error: Column, value_type: T.DataType, error_type: T.DataType) -> Column:
    return F.when(ok, F.concat(F.lit("01"), wire_hex(value, value_type))).otherwise(F.concat(F.lit("00"), wire_hex(error, error_type)))


def enum_hex(tag: Column, variants: dict[str, tuple[Column, T.DataType] | None], numbers: dict[str, int] | None = None) -> Column:
    """Tagged union: varint of the variant's place (or number, where no variant has a body), then its body."""
    plain = all(v is None for v in variants.values())
    out = None
    for place, (name, body) in enumerate(variants.items()):
        head = varint_hex(F.lit(numbers[name] if plain and numbers else place).cast("long"))
        form = head if body is None else F.concat(head, wire_hex(*body))
        out = F.when(tag == name, form) if out is None else out.when(tag == name, form)
    return out.otherwise(F.raise_error(F.lit("InvalidData: unknown variant")))


def header_hex(a: Column, b: Column, c: Column) -> Column:
    """Three bytes packed into one unsigned integer, then its varint."""
    low = lambda x: F.pmod(x.cast("long"), F.lit(256))
    return varint_hex(low(a) + F.shiftleft(low(b), 8) + F.shiftleft(low(c), 16))


def encode_columns(df: DataFrame, columns: list[str] | None = None, suffix: str = "_wire") -> DataFrame:
    """Adds a binary wire column beside each of the columns, so that others stay prunable; nullability per the schema."""
    fields = {f.name: f for f in df.schema.fields}
    return df.withColumns({c + suffix: F.unhex(wire_hex(F.col(c), fields[c].dataType, fields[c].nullable, fields[c].metadata)) for c in columns or df.columns})


# ---- decoding


def codec_of(kind: T.DataType, nullable: bool = False, metadata: dict | None = None) -> w.Type:
    """The scalar codec of a Spark type, by the same rules as wire_hex."""
    if nullable:
        return w.Option(codec_of(kind, False, metadata))
    metadata = metadata or {}
    bits = _BITS.get(type(kind))
    if "codec" in metadata and not isinstance(kind, (T.ArrayType, T.MapType)):
        return w.registry[metadata["codec"]]
    if bits:
        return w.Int(bits, not metadata.get("unsigned"))
    if isinstance(kind, T.BooleanType):
        return w.BOOL
    if isinstance(kind, T.FloatType):
        return w.F32
    if isinstance(kind, T.DoubleType):
        return w.F64
    if isinstance(kind, T.StringType):
        return w.STR
    if isinstance(kind, T.BinaryType):
        return w.FixedBytes(metadata["fixed"]) if "fixed" in metadata else w.BYTES
    if isinstance(kind, T.ArrayType):
        return w.Vec(codec_of(kind.elementType, kind.containsNull, metadata))
    if isinstance(kind, T.MapType):
        return w.MapOf(codec_of(kind.keyType), codec_of(kind.valueType, kind.valueContainsNull))
    if isinstance(kind, T.StructType):
        return w.Struct(*[(f.name, codec_of(f.dataType, f.nullable, f.metadata)) for f in kind.fields])
    raise TypeError(f"no wire form for {kind.simpleString()}")


def _bare(kind: T.DataType) -> T.DataType:
    """The type without field metadata, as a UDF returns it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _bare(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_bare(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_bare(kind.keyType), _bare(kind.valueType), True)
    return kind


def decode_column(wire: Column, kind: T.DataType, nullable: bool = False, metadata: dict | None = None, strict: bool = True) -> Column:
    """Decode binary; strict: an error fails the query, else struct(value, error_class) with a null value.

    All bytes must be used up; what follows the value is InvalidData.
    """
    return columns.decode_value(wire, codec_of(kind, nullable, metadata), strict, _bare(kind))


def decode_stream(df: DataFrame, kind: T.DataType, wire_col: str = "wire", nullable: bool = False) -> DataFrame:
    """Rows of concatenated values -> one row per value with its place: the columns, position, value, next_offset."""
    codec = codec_of(kind, nullable)
    taken = columns.to_spark(codec, True)
    keep = [c for c in df.columns if c not in (wire_col, "position", "value", "next_offset")]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("position", T.LongType()), T.StructField("value", kind), T.StructField("next_offset", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                reader, n = w.Reader(bytes(row[wire_col] or b"")), 0
                while reader.left():
                    value = taken(codec.decode(reader))
                    rows.append({c: row[c] for c in keep} | {"position": n, "value": value, "next_offset": reader.position})
                    n += 1
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select(*keep, wire_col).mapInArrow(run, schema)
