"""Flagged bytes and strings: raw, or compressed where that is shorter.

What can be said without looking inside stays in built-in expressions: short values and those that the entropy gate
stops never reach Python.  The rest go through one Arrow UDF that compresses and keeps the shorter form.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wire as w
from ..functions.varint import varint_hex


def _bytes(value: Column, is_string: bool) -> Column:
    return value.cast("binary") if is_string else value


def looks_incompressible(data: Column) -> Column:
    """The entropy gate on binary: a wide range in the first 8 bytes, or 28 distinct ones in the first 32."""
    pairs = F.regexp_extract_all(F.hex(F.substring(data, 1, 32)), F.lit(".."), F.lit(0))
    first = F.slice(pairs, 1, 8)  # two upper-case hex digits order like their numbers
    number = lambda x: F.conv(x, 16, 10).cast("int")
    wide = number(F.array_max(first)) - number(F.array_min(first)) > 200
    return (F.octet_length(data) >= 32) & (wide | (F.size(F.array_distinct(pairs)) >= 28))


def compressible(data: Column) -> Column:
    """Whether compression is tried at all."""
    return (F.octet_length(data) >= w.LEAST_COMPRESSED) & ~looks_incompressible(data)


def raw_hex(data: Column) -> Column:
    return F.concat(varint_hex(F.octet_length(data).cast("long") * 2), F.hex(data))


@F.pandas_udf(T.StringType())
def _shorter(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else w.flagged(bytes(x)).hex().upper())


def flagged_hex(value: Column, is_string: bool = False) -> Column:
    """Wire form (hex) of a string or binary column.

    The UDF is handed null for every value that compression is not tried on: a UDF inside CASE runs for all rows.
    """
    data = _bytes(value, is_string)
    tried = F.when(compressible(data), data)
    return F.coalesce(_shorter(tried), raw_hex(data))


def flagged(value: Column, is_string: bool = False) -> Column:
    return F.unhex(flagged_hex(value, is_string))


def flagged_header_len(payload_len: Column) -> Column:
    """Bytes of the header of a payload."""
    from ..functions.varint import varint_len

    return varint_len(payload_len.cast("long") * 2)


@F.pandas_udf(T.BinaryType())
def _read(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else w.BYTES.loads(bytes(x)))


@F.pandas_udf(T.StringType())
def _read_text(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else w.STR.loads(bytes(x)))


def read_flagged(wire: Column, is_string: bool = False) -> Column:
    """Inverse of flagged; invalid UTF-8 in a string, a broken frame or a missing size is an error."""
    return (_read_text if is_string else _read)(wire)


def is_compressed(wire: Column) -> Column:
    """The header's flag, without decoding the payload."""
    from ..functions.varint import decode_varint

    return decode_varint(wire)["value"].bitwiseAND(F.lit(1).cast("long")) == 1
