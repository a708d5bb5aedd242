"""Unsigned integers of 128 and 256 bits as columns: binary of full width, least byte first.

Spark has no type for them, so sums, differences and shifts go through Arrow UDFs over Python integers, a batch at a time;
what the width can't hold is InvalidData for sums and differences, and shifted out by shifts.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .varint import le_hex
from .wire import InvalidData


def _of(data: bytes) -> int:
    return int.from_bytes(data, "little")


def _apply(f: Callable, bits: int, *columns: Column) -> Column:
    def one(*args):
        if any(x is None for x in args):
            return None
        value = f(*args)
        if not 0 <= value < 1 << bits:
            raise InvalidData(f"{value} does not fit {bits} bits")
        return value.to_bytes(bits // 8, "little")

    @F.arrow_udf(T.BinaryType())
    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array(list(map(one, *[a.to_pylist() for a in arrays])), pa.binary())

    return run(*columns)


def from_long(value: Column, bits: int = 256) -> Column:
    """A long's bit pattern, widened with zeros; no Python."""
    return F.unhex(F.concat(le_hex(value, 8), F.lit("00" * (bits // 8 - 8))))


def add(a: Column, b: Column, bits: int = 256) -> Column:
    return _apply(lambda x, y: _of(x) + _of(y), bits, a, b)


def subtract(a: Column, b: Column, bits: int = 256) -> Column:
    return _apply(lambda x, y: _of(x) - _of(y), bits, a, b)


def shift_left(a: Column, n: Column, bits: int = 256) -> Column:
    return _apply(lambda x, k: (_of(x) << int(k)) & ((1 << bits) - 1), bits, a, n)


def shift_right(a: Column, n: Column, bits: int = 256) -> Column:
    return _apply(lambda x, k: _of(x) >> int(k), bits, a, n)


def number_hex(a: Column) -> Column:
    """Hexadecimal digits of the number, without leading zeros; no Python."""
    digits = F.regexp_extract_all(F.hex(a), F.lit(".."), F.lit(0))
    return F.regexp_replace(F.array_join(F.reverse(digits), ""), "^0+(?=.)", "")
