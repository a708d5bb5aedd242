"""Integers on the wire as built-in Column expressions (whole-stage codegen, no Python on the executors).

A value up to 127 is one byte; else a byte 0x80 | n and the n low-order bytes, least first, n as small as can be.
Unsigned 64-bit values are held as the bit pattern of a long.  Hexadecimal text is upper case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width and sign of the integer types.
INTEGERS = {f"{sign}{bits}": (bits, sign == "i") for sign in "ui" for bits in (8, 16, 32, 64)}


def le_hex(value: Column, width: int) -> Column:
    """The width low-order bytes of a long, least first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(width)])


def varint_hex(value: Column) -> Column:
    """varint of an unsigned 64-bit value."""
    v = value.cast("long")
    size = F.ceil(F.length(F.hex(v)) / 2).cast("int")
    long_form = F.concat(F.hex(F.lit(128) + size), F.substring(le_hex(v, 8), F.lit(1), size * 2))
    return F.when(v.between(0, 127), F.lpad(F.hex(v), 2, "0")).when(v.isNotNull(), long_form)


def varint_len(value: Column) -> Column:
    """Bytes of the varint."""
    v = value.cast("long")
    return F.when(v.between(0, 127), F.lit(1)).when(v.isNotNull(), F.lit(1) + F.ceil(F.length(F.hex(v)) / 2).cast("int"))


def zigzag(value: Column, bits: int = 64) -> Column:
    """0, -1, 1, -2, ... -> 0, 1, 2, 3, ...; the result of width bits as an unsigned pattern."""
    v = value.cast("long")
    wide = F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))
    return wide if bits == 64 else wide.bitwiseAND(F.lit((1 << bits) - 1))


def zigzag_inverse(value: Column) -> Column:
    v = value.cast("long")
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("long")))


def uint_wire(value: Column, bits: int = 64) -> Column:
    """Wire form (hex) of an unsigned integer; 8 bits are one raw byte.

    A negative value of a signed type of as many bits counts as its bit pattern; what doesn't fit is InvalidData.
    """
    if bits == 64:
        return varint_hex(value)
    v = value.cast("long")
    fitting = F.when(v.between(-(1 << (bits - 1)), (1 << bits) - 1), v.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))).when(v.isNotNull(), F.raise_error(F.lit(f"InvalidData: a value does not fit {bits} bits")))
    return le_hex(fitting, 1) if bits == 8 else varint_hex(fitting)


def int_wire(value: Column, bits: int = 64) -> Column:
    """Wire form (hex) of a signed integer; 8 bits are one raw byte in two's complement, others zigzag varints."""
    return le_hex(value, 1) if bits == 8 else varint_hex(zigzag(value, bits))


def bool_wire(value: Column) -> Column:
    return F.when(value, "01").when(~value, "00")


def nonzero(value: Column) -> Column:
    """The value; zero is an error of class InvalidData."""
    return F.when(value == 0, F.raise_error(F.lit("InvalidData: zero where a value must not be zero"))).otherwise(value)


def pack_int(value: Column, bits: int = 64) -> Column:
    """Fixed width, least byte first (hex)."""
    return le_hex(value, bits // 8)


def unpack_int(packed: Column, bits: int = 64, signed: bool = True) -> Column:
    """Inverse of pack_int on binary; 64 bits always give the signed pattern."""
    digits = F.hex(packed)
    width = bits // 8
    value = F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]), 16, -10).cast("decimal(20,0)").cast("long")
    if signed and bits < 64:
        value = F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)
    return F.when(F.octet_length(packed) < width, F.raise_error(F.lit("ReaderOutOfData: packed value cut short"))).otherwise(value)


def decode_varint(wire: Column, offset: Column | int = 0, bits: int = 64, canonical: bool = False) -> Column:
    """struct(value, next_offset, error_class) of the varint at a byte offset of binary.

    Strict: a length of 0 or beyond the type's, a missing byte, and with canonical a longer form than needed, give a null
    value and the error's class (InvalidData, ReaderOutOfData).
    """
    at = (offset if isinstance(offset, Column) else F.lit(offset)).cast("int")
    digits = F.hex(wire)
    head = F.conv(F.substring(digits, at * 2 + 1, F.lit(2)), 16, 10).cast("int")
    size = F.when(head > 127, head - 128).otherwise(0)
    body = F.substring(digits, at * 2 + 3, size * 2)
    rest = F.rpad(body, 16, "0")
    value = F.conv(F.concat(*[F.substring(rest, 2 * i + 1, 2) for i in reversed(range(8))]), 16, -10).cast("decimal(20,0)").cast("long")
    short = (F.octet_length(wire) <= at) | (F.octet_length(wire) < at + 1 + size)
    wrong = (head > 127) & ((size < 1) | (size > bits // 8))
    if canonical:
        wrong = wrong | (~short & (head > 127) & ((F.substring(body, -2, 2) == "00") | value.between(0, 127)))
    error = F.when(F.octet_length(wire) <= at, "ReaderOutOfData").when(wrong, "InvalidData").when(short, "ReaderOutOfData")
    return F.struct(
        F.when(error.isNull(), F.when(head < 128, head.cast("long")).otherwise(value)).alias("value"),
        F.when(error.isNull(), at + 1 + size).alias("next_offset"), error.alias("error_class"),
    )


def decode_bool(wire: Column, offset: Column | int = 0) -> Column:
    """struct(value, next_offset, error_class); a byte above 1 is InvalidData."""
    at = (offset if isinstance(offset, Column) else F.lit(offset)).cast("int")
    byte = F.substring(F.hex(wire), at * 2 + 1, F.lit(2))
    error = F.when(F.octet_length(wire) <= at, "ReaderOutOfData").when(~byte.isin("00", "01"), "InvalidData")
    return F.struct(F.when(error.isNull(), byte == "01").alias("value"), F.when(error.isNull(), at + 1).alias("next_offset"), error.alias("error_class"))
