"""Column functions and the scalar codec that UDFs and tests share."""

from .varint import (
    bool_wire, decode_bool, decode_varint, int_wire, le_hex, nonzero, pack_int, uint_wire, unpack_int, varint_hex, varint_len, zigzag, zigzag_inverse,
)

__all__ = [
    "bool_wire", "decode_bool", "decode_varint", "int_wire", "le_hex", "nonzero", "pack_int", "uint_wire", "unpack_int", "varint_hex", "varint_len", "zigzag", "zigzag_inverse",
]
