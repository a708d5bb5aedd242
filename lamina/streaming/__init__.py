"""Structured Streaming forms of the stateful codecs."""

from .stateful import decode_deltas, decode_dictionary, encode_deltas, encode_dictionary

__all__ = ["decode_deltas", "decode_dictionary", "encode_deltas", "encode_dictionary"]
