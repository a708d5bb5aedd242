"""Deltas between successive versions of a blob, in plain Python and numpy.

Modes on the wire: 0 the whole blob; 1 patches (gap, length, bytes); 2 the exclusive-or with the old blob, compressed.
"""

from __future__ import annotations

import numpy as np

from .wire import InvalidData, Reader, Versions, compress, decompress, read_varint, varint

#: Differing runs closer than this become one patch.
MERGE_GAP = 8


def differing(old: bytes, new: bytes) -> np.ndarray:
    """Places of new that differ from old or lie beyond it."""
    both = min(len(old), len(new))
    differ = np.ones(len(new), dtype=bool)
    differ[:both] = np.frombuffer(old, np.uint8, both) != np.frombuffer(new, np.uint8, both)
    return np.flatnonzero(differ)


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of places, close ones made one."""
    far = np.flatnonzero(np.diff(at) > MERGE_GAP)
    return at[np.concatenate(([0], far + 1))[: len(at)]], at[np.concatenate((far, [len(at) - 1]))[: len(at)]] + 1


def patches(old: bytes, new: bytes) -> list[tuple[int, bytes]] | None:
    """(offset, bytes) of each patch, or None if they hold more than half of the new blob."""
    start, end = runs(differing(old, new))
    if int((end - start).sum()) > len(new) // 2:
        return None
    return [(int(a), new[a:b]) for a, b in zip(start, end, strict=True)]


def patch_form(old: bytes, new: bytes) -> bytes | None:
    found = patches(old, new)
    if found is None:
        return None
    out, at = bytearray(varint(1) + varint(len(new)) + varint(len(found))), 0
    for offset, data in found:
        out += varint(offset - at) + varint(len(data)) + data
        at = offset + len(data)
    return bytes(out)


def exclusive_or(old: bytes, new: bytes) -> bytes:
    """Of the length of the longer, the shorter one filled up with zeros."""
    out = np.zeros(max(len(old), len(new)), dtype=np.uint8)
    out[: len(old)] = np.frombuffer(old, np.uint8)
    out[: len(new)] ^= np.frombuffer(new, np.uint8)
    return out.tobytes()


def xor_form(old: bytes, new: bytes) -> bytes | None:
    packed = compress(exclusive_or(old, new))
    return varint(2) + varint(len(new)) + varint(len(packed)) + packed if len(packed) < len(new) else None


def whole_form(new: bytes) -> bytes:
    return varint(0) + varint(len(new)) + new


def delta(old: bytes | None, new: bytes, strict_min: bool = False) -> bytes:
    """The wire form of new after old (None: none known).  strict_min also weighs the whole blob, for a smaller result."""
    if old is None:
        return whole_form(new)
    by_patch = patch_form(old, new)
    by_xor = None if by_patch is not None and len(by_patch) * 10 <= len(new) else xor_form(old, new)
    forms = [f for f in (by_patch, by_xor) if f is not None]
    if strict_min or not forms:
        forms.append(whole_form(new))
    return min(forms, key=len)


def apply(old: bytes | None, reader: Reader) -> bytes:
    mode = read_varint(reader)
    size = read_varint(reader)
    if mode == 0:
        return reader.take(size)
    if mode not in (1, 2):
        raise InvalidData(f"mode {mode}")
    if old is None:
        raise InvalidData("no earlier version of the key")
    if mode == 2:
        mask = decompress(reader.take(read_varint(reader)))
        if len(mask) != max(len(old), size):
            raise InvalidData("the mask has another length than the blobs")
        return exclusive_or(old, mask)[:size]
    out = bytearray()
    for _ in range(read_varint(reader)):
        gap, length = read_varint(reader), read_varint(reader)
        if len(out) + gap > len(old) or len(out) + gap + length > size:
            raise InvalidData("a patch lies outside the blob")
        out += old[len(out) : len(out) + gap]
        out += reader.take(length)
    out += old[len(out) : size]
    if len(out) != size:
        raise InvalidData("the patched blob has another length")
    return bytes(out)


def encode_version(versions: Versions, new: bytes) -> bytes:
    out = delta(versions.blobs.get(versions.key), new) if versions.key is not None else whole_form(new)
    if versions.key is not None:
        versions.blobs[versions.key] = new
    return out


def decode_version(versions: Versions, reader: Reader) -> bytes:
    new = apply(versions.blobs.get(versions.key) if versions.key is not None else None, reader)
    if versions.key is not None:
        versions.blobs[versions.key] = new
    return new
