"""Token ids of whole texts by the tokenizers library, with a memo of the pieces between spaces.

The pre-tokenizers of the supported vocabularies never match across the border between a character that is no white space
and a single space or line feed before another one, so a text's ids are the ids of its pieces in a row: words with the
space before them, and line feeds.  Pieces recur; the library encodes each once and a hash table keeps the ids.  Pieces
are found, hashed (128 bits) and looked up for a whole slice of texts at a time.  A text goes to the library whole if
white space stands beside white space in it, if a piece is longer than LONGEST, or if it may hold an added token's string.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a memo keeps (about 60 bytes each); beyond it those not met lately go.  Bounds memory, never changes an id.
MEMO = 1_200_000
#: Bytes of a piece that the memo may keep.
LONGEST = 64
#: New pieces to a text that the library is given.
GROUP = 64
#: Bytes of text cut at a time.
SLICE = 4_000_000
_U = np.uint64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Table:
    """Open-addressing hash table of 128-bit keys -> (start, size) of ids in a pool; size -1: not to be used by itself."""

    def __init__(self, limit: int):
        self.limit, self.emptied = limit, 0
        self._clear(1 << 12)

    def _clear(self, slots: int) -> None:
        self.bits, self.count, self.used = slots.bit_length() - 1, 0, 0
        self.slot_key, self.slot_entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        room = slots * 5 // 8
        self.a, self.b, self.hit = np.zeros(room, np.uint64), np.zeros(room, np.uint64), np.zeros(room, bool)
        self.start, self.size = np.zeros(room, np.int64), np.zeros(room, np.int32)
        if not hasattr(self, "pool"):
            self.pool = np.zeros(1 << 14, np.uint32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where there is none. a is never 0."""
        out = np.full(len(a), -1, dtype=np.int64)
        place = (a >> _U(64 - self.bits)).astype(np.int64)
        here = self.slot_key[place]
        same = here == a
        entry = self.slot_entry[place[same]]
        out[same] = np.where(self.b[entry] == b[same], entry, -1)
        rest = np.flatnonzero(~same & (here != 0))
        last = len(self.slot_key) - 1
        while len(rest):  # linear probing for the few that are left
            place[rest] = (place[rest] + 1) & last
            here = self.slot_key[place[rest]]
            same = here == a[rest]
            hit = rest[same]
            entry = self.slot_entry[place[hit]]
            out[hit] = np.where(self.b[entry] == b[hit], entry, -1)
            rest = rest[~same & (here != 0)]
        return out

    def _place(self, first: int, end: int) -> None:
        """Give slots to the entries first to end, whose keys a are distinct and not in the table."""
        entry = np.arange(first, end, dtype=np.int32)
        key = self.a[first:end]
        place = (key >> _U(64 - self.bits)).astype(np.int64)
        last = len(self.slot_key) - 1
        while len(entry):
            free = self.slot_key[place] == 0
            self.slot_entry[place[free]] = entry[free]
            won = free & (self.slot_entry[place] == entry)
            self.slot_key[place[won]] = key[won]
            entry, key, place = entry[~won], key[~won], (place[~won] + 1) & last

    def _append(self, a, b, start, size, hit) -> None:
        first, end = self.count, self.count + len(a)
        if end > len(self.a):
            old = [x[:first] for x in (self.a, self.b, self.start, self.size, self.hit)]
            slots = len(self.slot_key)
            while slots * 5 // 8 < end:
                slots *= 2
            used = self.used
            self._clear(slots)
            self.used = used
            for x, was in zip((self.a, self.b, self.start, self.size, self.hit), old, strict=True):
                x[:first] = was
            self._place(0, first)
        for x, new in zip((self.a, self.b, self.start, self.size, self.hit), (a, b, start, size, hit), strict=True):
            x[first:end] = new
        self.count = end
        self._place(first, end)

    def add(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """New distinct keys; ids holds the ids of those of size >= 0 in a row."""
        if self.count + len(a) > self.limit:
            self._forget(len(a))
        full = np.maximum(size, 0)
        end = self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(end, 3 * len(self.pool) // 2) - self.used, np.uint32)))
        self.pool[self.used : end] = ids
        start = self.used + np.cumsum(full) - full
        self.used = end
        self._append(a, b, start, size, np.ones(len(a), bool))

    def _forget(self, more: int) -> None:
        """Keep what was met since the last time, or nothing if that is most of the memo."""
        self.emptied += 1
        keep = np.flatnonzero(self.hit[: self.count])
        if len(keep) + more > self.limit * 3 // 4:
            keep = keep[:0]
        a, b, start, size = self.a[keep], self.b[keep], self.start[keep], self.size[keep]
        full = np.maximum(size, 0)
        ids = self.pool[_ranges(start, full)]
        self._clear(len(self.slot_key))
        self.pool[: len(ids)] = ids
        self.used = len(ids)
        self._append(a, b, np.cumsum(full) - full, size, np.zeros(len(a), bool))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start to start + size - 1 of every pair, in a row."""
    ends = np.cumsum(size, dtype=np.int64)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(start - (ends - size), size)
    return out


class MemoTokenizer:
    """ids of texts, equal to tokenizers' encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = sorted({t.content[:2].encode().lower() for t in self.library.get_added_tokens_decoder().values() if t.content})
        self.separator = self._separator()
        self.table = Table(memo)

    def _direct(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _separator(self) -> tuple[str, int] | None:
        """Text that never merges with the pieces around it, and the one id that it becomes."""
        for text in ("\n", "\n\x01\n"):
            alone, inside = self.library.encode(text, add_special_tokens=False).ids, self.library.encode(f"a{text} a", add_special_tokens=False).ids
            if len(alone) == 1 and inside.count(alone[0]) == 1:
                return text, alone[0]
        return None

    @staticmethod
    def _alone(piece: str) -> bool:
        """Whether the piece's ids don't depend on what stands beside it."""
        body = piece[1:] if piece[:1] == " " else piece
        return piece == "\n" or (body != "" and not body[0].isspace() and not body[-1].isspace())

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces in a row, number of ids of each or -1: not to be used by itself)."""
        found: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        groups, members = [], []
        for low in range(0, len(pieces), GROUP):
            some = pieces[low : low + GROUP]
            lines = b"\n".join(some).decode()
            bodies = lines.replace("\n ", "\n").removeprefix(" ")
            words = bodies.split()
            # white space nowhere but in single line feeds between the pieces
            if self.separator and len(words) == len(some) and sum(map(len, words)) + len(some) - 1 == len(bodies) and "\x01" not in lines:
                groups.append(lines if self.separator[0] == "\n" else lines.replace("\n", self.separator[0]))
                members.append(low)
                continue
            for k, piece in enumerate(some):
                text = piece.decode()
                if self._alone(text):
                    found[low + k] = self._direct([text])[0]
        for low, ids in zip(members, self._direct(groups), strict=True):
            n = min(GROUP, len(pieces) - low)
            ends = np.flatnonzero(ids == self.separator[1])
            if len(ends) == n - 1:
                found[low : low + n] = np.split(ids, ends) if n == 1 else [ids[: ends[0]], *[ids[a + 1 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], ids[ends[-1] + 1 :]]
            else:
                found[low : low + n] = self._direct([p.decode() for p in pieces[low : low + n]])
        size = np.array([-1 if x is None else len(x) for x in found], dtype=np.int32)
        return np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.uint32)]), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null counts as empty."""
        ids, sizes = [], []
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):  # slices of bounded size, or of one long text
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
            some, size = self._slice(texts.slice(first, last - first))
            ids.append(some)
            sizes.append(size)
            first = last
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def _keys(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of pieces of up to LONGEST bytes, eight bytes at a time."""
        eight = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
        a = size.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
        b = size.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
        for done in range(0, LONGEST, 8):
            some = slice(None) if done == 0 else np.flatnonzero(size > done)
            left = size[some] - done
            if not len(left):
                break
            x = eight[start[some] + done] & _MASKS[np.minimum(left, 8)]
            u = (a[some] ^ x) * _U(0xD6E8FEB86659FD93)
            a[some] = u ^ (u >> _U(32))
            v = (b[some] + x) * _U(0xFF51AFD7ED558CCD)
            b[some] = v ^ (v >> _U(29))
        a *= _U(0x9E3779B97F4A7C15)
        return np.maximum(a, _U(1)), b

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        total = len(data)
        whole = np.zeros(n, bool)  # texts that the library is given as they are
        full = offsets[1:] > offsets[:-1]
        of = lambda places: np.searchsorted(offsets, places, side="right") - 1
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        feed = data == 10
        mark = (data == 32) | feed
        # a line feed at the start, or before a space or line feed of the same text
        beside = feed[:-1] & mark[1:]
        if beside.any():
            at = np.flatnonzero(beside)
            doc = of(at)
            whole[doc[offsets[doc + 1] > at + 1]] = True
        heads = offsets[:-1][full]
        whole[np.flatnonzero(full)[feed[heads]]] = True
        for two in self.added:
            low = data | np.uint8(32)
            pair = (data == two[0]) | ((low == two[0]) if chr(two[0]).isalpha() else False)
            if len(two) > 1:
                pair = pair[:-1] & ((data[1:] == two[1]) | ((low[1:] == two[1]) if chr(two[1]).isalpha() else False))
            if pair.any():
                whole[np.unique(of(np.flatnonzero(pair)))] = True
        mark[1:] |= feed[:-1]
        mark[heads] = True
        start = np.flatnonzero(mark)
        size = np.diff(start, append=total)
        bounds = np.searchsorted(start, offsets)  # pieces before each text
        long = size > LONGEST
        if long.any():
            whole[np.unique(of(start[long]))] = True
        if whole.any():  # their pieces take no part
            keep = np.repeat(~whole, np.diff(bounds))
            start, size = start[keep], size[keep]
            bounds = np.concatenate(([0], np.cumsum(np.where(whole, 0, np.diff(bounds)))))
        a, b = self._keys(padded, start, size)
        table = self.table
        entry = table.find(a, b)
        table.hit[entry[entry >= 0]] = True
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first = np.unique(a[new], return_index=True)
            first = new[first]
            view = data.tobytes()
            ids, count = self._learn([view[s:e] for s, e in zip(start[first].tolist(), (start[first] + size[first]).tolist(), strict=True)])
            if len(first) > table.limit // 2:  # more new pieces in one slice than the memo may take: a memo of their own
                known, old = np.unique(entry[entry >= 0]), table
                table = Table(1 << 62)
                table.add(old.a[known], old.b[known], old.size[known], old.pool[_ranges(old.start[known], np.maximum(old.size[known], 0))])
            emptied = table.emptied
            table.add(a[first], b[first], count, ids)
            if table is self.table and table.emptied == emptied:
                entry[new] = table.find(a[new], b[new])
            else:
                entry = table.find(a, b)
                if table is self.table and (entry < 0).any():
                    return self._slice(texts)  # pieces of this slice were forgotten
        count = np.where(entry >= 0, table.size[entry], np.int32(-1)).astype(np.int64)
        if (count < 0).any():  # a piece not to be used by itself
            whole[np.unique(np.searchsorted(bounds, np.flatnonzero(count < 0), side="right") - 1)] = True
            keep = np.repeat(~whole, np.diff(bounds))
            entry, count = entry[keep], count[keep]
            bounds = np.concatenate(([0], np.cumsum(np.where(whole, 0, np.diff(bounds)))))
        flat = table.pool[_ranges(table.start[entry], count)]
        last = np.concatenate(([0], np.cumsum(count)))[bounds]
        sizes = np.diff(last)
        if not whole.any():
            return flat, sizes
        rows = np.split(flat, last[1:-1])
        at = np.flatnonzero(whole)
        for i, row in zip(at.tolist(), self._direct(texts.take(pa.array(at)).to_pylist()), strict=True):
            rows[i] = row
        return np.concatenate(rows).astype(np.uint32), np.array([len(r) for r in rows], dtype=np.int64)


_shared: dict[tuple[str, int], MemoTokenizer] = {}


def shared_tokenizer(path: str, memo: int = MEMO) -> MemoTokenizer:
    """The tokenizer of this Python worker, kept with its memo for the worker's later tasks."""
    if (path, memo) not in _shared:
        _shared.clear()
        _shared[path, memo] = MemoTokenizer(path, memo)
    return _shared[path, memo]


def release() -> None:
    """Forget the worker's tokenizer and memo, and give their memory back."""
    _shared.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
