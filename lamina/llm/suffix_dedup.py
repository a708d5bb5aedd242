"""Suffix-array dedup: every byte that lies in a string of `length` bytes which also starts anywhere else is removed.

0. Of equal texts one takes part; the others, and it, are removed whole.
1. Texts are cut where the hash of 16 bytes says so: equal strings are cut alike inside.  Pieces (phrases) get names;
   phrases whose name stands once cannot lie inside a repeated string.  The string of names is made of the runs of
   repeated phrases that are long enough to hold a window.
2. The distributed difference-cover algorithm (suffix_array.py) sorts the suffixes of the string of names.
3. Adjacent suffixes are compared by the fingerprint of their prefix, as far as windows that start in the first phrase
   can reach.  Equal neighbours: every window that starts in the phrase is repeated.  The first suffix of a run of equal
   ones stands for all.
4. What is left are windows at the edges of repeats: they start in a phrase of which not all windows are known, though
   all whole phrases inside them are repeated.  They are grouped in blocks of 64 starts aligned to the cut behind them.
   A block whose windows' common bytes stand once holds no repeat; one whose windows' joint bytes stand twice is repeated
   whole; the others (and one block for each content they have to be held against) are cut into blocks of 8 starts, and
   what those leave open into single windows.  Windows without a cut inside are counted by hash from the start.
Counts are partial aggregates and names are paired in the map tasks first, so a passage that a third of the documents
share is no group of rows in any task.  Strings count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, collect_garbage, drop_staged, partitions, read_table, stage, stage_by
from .suffix_array import suffix_ranks

LENGTH = 400
#: Bytes that decide on a cut, and the mean distance of cuts.
GRAM, EVERY = 16, 64
#: Starts to a block of edge windows, and to the blocks that open ones are cut into.
STARTS, FEWER = 64, 8
_U = np.uint64
_MULT, _INV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: A document is a number of 39 bits, a phrase one of 24.
_PHRASES, _DOCS = 24, 39


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the multiplier and of its inverse, grown to the longest text so far."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            one = np.ones(1, np.uint64)
            self.up, self.down = (np.concatenate((one, np.cumprod(np.full(n - 1, x, np.uint64), dtype=np.uint64))) for x in (_MULT, _INV))
        return self.up, self.down


class Hashed:
    """Prefix sums of a text, by which any substring's hash is a difference."""

    def __init__(self, data: bytes, powers: _Powers):
        self.n = len(data)
        up, self.down = powers.to(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of the substrings at start, of size bytes."""
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every substring of size bytes."""
        k = max(0, self.n - size + 1)
        return _mix((self.sums[size : size + k] - self.sums[:k]) * self.down[:k])

    def cuts(self) -> np.ndarray:
        """0, the places where GRAM bytes ask for a cut, and the end."""
        k = max(0, self.n - GRAM + 1)
        raw = (self.sums[GRAM : GRAM + k] - self.sums[:k]) * self.down[:k] * _U(0xD6E8FEB86659FD93)
        at = np.flatnonzero(raw < _U((1 << 64) // EVERY))
        return np.concatenate(([0], at[at > 0], [self.n])).astype(np.int64)

    def names(self, cuts: np.ndarray) -> np.ndarray:
        """A name per phrase; the first and the last are marked, as what cuts them is no content."""
        size = np.diff(cuts)
        names = self.of(cuts[:-1], size) * _U(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64)
        names[0] += _U(0x1234567)
        names[-1] += _U(0x7654321)
        return _mix(names)


_read_schema = "did long, id long, text binary, cuts array<int>, names array<long>, n long, digest binary"


def _cut(length: int, parts: int):
    """id, text -> numbered documents with their cuts and phrase names; parts: partitions, among which numbers are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, powers = TaskContext.get().partitionId(), 0, _Powers()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                cuts, names, dids, sizes, digests = [], [], [], [], []
                for text in some.column(1):
                    data = text.as_py() or b""
                    if part >= parts or n * parts + part >= 1 << _DOCS:
                        raise ValueError("documents that can't be numbered: a partition too many, or uneven ones")
                    dids.append(n * parts + part)
                    n += 1
                    sizes.append(len(data))
                    digests.append(hashlib.blake2b(data, digest_size=16).digest() if len(data) >= length else None)
                    if len(data) < length:  # no window: takes no part
                        cuts.append(np.zeros(0, np.int32))
                        names.append(np.zeros(0, np.int64))
                        continue
                    hashed = Hashed(data, powers)
                    c = hashed.cuts()
                    if len(c) > 1 << _PHRASES:
                        raise ValueError("a text with too many phrases")
                    cuts.append(c.astype(np.int32))
                    names.append(hashed.names(c).view(np.int64))
                lists = lambda rows, t: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)), pa.array(np.concatenate(rows), t))
                yield pa.RecordBatch.from_arrays([pa.array(dids, pa.int64()), some.column(0), some.column(1), lists(cuts, pa.int32()), lists(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], names=["did", "id", "text", "cuts", "names", "n", "digest"])

    return run


def _post(buckets: int):
    """names -> kind 0: (i, name) of phrases repeated in the task; kind 1: packed (name, i, repeated) of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush():
            nonlocal held, total
            if not held:
                return
            name, i = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held, total = [], 0
            order = np.argsort(name, kind="stable")
            name, i = name[order], i[order]
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            size = np.diff(np.concatenate((first, [len(name)])))
            many = np.repeat(size > 1, size)
            if many.any():
                n = int(many.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(i[many]), pa.array(name[many]), pa.array((np.arange(n) % buckets).astype(np.int32)), pa.nulls(n, pa.binary())], names=["kind", "i", "s", "bucket", "packed"])
            name, i, again = name[first], i[first], size > 1
            which = name.view(np.uint64) % _U(buckets)
            order = np.argsort(which, kind="stable")
            name, i, again = name[order], i[order], again[order]
            cut = np.searchsorted(which[order], np.arange(buckets + 1, dtype=np.uint64))
            for some in np.array_split(np.flatnonzero(np.diff(cut)), max(1, buckets // 64)):
                if len(some):
                    packed = [b"".join((name[cut[k] : cut[k + 1]].tobytes(), i[cut[k] : cut[k + 1]].tobytes(), again[cut[k] : cut[k + 1]].tobytes())) for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int32)), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], names=["kind", "i", "s", "bucket", "packed"])

        for batch in batches:
            did, names = batch.column(0).to_numpy(), batch.column(1)
            size = names.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            j = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            held.append((names.flatten().to_numpy(), (np.repeat(did, size) << _PHRASES) + j))
            total += len(j)
            if total > 1_000_000:
                yield from flush()
        yield from flush()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> (i, s) of the phrases whose name stands twice or more; one bucket is held at a time."""
    bucket, held = None, []

    def close():
        if not held:
            return
        parts = [(len(data) // 17, data) for data in held]
        name, i = (np.concatenate([np.frombuffer(data, np.int64, n, at * n) for n, data in parts]) for at in (0, 8))
        again = np.concatenate([np.frombuffer(data, bool, n, 16 * n) for n, data in parts])
        held.clear()
        order = np.argsort(name, kind="stable")
        name, i, again = name[order], i[order], again[order]
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        size = np.diff(np.concatenate((first, [len(name)])))
        new = np.repeat(size > 1, size) & ~again
        yield pa.RecordBatch.from_arrays([pa.array(i[new]), pa.array(name[new])], names=["i", "s"])

    for batch in batches:
        packed = np.array(batch.column(0).to_numpy() == 1)
        for k in np.flatnonzero(packed).tolist():
            here = batch.column(3)[k].as_py()
            if here != bucket:
                yield from close()
                bucket = here
            held.append(batch.column(4)[k].as_py())
        if not packed.all():
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(~packed)).columns[1:3], names=["i", "s"])
    yield from close()


def _reach(cuts: np.ndarray, length: int) -> np.ndarray:
    """For each phrase j the first cut at or behind cuts[j + 1] + length, or the end."""
    return np.minimum(np.searchsorted(cuts, cuts[1:] + length), len(cuts) - 1)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of at most so many rows, which bounds what a worker holds at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _string(length: int):
    """(did, cuts, names, j of repeated phrases) -> (i, s, print): the string of names, a unique symbol (its own place)
    behind every run; print is the fingerprint of the suffix's prefix, null if that holds a phrase that stands once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for k in range(batch.num_rows):
                did, cuts, names = batch.column(0)[k].as_py(), batch.column(1)[k].values.to_numpy().astype(np.int64), batch.column(2)[k].values.to_numpy().view(np.uint64)
                j = np.sort(batch.column(3)[k].values.to_numpy()).astype(np.int64)
                first = np.concatenate(([True], np.diff(j) > 1))
                last = np.concatenate((first[1:], [True]))
                run_of = np.cumsum(first) - 1
                long = cuts[j[last] + 1] - cuts[j[first]] >= length
                j, ends = j[long[run_of]], j[last][long] + 1
                if not len(j):
                    continue
                have = np.zeros(len(names) + 1, dtype=np.int64)
                have[j + 1] = 1
                have = np.cumsum(have)
                end = _reach(cuts, length)[j]
                whole = have[end] - have[j] == end - j
                # a fingerprint by prefix sums over the names, free of the place
                weight = np.cumprod(np.full(len(names) + 1, _MULT, np.uint64), dtype=np.uint64)
                back = np.cumprod(np.full(len(names) + 1, _INV, np.uint64), dtype=np.uint64)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * weight[:-1], dtype=np.uint64)))
                mark = _mix((sums[end] - sums[j]) * back[j] + (end - j).astype(np.uint64)).view(np.int64)
                at, stop = (did << _PHRASES) + j, (did << _PHRASES) + ends
                out.append((at, (names[j] >> _U(2)).view(np.int64), mark, ~whole))
                out.append((stop, -stop - 1, np.zeros(len(stop), np.int64), np.ones(len(stop), bool)))
            if out:
                i, s, mark, no = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s), pa.array(mark, mask=no)], names=["i", "s", "print"])

    return run


def _compare(prefixes: DataFrame) -> DataFrame:
    """(i, state) of suffixes (r, i, print) with an equal neighbour: 1 the one before has the prefix, 2 only the one behind
    has it, so this is the first of a run of equal ones."""
    from pyspark.sql import Window

    size = 1 << 15
    halo = F.explode(F.array(F.floor(F.col("r") / size), F.floor((F.col("r") - 1) / size), F.floor((F.col("r") + 1) / size)))
    rows = prefixes.withColumn("_home", F.floor(F.col("r") / size)).withColumn("_b", halo).dropDuplicates(["_b", "r"])
    window = Window.partitionBy("_b").orderBy("r")
    same = lambda k: F.coalesce((F.lag("print", k).over(window) == F.col("print")) & (F.lag("r", k).over(window) == F.col("r") - k), F.lit(False))
    state = F.when(same(1), 1).when(same(-1), 2).otherwise(0)
    return rows.withColumn("state", state.cast("int")).filter("_b = _home and state > 0").select("i", "state")


def _edges(cuts: np.ndarray, state: np.ndarray, length: int) -> np.ndarray:
    """Blocks (j, block) whose windows may be repeated though not all are known, and those that stand for known ones.

    state per phrase: -1 stands once, 0 repeated, 1 known, 2 known and first.
    """
    n, m = cuts[-1], len(cuts) - 1
    cut = cuts[1:m]  # cuts that content asks for; cut[j] is behind phrase j
    if not len(cut):
        return np.zeros((0, 2), dtype=np.int64)
    j = np.flatnonzero(state[: m - 1] != 1)
    per = -(-np.minimum(np.diff(cuts)[j], length - GRAM) // STARTS)
    j, b = np.repeat(j, per), np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    first = cut[j] - np.minimum(STARTS * (b + 1), np.diff(cuts)[j])  # earliest start
    end = cut[j] - STARTS * (b + 1) + length  # of the bytes that all windows of the block share
    have = np.concatenate(([0], np.cumsum(state >= 0)))
    inside = np.searchsorted(cuts[:m], np.maximum(first + length - GRAM, 0), side="right") - 1  # last cut inside the earliest window
    inside = np.maximum(inside, j + 1)
    ok = (end <= n) & (have[inside] - have[j + 1] == inside - j - 1)
    return np.stack([j[ok], b[ok]], axis=1)


def _spans(cuts: np.ndarray, j: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of blocks, and where the last would be but for the text's end; last < first: no window."""
    size = np.diff(cuts)[j]
    first, base = cuts[1:][j] - np.minimum(np.minimum(STARTS * (b + 1), size), length - GRAM), cuts[1:][j] - STARTS * b - 1
    return first, np.minimum(base, cuts[-1] - length), base


def _cutless(cuts: np.ndarray, state: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows without a cut inside (but their own), in phrases that aren't known or stand for known ones."""
    m = len(cuts) - 1
    last = np.where(np.arange(m) < m - 1, cuts[1:] - (length - GRAM) - 1, cuts[-1] - length)
    last = np.minimum(last, cuts[-1] - length)
    j = np.flatnonzero((state != 1) & (last >= cuts[:-1]))
    if not len(j):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate([np.arange(cuts[k], last[k] + 1) for k in j])


def _states(n: int, packed: bytes | None) -> np.ndarray:
    return np.full(n, -1, dtype=np.int8) if packed is None else np.frombuffer(packed, np.int8)


def _once(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, a start of each, all starts whose hash stands twice or more among these)."""
    distinct, first, where, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return distinct, start[first], start[count[where] > 1]


def _keys(hashed: Hashed, first: np.ndarray, last: np.ndarray, base: np.ndarray, starts: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bytes that all windows of a block of so many starts up to base share, and of all bytes of the windows
    from first to last together; a window by itself has its own hash for both."""
    many = (last - first).astype(np.uint64)
    return hashed.of(base, length - starts + 1).view(np.int64), (hashed.of(first, last - first + length) + many).view(np.int64)


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of ascending places."""
    far = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate(([0], far + 1))[: len(at)]], at[np.concatenate((far, [len(at) - 1]))[: len(at)]]


_BLOCK = "kind int, common long, whole long, did long, first int, last int, base int, edge boolean"


def _rows_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    if out:
        cells = [np.concatenate(c) for c in zip(*out, strict=True)]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["kind", "common", "whole", "did", "first", "last", "base", "edge"])


def _blocks(length: int):
    """text, cuts, states -> kind 0: blocks; kind 1: windows without cut, each content once (first = last); kind 2: runs
    of starts of those that stand twice in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in small(batches):
            out = []
            for k in range(batch.num_rows):
                cuts = batch.column(2)[k].values.to_numpy().astype(np.int64)
                if len(cuts) < 2:
                    continue
                did, state = batch.column(0)[k].as_py(), _states(len(cuts) - 1, batch.column(3)[k].as_py())
                edges, alone = _edges(cuts, state, length), _cutless(cuts, state, length)
                if not len(edges) and not len(alone):
                    continue
                hashed = Hashed(batch.column(1)[k].as_py(), powers)
                j, b = edges[:, 0], edges[:, 1]
                first, last, base = _spans(cuts, j, b, length)
                some = last >= first
                j, b, first, last, base = j[some], b[some], first[some], last[some], base[some]
                common, whole = _keys(hashed, first, last, base, STARTS, length)
                common = common + b
                one, at, twice = _once(hashed.of(alone, length).view(np.int64), alone)
                low, high = _runs(twice)
                for kind, c, w, x, y, z, e in ((0, common, whole, first, last, base, state[j] < 1), (1, one, one, at, at, at, at >= 0), (2, low * 0, low * 0, low, high, high, low >= 0)):
                    out.append((np.full(len(x), kind, np.int32), c, w, np.full(len(x), did), x, y, z, e))
            yield from _rows_of(out)

    return run


def _smaller(length: int, starts: int):
    """text, open blocks (first, last, base, edge) -> kind 0: their blocks of at most so many starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in small(batches):
            out = []
            for k in range(batch.num_rows):
                blocks = batch.column(2)[k].values
                first, last, base = (blocks.field(f).to_numpy().astype(np.int64) for f in (0, 1, 2))
                edge = blocks.field(3).to_numpy(zero_copy_only=False)
                skip = (base - last) // starts  # counted from base, which lies where the cut behind it says
                n = (base - first) // starts + 1 - skip
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - skip, n)
                where = np.repeat(base, n) - place * starts
                low, high = np.maximum(where - starts + 1, np.repeat(first, n)), np.minimum(where, np.repeat(last, n))
                common, whole = _keys(Hashed(batch.column(1)[k].as_py(), powers), low, high, where, starts, length)
                out.append((np.zeros(len(low), np.int32), common, whole, np.full(len(low), batch.column(0)[k].as_py()), low, high, where, np.repeat(edge, n)))
            yield from _rows_of(out)

    return run


def _settle(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(did, first, last) of blocks that are repeated whole, and (did, first, last, base, edge) of those that stay open.

    Blocks of equal joint bytes are one content; a content that stands once stays open if others share its common bytes,
    and so does one block of each content that it shares them with.
    """
    place = F.struct("did", "first", "last", "base")
    contents = stage(blocks.groupBy("common", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"), F.max("edge").alias("e")), "repeat-contents")
    groups = contents.groupBy("common").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("e") & (F.col("n") == 1)).alias("open")).filter("c > 1 and open").select("common")
    left = contents.join(stage(groups, "repeat-open").hint("merge"), "common", "left_semi").select("place.*", (F.col("e") & (F.col("n") == 1)).alias("edge"))
    again = stage(contents.filter("n > 1 and e").select("common", "whole"), "repeat-twice")
    found = blocks.filter("edge").join(again.hint("merge"), ["common", "whole"], "left_semi").select("did", "first", "last")
    return found, left


def _remove(length: int):
    """text, cuts, states, spans of starts -> id, n_bytes, n_removed, n_spans, kept_sha256, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = []
                for k in range(part.num_rows):
                    data = part.column(1)[k].as_py() or b""
                    n, packed, more = len(data), part.column(3)[k].as_py(), part.column(4)[k]
                    kept, spans, gone = data, 0, 0
                    if packed is not None or more.is_valid:
                        step = np.zeros(n + 1, dtype=np.int32)
                        cuts = part.column(2)[k].values.to_numpy().astype(np.int64)
                        known = np.flatnonzero(_states(len(cuts) - 1, packed) > 0)
                        known = known[cuts[known] <= n - length]
                        start, last = cuts[known], np.minimum(cuts[1:][known] - 1, n - length)
                        if more.is_valid:
                            start, last = (np.concatenate((own, more.values.field(f).to_numpy())) for f, own in enumerate((start, last)))
                        np.add.at(step, start, 1)
                        np.add.at(step, last + length, -1)
                        dead = np.cumsum(step[:-1]) > 0
                        gone = int(dead.sum())
                        if gone:
                            spans = int((dead & ~np.concatenate(([False], dead[:-1]))).sum())
                            kept = np.frombuffer(data, np.uint8)[~dead].tobytes()
                    rows.append((n, gone, spans, hashlib.sha256(kept).hexdigest(), kept))
                cells = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    Texts count as UTF-8 bytes, null as empty; matches never cross texts; texts shorter than length stay whole.  Repeated
    rows are texts of their own, so each is the other's repeat.  Null ids stay null; other columns are left out.  No
    rows: none.  Memory: about 40 bytes a byte of the longest text, and a bucket of the phrases.
    """
    if length < 4 * STARTS:
        raise ValueError(f"length must be at least {4 * STARTS}")
    with arrow_rows(docs.sparkSession, 1024):
        return _remove_repeats(docs, length, id_col, text_col)


def _remove_repeats(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    tasks = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    cut = stage_by(rows.mapInArrow(_cut(length, max(1, rows.rdd.getNumPartitions())), _read_schema), "did", "repeat-texts")  # the one time that texts are shuffled
    collect_garbage(spark)
    beside = lambda columns, table, how: cut.select("did", *columns).join(table.hint("merge"), "did", how)
    # equal texts: all of them go, and one is enough for others to be held against
    twice = cut.filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.min("did").alias("first")).filter("c > 1").select("digest", "first")
    twice = stage(twice, "repeat-equal")
    equal_texts = cut.select("did", "n", "digest").join(twice.hint("merge"), "digest").select("did", "n", "first")
    equal_texts = stage(equal_texts, "repeat-copies")
    copies = equal_texts.filter("did <> first").select("did").hint("merge")
    posts = cut.select("did", "names").mapInArrow(_post(8 * tasks), "kind int, i long, s long, bucket int, packed binary")
    found = stage(posts.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "i long, s long"), "repeat-names")

    def by_doc(rows: DataFrame, value, name: str) -> DataFrame:
        return rows.groupBy(F.shiftright("i", _PHRASES).alias("did")).agg(F.collect_list(value).alias(name))

    phrase = F.col("i").bitwiseAND(F.lit((1 << _PHRASES) - 1)).cast("int")
    per_doc = stage(by_doc(found, phrase, "found"), "repeat-phrases")
    collect_garbage(spark)
    text = beside(["cuts", "names"], per_doc.join(copies, "did", "left_anti"), "inner").select("did", "cuts", "names", "found")
    text = stage(text.mapInArrow(_string(length), "i long, s long, print long"), "repeat-string")
    ranks = suffix_ranks(text.select("i", "s"))
    prefixes = text.filter("print is not null").select("i", "print").join(ranks, "i").select("r", "i", "print")
    equal = by_doc(_compare(prefixes), F.struct(phrase.alias("j"), "state"), "equal")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                state = np.full(batch.column(1)[k].as_py(), -1, dtype=np.int8)
                state[batch.column(2)[k].values.to_numpy()] = 0
                if batch.column(3)[k].is_valid:
                    s = batch.column(3)[k].values
                    state[s.field(0).to_numpy()] = s.field(1).to_numpy()
                out.append(state.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["did", "states"])

    sized = cut.select("did", F.size("names").alias("n")).join(per_doc.join(copies, "did", "left_anti"), "did").join(equal, "did", "left")
    states = stage(sized.select("did", "n", "found", "equal").mapInArrow(pack, "did long, states binary"), "repeat-states")
    for old in (found, text, ranks, per_doc):
        drop_staged(old)
    del posts, found, text, ranks, per_doc, prefixes, equal, sized
    collect_garbage(spark)

    marked = beside(["text", "cuts"], states, "left").join(copies, "did", "left_anti").select("did", "text", "cuts", "states")
    blocks = stage(marked.mapInArrow(_blocks(length), _BLOCK), "repeat-blocks")
    whole = equal_texts.select("did", F.lit(0).alias("first"), (F.col("n") - length).cast("int").alias("last"))
    found = [whole, blocks.filter("kind = 2").select("did", "first", "last")]
    now = blocks.filter("kind = 0")
    for starts in (FEWER, 1):
        repeated, left = _settle(now)
        found.append(stage(repeated, "repeat-whole"))
        left = left.groupBy("did").agg(F.collect_list(F.struct("first", "last", "base", "edge")).alias("blocks"))
        now = stage(beside(["text"], left, "inner").select("did", "text", "blocks").mapInArrow(_smaller(length, starts), _BLOCK), "repeat-smaller")
        collect_garbage(spark)
    single = now.union(blocks.filter("kind = 1"))
    again = stage(single.groupBy("common").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("common"), "repeat-again")
    found.append(single.filter("edge").join(again.hint("merge"), "common", "left_semi").select("did", "first", "last"))
    every = functools.reduce(DataFrame.union, found)
    spans = stage(every.groupBy("did").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "repeat-spans")
    for old in (blocks, now):
        drop_staged(old)
    del marked, blocks, now, left, single, again, found, every
    collect_garbage(spark)

    done = beside(["id", "text", "cuts"], states, "left").join(spans.hint("merge"), "did", "left").select("id", "text", "cuts", "states", "spans")
    return done.mapInArrow(_remove(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
