"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact to the last link.

Documents with equal shingle sets are one class.  Sizes are cut into bands so that only equal and neighbouring bands can
hold a pair similar enough.  A pair of such sizes differs in at most d shingles, so of d + s segments of the hash range at
least s are equal in both: segments are the keys that bring classes together.  The few classes of a small group are paired
and each pair is held against its bound by bitmaps.  A large group, say of documents with the same licence, is not: a pair
that meets in large groups alone must meet in s of them, so classes that lie in fewer leave them, which makes groups
smaller and others leave in turn.  What is left is paired, or chained to the group's first if it is still large.  What is
then connected makes up a candidate block.
Within a block, tiles of a bounded number of classes of a band meet the tiles of their own and the next band.  In a
tile every class has a bitmap; the bits set in one and not in the other count shingles that it alone has, which bounds
the intersection from above; pairs that pass are intersected exactly as sorted arrays.  Classes already connected are
not compared again, so a tile gives a spanning forest, not all its pairs; components of the forests are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, collect_garbage, drop_staged, numbered, partitions, read_table, stage
from .components import components

#: A tile has at most this many classes and (but for one larger class) shingles.
TILE_CLASSES, TILE_SHINGLES = 4096, 6_000_000
#: Groups of a key of at most this many classes are paired, larger ones chained.
PAIRED = 24
#: Keys that a task holds before it hands them on.
HELD_KEYS = 600_000
#: Buckets of keys to a task; one at a time is held.
BUCKETS = 8
#: Pairs that a task holds before it hands them on, each once.
HELD_PAIRS = 400_000
#: Rounds in which classes leave large groups.
PEELED = 2
#: Rows of the tables that may be broadcast.
FEW = 200_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct k-word shingles of texts as sorted 64-bit hashes."""

    def __init__(self, k: int):
        self.k = k

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """A sorted array per text. Fewer than k words: the whole sequence as one shingle; null or no word: empty."""
        whole = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))  # ascii_lower misreads the data of slices
        low = pc.ascii_lower(pc.fill_null(whole, ""))
        lists = pc.ascii_split_whitespace(low)
        words = lists.flatten()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.dictionary_encode()
        known = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        empty = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), size)
        real = ~empty[codes] if len(codes) else np.zeros(0, bool)
        hashes, owner = known[codes[real]] if len(codes) else np.zeros(0, np.uint64), owner[real]
        counts = np.bincount(owner, minlength=len(texts))
        ends = np.cumsum(counts)
        k, n = self.k, len(hashes)
        run = np.full(max(0, n - k + 1), k, dtype=np.uint64)
        for i in range(k):
            run = _mix(run * _U(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i])
        out = []
        for size, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if size >= k:
                out.append(np.unique(run[end - size : end - k + 1]))
            elif size:
                whole = np.full(1, size, dtype=np.uint64)
                for i in range(end - size, end):
                    whole = _mix(whole * _U(0x9E3779B97F4A7C15) + hashes[i])
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


class Bands:
    """Bands of set sizes for a least similarity; sizes that can be linked lie in equal or neighbouring bands."""

    def __init__(self, least: Fraction, top: int = 1 << 33):
        self.least, lows = least, [1]
        if least >= 1:  # only equal sets are linked, and those are one class
            self.lows, self.apart = np.array([1, top]), [0, 0]
            return
        while lows[-1] < top:
            step = lows[-1] / least
            lows.append(max(lows[-1] + 1, -(-step.numerator // step.denominator)))
        self.lows = np.array(lows, dtype=np.int64)
        apart = (1 - least) / (1 + least)
        #: Most shingles in which a linked pair can differ whose larger set lies in the band.
        self.apart = [int(2 * (high - 1) * apart) for high in lows[1:]]

    def of(self, size) -> np.ndarray:
        return np.searchsorted(self.lows, size, side="right") - 1

    def keys(self, shingles: np.ndarray) -> tuple[np.ndarray, int]:
        """Keys of one sorted set, bit 16 the parity of their tile; linked sets that aren't equal share at least `need` of
        one tile, and at least one.  The needs of the even tile and, from bit 16, of the odd one are returned too."""
        if not len(shingles):
            return shingles, 0
        needs = 0
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(shingles ^ _U(0x5851F42D4C957F2D)))))
        band, out = int(self.of(len(shingles))), []
        for tile in (band, band + 1):
            if not self.apart[tile]:
                continue  # only equal sets can be linked
            spare = 2 + self.apart[tile] // 4  # equal segments beyond the first; more empty ones than these are rare
            m = self.apart[tile] + 1 + spare
            edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
            at = np.concatenate(([0], np.searchsorted(shingles, edges), [len(shingles)]))
            full = at[1:] > at[:-1]
            if m - full.sum() > spare:
                full[:] = True  # equal empty segments could be all that a pair has in common
            names = _mix(np.arange(m, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(tile + 1))
            named = _mix((total[at[1:]] - total[at[:-1]]) * _U(0xD6E8FEB86659FD93) + names)[full]
            out.append((named & ~_U(1 << 16)) | _U((tile & 1) << 16))
            # equal empty segments are no keys
            needs |= min(0x7FFF, max(1, spare + 1 - int(m - full.sum()))) << (16 if tile & 1 else 0)
        return (np.concatenate(out) if out else np.zeros(0, np.uint64)), needs


def linked(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether |a & b| / |a | b| >= least, exactly; a and b sorted and distinct."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    spot = np.searchsorted(b, a)
    common = int(np.count_nonzero(b[np.minimum(spot, len(b) - 1)] == a))
    return least.denominator * common >= least.numerator * (len(a) + len(b) - common)


def bitmap(shingles: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Bits of the shingles' hashes, in a power of two of bits not below their number (64 to 65536)."""
    if bits is None:
        bits = 1 << max(6, min(16, (len(shingles) - 1).bit_length() if len(shingles) else 0))
    out = np.zeros(bits // 64, dtype=np.uint64)
    place = shingles % _U(bits)
    np.bitwise_or.at(out, (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63)))
    return out


def may_link(na: int, a: np.ndarray, nb: int, b: np.ndarray, least: Fraction) -> bool:
    """False only if the bitmaps show that sets of na and nb shingles cannot be similar enough."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    most = min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))
    return most > 0 and least.denominator * most >= least.numerator * (na + nb - most)


def forest(names: np.ndarray, sets: list[np.ndarray], least: Fraction) -> list[tuple[int, int]]:
    """Edges that connect exactly the sets that links connect; each set meets only sets that are not yet connected."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    bits = 64
    while bits < size.max(initial=0) and bits < 1 << 16:
        bits *= 2
    maps = np.stack([bitmap(s, bits) for s in sets]) if n else np.zeros((0, 1), dtype=np.uint64)
    ratio = float(least)
    rest = np.argsort(size, kind="stable")
    out = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = rest[(size[rest] >= ratio * size[x] - 1e-6) & (size[x] >= ratio * size[rest] - 1e-6)]
            only = np.maximum(size[x] - np.bitwise_count(maps[x] & ~maps[near]).sum(axis=1, dtype=np.int64), 0)
            other = np.maximum(size[near] - np.bitwise_count(~maps[x] & maps[near]).sum(axis=1, dtype=np.int64), 0)
            most = np.minimum(only, other)  # of the intersection
            near = near[most * (1 + ratio) >= ratio * (size[x] + size[near]) - 1e-6]
            hit = [int(y) for y in near if linked(sets[x], sets[y], least)]
            if hit:
                out += [(int(names[x]), int(names[y])) for y in hit]
                queue += hit
                rest = rest[~np.isin(rest, hit)]
    return out


_MIXED = "kind int, a long, b long, n int, bits binary, bucket int, keys binary, places binary, hot binary, need int"
_FOUND = "kind int, a long, b long, n int, bits binary, need int"
_signed = lambda x: np.asarray(x, dtype=np.uint64).view(np.int64)


def _class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _group_ids(key: np.ndarray, buckets: int) -> np.ndarray:
    """Names of keys, the same wherever they are made; bit 0 the parity of the tile."""
    short = key >> _U(16)
    return (_mix(short ^ _mix(key % _U(buckets) + _U(1))) & ~_U(1)) | (short & _U(1))


def _reader(k: int, least: Fraction, buckets: int, paired: int):
    """documents -> kind 0: a = id, b = class (null: no shingle), n, bits, need; kind 1: packed keys of a bucket;
    kind 4: a = class, b = key of a large group."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(k), Bands(least)
        keys, owners, held, turn = [], [], 0, 0
        seen: set[int] = set()

        def rows(kind, a, b, n=None, bits=None, bucket=None, packed=None, places=None, hot=None, need=None):
            size = len(a)
            none = lambda t: pa.nulls(size, t)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(size, kind, np.int32)), a if isinstance(a, pa.Array) else pa.array(a, pa.int64()), b if isinstance(b, pa.Array) else pa.array(b, pa.int64()),
                none(pa.int32()) if n is None else pa.array(n, pa.int32()), none(pa.binary()) if bits is None else pa.array(bits, pa.binary()), pa.array(bucket, pa.int32()),
                *[none(pa.binary()) if x is None else pa.array(x, pa.binary()) for x in (packed, places, hot)], none(pa.int32()) if need is None else pa.array(need, pa.int32()),
            ], names=["kind", "a", "b", "n", "bits", "bucket", "keys", "places", "hot", "need"])

        def flush():
            nonlocal keys, owners, held
            if not held:
                return
            key, owner = np.concatenate(keys), np.concatenate(owners)
            keys, owners, held = [], [], 0
            seen.clear()
            # of a group that is large here, the first class alone goes to the bucket, marked
            key, owner, first, size = grouped(key, owner)
            hot = size > paired
            spread = np.flatnonzero(hot & ~first)
            for low in range(0, len(spread), 100_000):
                some = spread[low : low + 100_000]
                yield rows(4, _signed(owner[some]), _signed(_group_ids(key[some], buckets)), bucket=np.arange(len(some)) % buckets)
            stay = first | ~hot
            key, owner, hot = key[stay], owner[stay], hot[stay]
            which = key % _U(buckets)
            order = np.argsort(which, kind="stable")
            key, owner, hot = key[order], owner[order], hot[order]
            cut = np.searchsorted(which[order], np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            for some in np.array_split(full, max(1, len(full) // 64)):
                if len(some):
                    parts = [[pack(x[cut[i] : cut[i + 1]]) for i in some] for pack, x in ((_packed, key), (np.ndarray.tobytes, owner), (lambda x: np.packbits(x).tobytes(), hot))]
                    yield rows(1, pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), bucket=some, packed=parts[0], places=parts[1], hot=parts[2])

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sets = shingler.sets(part.column(1))
                classes = np.array([_class_of(s) if len(s) else 0 for s in sets], dtype=np.uint64)
                size = np.array([len(s) for s in sets], dtype=np.int32)
                needs = []
                for name, s in zip(classes.tolist(), sets, strict=True):
                    more, need = bands.keys(s)
                    needs.append(need)
                    if len(s) and name not in seen:
                        seen.add(name)
                        keys.append(more)
                        owners.append(np.full(len(more), name, dtype=np.uint64))
                        held += len(more)
                yield rows(0, part.column(0), pa.array(_signed(classes), mask=size == 0), size, [bitmap(x).tobytes() for x in sets], (np.arange(len(sets)) + turn) % buckets, need=needs)
                turn += len(sets)
                if held >= HELD_KEYS:
                    yield from flush()
        yield from flush()

    return read


def grouped(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key: key, owner, whether it is the key's first, and the size of its group."""
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.concatenate((at, [len(key)])))
    return key, owner, first, np.repeat(size, size)


def leaders(owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the owner that is first in its group."""
    return owner[first][np.cumsum(first) - 1] if len(owner) else owner


def distinct_pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows (u, v), each once, without loops; the larger first."""
    apart = u != v
    pairs = np.stack([np.maximum(u, v)[apart], np.minimum(u, v)[apart]], axis=1)
    if not len(pairs):
        return pairs
    named = np.unique(np.ascontiguousarray(pairs).view([("u", "<u8"), ("v", "<u8")]).ravel())
    return np.stack([named["u"], named["v"]], axis=1)


def _packed(key: np.ndarray) -> bytes:
    """The upper 48 bits of keys: with the bucket enough to tell them apart; a clash only makes one candidate more."""
    return (key >> _U(32)).astype("<u4").tobytes() + (key >> _U(16)).astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return (np.frombuffer(data, "<u4", n).astype(np.uint64) << _U(16)) | np.frombuffer(data, "<u2", n, 4 * n)


def _bucket_pairs(rows: list[tuple[bytes, bytes, bytes]], bucket: int, buckets: int, paired: int) -> tuple[np.ndarray, np.ndarray]:
    """(members (class, key) of large groups, pairs of small ones) of one bucket's packed (keys, owners, hot)."""
    key, owner = np.concatenate([_unpacked(k) for k, _, _ in rows]), np.concatenate([np.frombuffer(o, np.uint64) for _, o, _ in rows])
    hot = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8), count=len(k) // 6).astype(bool) for k, _, h in rows])
    hot_keys = np.unique(key[hot])
    key, owner, first, size = grouped(key, owner)
    large = (size > paired) | np.isin(key, hot_keys)
    several = (size > 1) & ~large
    ids = (_mix(key[large] ^ _mix(np.full(1, bucket, np.uint64) + _U(1))) & ~_U(1)) | (key[large] & _U(1))
    key_few, owner_few = key[several], owner[several]
    pairs = [np.zeros((0, 2), np.uint64)]
    for step in range(1, paired):  # the classes of a key stand side by side
        same = key_few[step:] == key_few[:-step]
        if not same.any():
            break
        pairs.append(distinct_pairs(owner_few[step:][same], owner_few[:-step][same]))
    return np.stack([owner[large], ids], axis=1), np.concatenate(pairs)


def _meet(buckets: int, paired: int):
    """Rows sorted by bucket: passes others on; the keys of a bucket, the one that is held, become pairs (kind 3) or, in
    large groups, members (kind 4)."""
    names = ["kind", "a", "b", "n", "bits", "need"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows, pairs = None, [], []

        def given(kind: int, every: np.ndarray):
            for low in range(0, len(every), 100_000):
                some = every[low : low + 100_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(_signed(some[:, 0].copy())), pa.array(_signed(some[:, 1].copy())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], names=names)

        def flush():
            if pairs:
                every = np.concatenate(pairs)
                pairs.clear()
                yield from given(3, distinct_pairs(every[:, 0], every[:, 1]))

        def close():
            if rows:
                members, more = _bucket_pairs(rows, bucket, buckets, paired)
                rows.clear()
                yield from given(4, members)
                pairs.append(more)
                if sum(map(len, pairs)) > HELD_PAIRS:
                    yield from flush()

        for batch in batches:
            packed = pc.equal(batch.column(0), 1).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(packed).tolist():
                here = batch.column(5)[i].as_py()
                if here != bucket:
                    yield from close()
                    bucket = here
                rows.append(tuple(batch.column(6 + k)[i].as_py() for k in range(3)))
            if not packed.all():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(~packed)).select(names).columns, names=names)
        yield from close()
        yield from flush()

    return meet


def _large_groups(members: DataFrame, needs: DataFrame, paired: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b), edges (u, v)) of the members (class, key) of large groups; needs: (class, need).

    Two linked classes that share keys of large groups alone share as many of one tile as both need, so a class with fewer
    members has no such link and leaves.  Every round is exact by itself, so their number is a matter of cost.
    """
    now = stage(members.distinct(), "join-members")
    for _ in range(PEELED):
        parity = F.col("key").bitwiseAND(F.lit(1).cast("long"))
        counts = now.groupBy("class", parity.alias("odd")).agg(F.count(F.lit(1)).alias("c"))
        need = F.when(F.col("odd") == 1, F.shiftright("need", 16)).otherwise(F.col("need").bitwiseAND(F.lit(0x7FFF)))
        enough = counts.join(needs.hint("merge"), "class").filter(F.col("c") >= need).select("class", "odd")
        left = stage(now.withColumn("odd", parity).join(enough.hint("merge"), ["class", "odd"], "left_semi").drop("odd"), "join-members")
        several = stage(left.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "join-groups")
        after = stage(left.join(several.hint("merge"), "key", "left_semi"), "join-members")
        for old in (now, left, several):
            drop_staged(old)
        now = after
    sizes = stage(now.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("first")), "join-groups")
    small = stage(now.join(sizes.filter(F.col("c") <= paired).select("key").hint("merge"), "key", "left_semi"), "join-small")
    x, y = small.select("key", F.col("class").alias("a")), small.select("key", F.col("class").alias("b"))
    pairs = x.join(y.hint("merge"), "key").filter("a > b").select("a", "b")  # groups of at most `paired` classes
    chained = now.join(sizes.filter(F.col("c") > paired).select("key", "first").hint("merge"), "key")
    return pairs, chained.select(F.col("class").alias("u"), F.col("first").alias("v")).filter("u <> v")


def _within(least: Fraction):
    """(a, b, na, nb, bits_a, bits_b) -> (u, v) of the pairs whose bitmaps don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (4, 5))
                keep[i] = may_link(int(na[i]), x, int(nb[i]), y, least)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def _tiles(blocks: DataFrame, bands: Bands) -> DataFrame:
    """(class, block, n) -> one row for each tile or pair of tiles that a class takes part in: class, block, left, right."""
    lows = F.array(*[F.lit(int(x)) for x in bands.lows if x < 1 << 31])
    rows = blocks.withColumn("band", F.size(F.filter(lows, lambda x: x <= F.col("n"))) - 1)
    per_band = rows.groupBy("block", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    parts = F.greatest(F.ceil(F.col("c") / (TILE_CLASSES // 2)), F.ceil(F.col("s") / (TILE_SHINGLES // 2))).cast("int")
    per_band = stage(per_band.withColumn("parts", parts), "join-bands")
    whole = per_band.groupBy("block").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    large = stage(whole.filter((F.col("c") > TILE_CLASSES) | (F.col("s") > TILE_SHINGLES)).select("block"), "join-large")
    small = rows.join(large, "block", "left_anti").select("class", "block", F.lit(-1).alias("lb"), F.lit(0).alias("lp"), F.lit(-1).alias("rb"), F.lit(0).alias("rp"))
    of = per_band.join(large, "block", "left_semi").select("block", "band", "parts")
    big = rows.join(of, ["block", "band"])
    big = big.join(of.select("block", (F.col("band") - 1).alias("band"), F.col("parts").alias("up")), ["block", "band"], "left")
    big = big.join(of.select("block", (F.col("band") + 1).alias("band"), F.col("parts").alias("down")), ["block", "band"], "left")
    part = F.pmod(F.hash("class"), F.col("parts"))
    pair = lambda lb, lp, rb, rp: F.struct(lb.alias("lb"), lp.alias("lp"), rb.alias("rb"), rp.alias("rp"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    b = F.col("band")
    own = F.transform(upto(F.col("parts")), lambda j: pair(b, F.least(part, j), b, F.greatest(part, j)))
    above = F.transform(upto(F.coalesce("up", F.lit(0))), lambda j: pair(b, part, b + 1, j))
    below = F.transform(upto(F.coalesce("down", F.lit(0))), lambda j: pair(b - 1, j, b, part))
    return small.union(big.select("class", "block", F.explode(F.concat(own, above, below)).alias("p")).select("class", "block", "p.*"))


def _resolve(k: int, least: Fraction):
    """Rows sorted by tile (block, lb, lp, rb, rp) with class and shingles -> edges of the tiles' forests."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, names, sets = None, [], []

        def close():
            edges = forest(np.array(names, dtype=np.int64), sets, least) if len(sets) > 1 else []
            if edges:
                u, v = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            at = list(zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True))
            name = batch.column(5).to_pylist()
            for i, here in enumerate(at):
                if here != tile:
                    yield from close()
                    tile, names, sets = here, [], []
                names.append(name[i])
                sets.append(np.frombuffer(batch.column(6)[i].as_py(), np.uint64))
        yield from close()

    return resolve


def _roots(rows: DataFrame, k: int, least: Fraction) -> DataFrame:
    """rows (id, text; null ids allowed) -> staged (id, n, root) per row; root names the component, null without shingles."""
    spark = rows.sparkSession
    tasks = partitions(spark)
    buckets = BUCKETS * tasks
    mixed = rows.mapInArrow(_reader(k, least, buckets, PAIRED), _MIXED).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(buckets, PAIRED), _FOUND)
    mixed = stage(mixed, "join-documents")
    collect_garbage(spark)  # the shuffled keys
    found = mixed.filter("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("class"), "n")
    # one row per class; partial aggregates take care of a class with very many documents
    classes = mixed.filter("kind = 0 and b is not null").groupBy(F.col("b").alias("class")).agg(F.min("a").alias("id"), F.max("n").alias("n"), F.first("bits").alias("bits"), F.max("need").alias("need"))
    classes = stage(classes, "join-classes")
    more, chained = _large_groups(mixed.filter("kind = 4").select(F.col("a").alias("class"), F.col("b").alias("key")), classes.select("class", "need"), PAIRED)
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    pairs = mixed.filter("kind = 3").select("a", "b").union(more).distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
    edges = pairs.mapInArrow(_within(least), "u long, v long").union(chained)
    blocks = components(edges)
    links = stage(_links(rows, classes.select("class", "id", "n"), blocks, k, least), "join-links")
    collect_garbage(spark)
    roots = components(links)
    table, _ = bounded_broadcast(roots.withColumnsRenamed({"node": "class"}), FEW)
    rooted = stage(found.join(table, "class", "left").select("id", "n", F.coalesce("root", "class").alias("root")), "join-roots")
    for old in (mixed, classes, links):
        drop_staged(old)
    return rooted


def jaccard_components(docs: DataFrame, k: int = 3, least: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, the smallest id that links reach (itself included).

    A-Z count as a-z; words are what white space (space, tab to carriage return) separates.  Rows with equal sets are
    linked; null and empty texts have no shingle and are linked with nothing.  Null ids are passed over by component_id
    unless nothing else is there.  Repeated rows each give a row; other columns are left out.  No rows: none.
    """
    rooted = _roots(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), k, least)
    shared = stage(rooted.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("root", "least"), "join-least")
    out = rooted.join(shared, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _links(rows: DataFrame, classes: DataFrame, blocks: DataFrame, k: int, least: Fraction) -> DataFrame:
    """Edges (u, v) of classes whose components are those of all links; blocks: (node, root) of the candidates."""
    tasks = partitions(rows.sparkSession)
    candidates = stage(classes.join(blocks.select(F.col("node").alias("class"), F.col("root").alias("block")), "class"), "join-candidates")
    tiles = stage(_tiles(candidates.select("class", "block", "n"), Bands(least)), "join-tiles")
    wanted, _ = bounded_broadcast(candidates.select("id", F.col("class").alias("wanted")), FEW)
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"])).select("text", "wanted")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = shingler.sets(part.column(0))
                classes = _signed(np.array([_class_of(s) if len(s) else 0 for s in sets], dtype=np.uint64))
                right = classes == part.column(1).to_numpy()  # another text may have the same id
                yield pa.RecordBatch.from_arrays([part.column(1).filter(pa.array(right)), pa.array([s.tobytes() for s, ok in zip(sets, right, strict=True) if ok], pa.binary())], names=["class", "shingles"])

    sets = texts.mapInArrow(shingle, "class long, shingles binary")
    key = ["block", "lb", "lp", "rb", "rp"]
    joined = tiles.join(sets, "class").select(*key, "class", "shingles").repartition(tasks, *key).sortWithinPartitions(*key)
    return joined.mapInArrow(_resolve(k, least), "u long, v long")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def oracle() -> str:
    return """
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, y FROM reach JOIN both_ways ON b = x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id)
  JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""


def drop_near_duplicates(docs: DataFrame, k: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one of each group of linked ones stays: that of the smallest id.

    Rows are told apart by a number of their own, never by id, so that ids may be null or repeated: of equal ids in a
    group one row stays, a null id only where the group has no other.  Rows without shingles all stay.
    """
    rows = numbered(docs.select(F.struct(*docs.columns).alias("_row")), "join-rows")
    rooted = _roots(rows.select(F.col("_rid").alias("id"), F.col("_row")[text_col].cast("string").alias("text")), k, least)
    order = F.col("_row")[id_col].cast("long")
    ids = rows.select(F.col("_rid").alias("id"), F.struct(order.isNull().alias("none"), order.alias("at"), F.col("_rid").alias("rid")).alias("place"))
    groups = rooted.filter("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("root")
    several = rooted.join(groups, "root").select("root", "id")
    placed = stage(several.join(ids, "id").select("root", "place"), "join-places")
    first = stage(placed.groupBy("root").agg(F.min("place").alias("first")), "join-first")
    gone = placed.join(first, "root").filter(F.col("place.rid") != F.col("first.rid")).select(F.col("place.rid").alias("_gone"))
    gone, _ = bounded_broadcast(stage(gone, "join-gone"), FEW)
    return rows.join(gone, F.col("_rid") == F.col("_gone"), "left_anti").select("_row.*")
