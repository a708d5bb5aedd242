"""Best-fit packing by patterns: non-negative least squares over the histogram of piece lengths, residuals by best fit.

Only the histogram, at most one count for each length up to the capacity, comes to the driver, so planning costs the same
at any size of corpus.  Patterns of one to four lengths that fill a sequence exactly are enumerated; how often each is
repeated is fitted to the histogram by non-negative least squares (projected gradient with momentum, then again on the
patterns that matter); the counts are rounded down and what is left over is packed by best fit, longest first.  The plan
says for the n-th piece of each length its sequence and place; pieces look it up by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, read_table, stage
from .tokens import MEMO, release, shared_tokenizer

CAPACITY, END_ID = 2048, 0
#: Patterns of three and of four lengths that are enumerated, at most.
TRIPLES, QUADS = 40_000, 40_000
#: Patterns kept for the second fit.
SUPPORT = 4096


def enumerate_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to four lengths (ascending, 0: none) that are present and sum to the capacity."""
    has = np.zeros(capacity + 1, dtype=bool)
    has[present] = True
    has[0] = False
    size = np.flatnonzero(has)
    found = [np.array([[0, 0, 0, capacity]])] if has[capacity] else []
    a = size[(size * 2 <= capacity)]
    a = a[has[capacity - a]]
    found.append(np.stack([0 * a, 0 * a, a, capacity - a], axis=1))
    small = size[size < capacity]
    if len(small):
        # triples and quads thinned evenly to a stated number; each length keeps its share
        x, y = np.meshgrid(small, small, indexing="ij")
        ok = (x <= y) & (capacity - x - y >= y)
        x, y = x[ok], y[ok]
        z = capacity - x - y
        ok = has[z]
        three = np.stack([0 * x, x, y, z], axis=1)[ok]
        found.append(three[:: max(1, -(-len(three) // TRIPLES))])
        step = max(1, len(small) // 64)
        grid = small[::step]
        x, y, z = np.meshgrid(small, grid, grid, indexing="ij")
        w = capacity - x - y - z
        ok = (y <= z) & (w >= 1)
        x, y, z, w = x[ok], y[ok], z[ok], w[ok]
        ok = has[w]
        four = np.stack([x, y, z, w], axis=1)[ok]
        found.append(np.sort(four[:: max(1, -(-len(four) // QUADS))], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, A's columns being the patterns."""
    n, top = len(patterns), len(counts)
    if not n:
        return np.zeros(0)
    weight = (patterns > 0).astype(np.float64)
    flat = patterns.ravel()
    forward = lambda x: np.bincount(flat, (weight * x[:, None]).ravel(), minlength=top)
    back = lambda r: (r[patterns] * weight).sum(axis=1)
    v = np.ones(n)
    for _ in range(12):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = np.zeros(n)
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - counts))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) by best fit, longest first; bins with equal content move together."""
    spaces: dict[int, dict[tuple[int, ...], int]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            space = min((s for s in spaces if s >= size), default=None)
            if space is None:
                each = capacity // size
                for fill, bins in ((each, left // each), (left % each, 1)):
                    if fill and bins:
                        group = spaces.setdefault(capacity - fill * size, {})
                        group[(size,) * fill] = group.get((size,) * fill, 0) + bins
                break
            group = spaces[space]
            content, bins = next(iter(group.items()))
            fill = min(space // size, left)
            moved = min(bins, left // fill)
            if moved == bins:
                del group[content]
                if not group:
                    del spaces[space]
            else:
                group[content] = bins - moved
            new = spaces.setdefault(space - fill * size, {})
            new[content + (size,) * fill] = new.get(content + (size,) * fill, 0) + moved
            left -= moved * fill
    return [(content, bins) for group in spaces.values() for content, bins in group.items()]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up the histogram counts[length] exactly."""
    left = counts.astype(np.int64).copy()
    patterns = enumerate_patterns(np.flatnonzero(left), capacity)
    x = fit_repeats(patterns, left.astype(np.float64))
    keep = np.argsort(-x, kind="stable")[:SUPPORT]
    patterns = patterns[keep[x[keep] > 0]]
    x = fit_repeats(patterns, left.astype(np.float64))
    out = []
    for i in np.argsort(-x, kind="stable"):
        lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        repeats = min(int(x[i]), int((left[lengths] // times).min()))
        if repeats > 0:
            left[lengths] -= repeats * times
            out.append((tuple(int(n) for n in patterns[i] if n), repeats))
    return out + best_fit(left, capacity)


def _pieces(tokenizer_path: str, capacity: int, end_id: int, memo: int, keep_memo: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokenizer = shared_tokenizer(tokenizer_path, memo)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                some = batch.slice(low, 4096)
                ids, size = tokenizer.encode(some.column(1))
                flat = np.insert(ids, np.cumsum(size), end_id).astype("<u4")
                size = size + 1
                doc_start = np.cumsum(size) - size
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                view = memoryview(flat).cast("B")
                at = doc_start[doc] + start
                crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                runs = length[order]
                nth = np.empty(len(runs), dtype=np.int64)
                nth[order] = np.arange(len(runs)) - np.searchsorted(runs, runs) + seen[runs]
                np.add.at(seen, length, 1)
                cells = [some.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"])
        if not keep_memo:
            del tokenizer
            release()

    return cut


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO, keep_memo: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; only one longer than the capacity is cut.  Null texts count as empty (one id);
    null and repeated ids are documents of their own; other columns are left out.  No rows: none.  A worker's tokenizer
    has a memo of at most memo pieces; keep_memo=False frees it after each task, for stages that need the memory.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = stage(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id, memo, keep_memo), "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces")
    by_part = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")  # at most tasks times capacity rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    before = by_part.select("part", "length", before.alias("before"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most one row per length
        counts[length] = n
    segments: dict[int, list] = {}
    used, sequence = np.zeros(capacity + 1, dtype=np.int64), 0
    for lengths, repeats in plan(counts, capacity):
        offset = 0
        for length in lengths:
            first = int(used[length])
            segments.setdefault(length, []).append((first, sequence - first, offset))
            used[length] += repeats
            offset += length
        sequence += repeats

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = places.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order], prepend=-1))
            for at in np.split(order, cut[1:]) if len(order) else ():
                firsts, shifts, offsets = shared[int(length[at[0]])]
                k = np.searchsorted(firsts, rank[at], side="right") - 1
                sequence[at], offset[at] = rank[at] + shifts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    places = spark.sparkContext.broadcast({k: tuple(np.array(x) for x in zip(*v, strict=True)) for k, v in segments.items()})  # bounded by the capacity, not by the corpus
    before, few = bounded_broadcast(before, 200_000)
    ranked = pieces.join(before if few else before.hint("merge"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    found = ranked.mapInArrow(look_up, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return found.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
