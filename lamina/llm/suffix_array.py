"""Suffix arrays of very long strings by the difference-cover algorithm, on DataFrames.

The string is a table (i, s): positions, which need not be dense, and symbols, both long; a position whose successor i + 1
is missing ends a piece, and the last symbol of every piece is unique, so that all suffixes differ.  Positions with
i mod 3 <> 0 are the sample: their triples are sorted and named, the names make a string of two thirds the length that is
sorted in turn, and the remaining suffixes, sorted by their symbol and the rank behind it, are merged with the sample:
against i mod 3 = 1 by (symbol, next rank), against i mod 3 = 2 by (two symbols, next rank).  A string of at most BASE
symbols is sorted in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_garbage, drop_staged, partitions, stage

#: Symbols that one task sorts; a constant, whatever the string's length.
BASE = 1024
#: Positions to a window; two more are seen behind it.
BLOCK = 3 << 14
NONE = -(2**63)


def sort_small(i: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Ranks (from 1) of the suffixes at ascending positions i, by prefix doubling."""
    _, rank = np.unique(s, return_inverse=True)
    rank, step = rank.astype(np.int64) + 1, 1
    while len(i) and rank.max() < len(i):
        spot = np.searchsorted(i, i + step).clip(0, len(i) - 1)
        # the piece may have ended before i + step
        behind = np.where(i[spot] == i + step, rank[spot], 0)
        order = np.lexsort((behind, rank))
        a, b = rank[order], behind[order]
        new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1])))) + 1
        if new[-1] == rank.max() and step > len(i):
            raise ValueError("equal suffixes: the last symbol of every piece must be unique")
        rank = np.empty_like(rank)
        rank[order] = new
        step *= 2
    return rank


def _follow(tables: list[DataFrame], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """One row per position of the tables (i and columns of their own), with all their columns and more: name -> (column,
    distance), that column at i + distance, null where there is no such position.

    One shuffle, by block of positions; the first two positions of a block are seen by the block before it as well.
    """
    block = F.floor(F.col("i") / BLOCK)
    own = {c: kind for t in tables for c, kind in t.dtypes if c != "i"}
    rows = functools.reduce(DataFrame.unionByName, [t.select("i", *[F.col(c) if c in t.columns else F.lit(None).cast(kind).alias(c) for c, kind in own.items()]) for t in tables])
    halo = rows.filter(F.pmod("i", F.lit(BLOCK)) < 2).withColumn("_b", block - 1).withColumn("_own", F.lit(False))
    both = rows.withColumn("_b", block).withColumn("_own", F.lit(True)).unionByName(halo)
    if len(tables) > 1:
        both = both.repartition(partitions(both.sparkSession), "_b").groupBy("_b", "i").agg(*[F.max(c).alias(c) for c in own], F.max("_own").alias("_own"))
    window = Window.partitionBy("_b").orderBy("i")

    def at(column: str, distance: int) -> Column:
        out = None
        for k in range(1, distance + 1):
            one = F.when(F.lead("i", k).over(window) == F.col("i") + distance, F.lead(column, k).over(window))
            out = one if out is None else F.coalesce(out, one)
        return out

    return both.select("*", *[at(c, d).alias(n) for n, (c, d) in columns.items()]).filter("_own").drop("_b", "_own")


def _sorted_parts(rows: DataFrame, keys: list[str], flags: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """rows staged in range order with part, name (dense rank of the keys within the part) and, for each 0/1 flag, its
    count before the row within the part; and the parts' totals."""
    names = [*keys, "i", *flags]
    ordered = rows.select(*[F.col(n).cast("long") for n in names]).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, name, before = TaskContext.get().partitionId(), None, 0, [0] * len(flags)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns[: len(keys)]], axis=0)
            now = tuple(int(c[0]) for c in columns[: len(keys)])
            new[0] = last != now
            here = name + np.cumsum(new)
            name, last = int(here[-1]), tuple(int(c[-1]) for c in columns[: len(keys)])
            counts = []
            for k, flag in enumerate(columns[len(keys) + 1 :]):
                total = before[k] + np.cumsum(flag)
                counts.append(pa.array(total - flag))
                before[k] = int(total[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[len(keys) :], pa.array(here), *counts, pa.array(np.full(batch.num_rows, part, np.int64))], names=["i", *flags, "name", *[f"{f}_before" for f in flags], "part"])

    out = stage(ordered.mapInArrow(number, ", ".join(["i long", *[f"{f} long" for f in flags], "name long", *[f"{f}_before long" for f in flags], "part long"])), "suffix-sorted")
    totals = out.groupBy("part").agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in flags]).orderBy("part").collect()  # a row per part
    return out, totals


def _offset(totals, column: str) -> Column:
    """What the parts before the row's part add up to."""
    sums, at = [0] * (max((r["part"] for r in totals), default=0) + 2), 0
    by_part = {r["part"]: r[column] for r in totals}
    for p in range(len(sums)):
        sums[p] = at
        at += by_part.get(p, 0)
    table = F.from_json(F.lit(str(sums)), "array<bigint>")  # folded into one literal, however many parts
    return F.element_at(table, F.col("part").cast("int") + 1)


def suffix_ranks(text: DataFrame, base: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """(i, r): the rank, from 1, of every suffix of the string (i, s). Staged; no rows: none.

    size: the number of symbols and a number above every position, where they are known.
    """
    base = BASE if base is None else base
    text = text.select(F.col("i").cast("long").alias("i"), F.col("s").cast("long").alias("s"))
    total, above = size or text.agg(F.count(F.lit(1)), F.coalesce(F.max("i"), F.lit(0)) + 1).first()
    if total <= base:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if held:
                i, s = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
                order = np.argsort(i)
                yield pa.RecordBatch.from_arrays([pa.array(i[order]), pa.array(sort_small(i[order], s[order]))], names=["i", "r"])

        return stage(text.coalesce(1).mapInArrow(run, "i long, r long"), "suffix-base")

    parts = max(1, min(partitions(text.sparkSession), -(-total // 20_000)))
    # names of the sampled triples
    low = F.lit(NONE).cast("long")
    triples = _follow([text], {"s1": ("s", 1), "s2": ("s", 2)}).filter(F.pmod("i", F.lit(3)) != 0)
    triples = triples.select("i", "s", F.coalesce("s1", low).alias("s1"), F.coalesce("s2", low).alias("s2"))
    named, totals = _sorted_parts(triples, ["s", "s1", "s2"], [], parts)
    names = named.select("i", (F.col("name") + _offset(totals, "name")).alias("r"))
    sampled = sum(t["n"] for t in totals)
    if sum(t["name"] for t in totals) < sampled:
        # recurse on the names: positions 3q + 1 in order, then positions 3q + 2
        span = above // 3 + 2
        third = F.floor(F.col("i") / 3)
        shorter = names.select((third + F.when(F.pmod("i", F.lit(3)) == 2, span).otherwise(0)).alias("i"), F.col("r").alias("s"))
        ranks = suffix_ranks(shorter, base, (sampled, 2 * span))
        second = F.col("i") >= span
        sample = ranks.select((F.when(second, F.col("i") - span).otherwise(F.col("i")) * 3 + F.when(second, 2).otherwise(1)).alias("i"), "r")
    else:
        ranks, sample = None, names

    # merge the others
    full = _follow([text, sample], {"s1": ("s", 1), "r1": ("r", 1), "r2": ("r", 2)})
    full = stage(full.select("i", "s", F.coalesce("s1", low).alias("s1"), F.coalesce("r1", F.lit(0)).alias("r1"), F.coalesce("r2", F.lit(0)).alias("r2"), (F.pmod("i", F.lit(3)) == 0).cast("long").alias("zero"), (F.pmod("i", F.lit(3)) != 0).cast("long").alias("other")), "suffix-merge")
    one, one_totals = _sorted_parts(full.filter(F.pmod("i", F.lit(3)) != 2), ["s", "r1"], ["zero", "other"], parts)
    two, two_totals = _sorted_parts(full.filter(F.pmod("i", F.lit(3)) != 1), ["s", "s1", "r2"], ["zero", "other"], parts)
    # a rank is a sum: of a sampled suffix its rank in the sample and the others before it; of another one the others
    # before it and the sampled ones before it in both orders
    is_zero = F.col("zero") == 1
    zeros = lambda totals: F.col("zero_before") + _offset(totals, "zero")
    others = lambda totals: F.col("other_before") + _offset(totals, "other")
    parts_of = [
        one.select("i", (zeros(one_totals) + F.when(is_zero, others(one_totals) + 1).otherwise(0)).alias("r")),
        two.select("i", F.when(is_zero, others(two_totals)).otherwise(zeros(two_totals)).alias("r")),
        sample.select("i", "r"),
    ]
    out = stage(functools.reduce(DataFrame.unionByName, parts_of).groupBy("i").agg(F.sum("r").alias("r")), "suffix-ranks")
    for old in (named, full, one, two, *([ranks] if ranks is not None else [])):
        drop_staged(old)
    del triples, named, names, full, one, two, parts_of, ranks, sample
    collect_garbage(text.sparkSession)
    return out
