"""Exact top-k search by integer inner product: columnar branch-and-bound over vertical tiles.

Rows are packed, where they lie, into tiles of bounded size whose data run dimension by dimension.  A tile of queries
meets every tile of candidates (the stated query set against all rows, in blocks).  For a pair of tiles the products of
one block of dimensions after the other are added up; what is left of a product is at most the root of the two
remaining masses (Cauchy-Schwarz), so candidates whose bound falls below the k-th best score so far are dropped and the
columns that survive are compacted before the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, read_table, stage

_TILE = "dim int, part int, seq int, n int, ids binary, data binary"
_EXACT = 2**53


def quantise(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double; beyond a long it is an error, as no long could hold a score of it."""
    whole = np.floor(values.astype(np.float64) * scale)
    if np.abs(whole).max(initial=0) >= 2.0**62:
        raise OverflowError(f"{scale} times a component does not fit a long")
    return whole.astype(np.int64)


def _packer(scale: int, rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        open_tiles: dict[int, list] = {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal seq
            held = open_tiles.pop(dim)
            ids, data = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            seq += 1
            cells = ([dim], [part], [seq - 1], [len(ids)], [ids.astype("<i8").tobytes()], [np.ascontiguousarray(data.T).astype("<i8").tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int32(),) * 4 + (pa.binary(),) * 2, strict=True)], names=["dim", "part", "seq", "n", "ids", "data"])

        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            whole = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            flat = vectors.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            ends = np.cumsum(size)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            whole &= bad[ends] == bad[ends - size]
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(size[whole]):
                at = np.flatnonzero(whole & (size == dim))
                data = quantise(values[(ends[at] - dim)[:, None] + np.arange(dim)[None, :]], scale)
                for k in range(0, len(at), rows):
                    held = open_tiles.setdefault(int(dim), [])
                    held.append((ids[at[k : k + rows]], data[k : k + rows]))
                    if sum(len(x) for x, _ in held) >= rows:
                        yield close(int(dim))
        for dim in list(open_tiles):
            yield close(dim)

    return pack


class Searcher:
    """The k best of all candidate tiles seen so far, for one tile of queries."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int, block: int = 16, group: int = 16):
        self.ids, self.data, self.k, self.block, self.group = ids, data, k, block, group  # data: dimension x query
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def meet(self, ids: np.ndarray, data: np.ndarray) -> None:
        dims = len(data)
        most = dims * max(1, int(np.abs(self.data).max(initial=0))) * max(1, int(np.abs(data).max(initial=0)))
        kind = np.float64 if most < _EXACT else np.int64 if most < 2**63 else object
        x, q = data.astype(kind), self.data.astype(kind)
        cuts = [*range(0, dims, self.block), dims] if dims else [0]
        mass = lambda m: [np.square(m[c:].astype(np.float64)).sum(axis=0) for c in cuts]
        x_mass, q_mass = mass(data), mass(self.data)
        for lo in range(0, len(self.ids), self.group):
            some = slice(lo, min(lo + self.group, len(self.ids)))
            self._group(some, q[:, some], [m[some] for m in q_mass], ids, x, x_mass, cuts)

    def _group(self, some, q, q_mass, ids, x, x_mass, cuts) -> None:
        n = q.shape[1]
        floor = np.array([float(s[-1]) if len(s) == self.k else -np.inf for s, _ in self.best[some]])
        columns = np.arange(len(ids))
        part = np.zeros((n, len(ids)), dtype=q.dtype)
        alive = ids[None, :] != self.ids[some][:, None]
        for b, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
            part = part + q[start:end].T @ x[start:end][:, columns]
            rest = np.sqrt(q_mass[b][:, None] * x_mass[b][None, columns])
            near = part.astype(np.float64)
            slack = 1 + 1e-9 * (np.abs(near) + rest)
            if part.shape[1] > self.k:
                sure = np.where(alive, near - rest - slack, -np.inf)
                floor = np.maximum(floor, np.partition(sure, -self.k, axis=1)[:, -self.k])
            alive &= near + rest + slack >= floor[:, None]
            keep = alive.any(axis=0)
            if not keep.all():
                columns, part, alive = columns[keep], part[:, keep], alive[:, keep]
        for i in range(n):
            at = np.flatnonzero(alive[i])
            if not len(at):
                continue
            old_score, old_id = self.best[some.start + i]
            score = part[i, at]
            if score.dtype == object:
                if max(abs(s) for s in score) >= 2**63:
                    raise OverflowError("a score does not fit a long")
            score = np.concatenate((old_score, score.astype(np.int64)))
            who = np.concatenate((old_id, ids[columns[at]]))
            first = np.lexsort((who, -score))[: self.k]
            self.best[some.start + i] = score[first], who[first]

    def result(self) -> pa.RecordBatch:
        size = [len(s) for s, _ in self.best]
        cells = (np.repeat(self.ids, size), np.concatenate([w for _, w in self.best] or [[]]), np.concatenate([s for s, _ in self.best] or [[]]))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cells], names=["query_id", "vec_id", "score"])


def top_k(
    queries: DataFrame, rows: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
    query_tile: int = 1024, row_tile: int = 2048,
) -> DataFrame:
    """For each row of queries its k best rows: query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    Components count as floor(scale * x).  A row with the query's own id is no candidate.  Vectors (or ids) that are
    null and vectors with a null or non-finite component take no part; vectors of another length than the query's are
    no candidates of it; an empty vector scores 0.  Repeated rows each take a rank.  No row: no result.
    Memory: one tile of queries, one of rows and their products; work: queries times rows, as stated.
    """
    spark = rows.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    tiles = stage(pick(rows).mapInArrow(_packer(scale, row_tile), _TILE), "topk-rows")
    asked = pick(queries)
    asked = stage(asked.repartition(max(1, -(-asked.count() // query_tile))).mapInArrow(_packer(scale, query_tile), _TILE), "topk-queries")
    slots = max(1, min(partitions(spark), tiles.count()))
    left = asked.select("dim", F.col("n").alias("qn"), F.col("part").alias("qpart"), F.col("seq").alias("qseq"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    right = tiles.select("dim", "n", "ids", "data", F.pmod(F.col("part") + F.col("seq"), F.lit(slots)).alias("slot"))
    pairs = left.hint("merge").join(right, ["dim", "slot"]).select("dim", "qpart", "qseq", "slot", "qids", "qdata", "ids", "data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, found = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, part, seq, slot, qids, qdata, ids, data = (c[i] for c in batch.columns)
                key = (dim.as_py(), part.as_py(), seq.as_py())
                shape = lambda x, n: np.frombuffer(x.as_buffer(), "<i8").reshape(key[0], n)  # noqa: E731, B023
                if key != which:
                    if found:
                        yield found.result()
                    who = np.frombuffer(qids.as_buffer(), "<i8").copy()
                    which, found = key, Searcher(who, shape(qdata, len(who)).copy(), k)
                who = np.frombuffer(ids.as_buffer(), "<i8")
                found.meet(who, shape(data, len(who)))
        if found:
            yield found.result()

    hits = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def every_hundredth(id_col: str = "vec_id") -> Column:
    return F.pmod(F.col(id_col), F.lit(100)) == 0


def query(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return top_k(rows.filter(every_hundredth()), rows)


def oracle() -> str:
    return """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 10"""
