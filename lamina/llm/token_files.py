"""Token-ID output: static range asymmetric numeral system (rANS) over frames of whole documents.

A token store is a folder of three Parquet tables.  ``model``: the shared frequency table, one row per id that occurs,
frequencies summing to 2**scale.  ``frames``: one row per frame of whole documents (their ids and lengths), coded in
segments of SEGMENT tokens.  A segment is LANES interleaved 64-bit coders with a state each; the frame's directory has a
checkpoint for each segment, the word at which it starts and its first states, so that segments decode independently
and side by side.  CRC-32 of the coded words and of the ids stand beside them.  ``shards``: tokens before each shard.
Frames of a shard, and shards, follow the order of the document ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, new_folder, partitions, read_table, stage
from .tokens import MEMO, shared_tokenizer

LANES, SEGMENT = 512, 1 << 16
#: A frame is closed when it has this many tokens; a longer document makes a longer frame.
FRAME = 1 << 20
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)


class RangeModel:
    """Frequencies of ids scaled to a power of two, and the tables that coder and decoder look up."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids, self.freqs = ids.astype(np.uint32), freqs.astype(np.uint64)
        self.scale = int(self.freqs.sum()).bit_length() - 1 if len(ids) else 0
        self.cum = np.concatenate(([0], np.cumsum(self.freqs)[:-1])).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
        self.slots = np.repeat(np.arange(len(ids), dtype=np.int32), self.freqs.astype(np.int64))
        top = int(self.ids.max()) + 1 if len(ids) else 0
        self.index = np.full(top, -1, dtype=np.int32)
        self.index[self.ids] = np.arange(len(ids), dtype=np.int32)

    @classmethod
    def fit(cls, ids: np.ndarray, counts: np.ndarray, least_scale: int = 16) -> RangeModel:
        """At least 1 each, in proportion else; what rounding leaves over goes to or comes from the most frequent."""
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order].astype(np.float64)
        whole = 1 << max(least_scale, len(ids).bit_length() + 2)
        freqs = np.maximum(1, np.floor(counts * (whole / max(1.0, counts.sum())))).astype(np.int64)
        rest = whole - int(freqs.sum())
        by = np.argsort(-freqs, kind="stable")
        for i in by if len(ids) else ():
            step = rest if rest > 0 else max(rest, 1 - int(freqs[i]))
            freqs[i] += step
            rest -= step
            if not rest:
                break
        return cls(ids, freqs)


def encode_frame(model: RangeModel, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words uint32, start of each segment in words, first states: segments x LANES)."""
    segments = -(-len(ids) // SEGMENT)
    if not segments:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros((0, LANES), np.uint64)
    tail = len(ids) - (segments - 1) * SEGMENT
    symbol = np.full(segments * SEGMENT, int(np.argmax(model.freqs)), dtype=np.int32)
    symbol[: len(ids)] = model.index[ids]
    symbol = symbol.reshape(segments, SEGMENT // LANES, LANES)
    state = np.full((segments, LANES), _LOW, dtype=np.uint64)
    scale, limit = np.uint64(model.scale), np.uint64(63 - model.scale)
    out, owner = [], []
    for step in range((SEGMENT if segments > 1 else -(-tail // LANES) * LANES) // LANES - 1, -1, -1):
        live = segments if step * LANES < tail else segments - 1
        now, s = state[:live], symbol[:live, step]
        freq = model.freqs[s]
        full = now >= (freq << limit)
        out.append(now[full].astype(np.uint32))
        owner.append(full.sum(axis=1))
        now = np.where(full, now >> _WORD, now)
        quotient = now // freq
        state[:live] = (quotient << scale) + (now - quotient * freq) + model.cum[s]
    words = np.concatenate(out[::-1])
    seg = np.concatenate([np.repeat(np.arange(len(n)), n) for n in reversed(owner)])
    words = words[np.argsort(seg, kind="stable")]
    size = np.bincount(seg, minlength=segments)
    return words, np.cumsum(size) - size, state


def decode_frame(model: RangeModel, n: int, words: np.ndarray, starts: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The n ids of a frame, all segments side by side from their checkpoints."""
    segments = len(starts)
    if not segments:
        return np.zeros(0, np.uint32)
    tail = n - (segments - 1) * SEGMENT
    steps = SEGMENT // LANES
    out = np.zeros((segments, steps, LANES), dtype=np.int32)
    state, at = states.copy(), starts.astype(np.int64).copy()
    scale, mask = np.uint64(model.scale), np.uint64((1 << model.scale) - 1)
    for step in range(steps if segments > 1 else -(-tail // LANES)):
        live = segments if step * LANES < tail else segments - 1
        now = state[:live]
        slot = now & mask
        s = model.slots[slot]
        out[:live, step] = s
        now = model.freqs[s] * (now >> scale) + slot - model.cum[s]
        short = now < _LOW
        place = at[:live, None] + np.cumsum(short, axis=1)
        at[:live] = place[:, -1]
        now[short] = (now[short] << _WORD) | words[place[short] - 1]
        state[:live] = now
    return model.ids[out.reshape(-1)[:n]]


_FRAME = "shard int, frame int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>"


def _framer(path: str, end_id: int | None, width: str, top: int, memo: int):
    """Frames of whole documents; the last row of a task, frame -1, has its counts of ids below top."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, frame, first = TaskContext.get().partitionId(), 0, 0
        tokenizer = shared_tokenizer(path, memo)
        names, sizes, held, total = [], [], [], 0
        seen = np.zeros(top, dtype="<i8")

        def row(number: int, data: bytes) -> pa.RecordBatch:
            cells = [([shard], pa.int32()), ([number], pa.int32()), ([first], pa.int64()), ([total], pa.int64()), ([names], pa.list_(pa.int64())), ([sizes], pa.list_(pa.int64())), ([data], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in cells], names=["shard", "frame", "first", "n_tokens", "doc_ids", "doc_tokens", "ids"])

        def close() -> pa.RecordBatch:
            nonlocal names, sizes, held, total, frame, first
            out = row(frame, b"".join(held))
            frame, first = frame + 1, first + total
            names, sizes, held, total = [], [], [], 0
            return out

        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                some = batch.slice(low, 4096)
                ids, size = tokenizer.encode(some.column(1))
                if end_id is not None:
                    ids, size = np.insert(ids, np.cumsum(size), end_id), size + 1
                seen += np.bincount(ids, minlength=top)
                ids, ends = ids.astype(width), np.cumsum(size)
                who = some.column(0).to_pylist()
                i = 0
                while i < len(who):
                    base = ends[i - 1] if i else 0
                    j = min(len(who), int(np.searchsorted(ends, base + FRAME - total, side="left")) + 1)
                    names += who[i:j]
                    sizes += size[i:j].tolist()
                    held.append(ids[base : ends[j - 1]].tobytes())
                    total += int(ends[j - 1] - base)
                    if total >= FRAME:
                        yield close()
                    i = j
        if names:
            yield close()
        yield row(-1, seen.tobytes())

    return frames


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> None:
    """Write the ids of every whole text, end_id after each, in ascending order of the document ids, to a new folder.

    Null ids come first, rows with equal ids stay separate in any order; null texts count as empty; other columns are
    left out.  No rows: tables without rows.  One shuffle (by range of ids); memory: a frame and a memo of at
    most memo pieces.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    top = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), (end_id or 0) + 1)
    width = "<u2" if top <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id")
    staged = stage(rows.mapInArrow(_framer(tokenizer_path, end_id, width, top, memo), _FRAME + ", ids binary"), "token-frames", "zstd")
    frames = staged.filter("frame >= 0")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(top, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen += np.frombuffer(x.as_buffer(), "<i8")
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["id", "n"])

    counts = staged.filter("frame < 0").select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most one row per id of the vocabulary
    model = RangeModel.fit(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    table = [(int(i), int(f)) for i, f in zip(model.ids, model.freqs, strict=True)]
    spark.createDataFrame(table, "id long, freq long").coalesce(1).write.parquet(f"{folder}/model")
    shared = spark.sparkContext.broadcast((model.ids, model.freqs))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = RangeModel(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(6)[i].as_buffer(), width).astype("<u4")
                words, starts, states = encode_frame(held, ids)
                coded = words.astype("<u4").tobytes()
                more = [pa.array([x], t) for x, t in ((starts.tolist(), pa.list_(pa.int64())), (states.astype("<u8").tobytes(), pa.binary()), (coded, pa.binary()), (zlib.crc32(coded), pa.int64()), (zlib.crc32(ids.tobytes()), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[:6]], *more], names=[*batch.schema.names[:6], "checkpoints", "states", "words", "words_crc32", "ids_crc32"])

    coded = frames.mapInArrow(code, _FRAME + ", checkpoints array<long>, states binary, words binary, words_crc32 long, ids_crc32 long")
    coded.write.option("compression", "none").parquet(f"{folder}/frames")
    shards = frames.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    shards.withColumn("start", before).coalesce(1).write.parquet(f"{folder}/shards")  # one row per shard
    discard(spark, staged._lamina_path)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, an array) of every document of a token store; frames decode in parallel.

    A frame whose coded words or ids don't have their checksum is an error.
    """
    table = spark.read.parquet(f"{folder}/model").toPandas()
    shared = spark.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["freq"].to_numpy(np.int64)))
    kind = T.StructType([T.StructField("shard", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("doc_id", "at", "n_tokens", "ids_crc32")]])
    if with_ids:
        kind.add("ids", T.ArrayType(T.LongType()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, freqs = shared.value
        order = np.argsort(ids)
        model = RangeModel(ids[order], freqs[order])
        for batch in batches:
            for row in range(batch.num_rows):
                x = {n: batch.column(k)[row] for k, n in enumerate(batch.schema.names)}
                words = x["words"].as_buffer()
                if zlib.crc32(words) != x["words_crc32"].as_py():
                    raise ValueError("the coded words of a frame don't have their checksum")
                states = np.frombuffer(x["states"].as_buffer(), "<u8").reshape(-1, LANES)
                found = decode_frame(model, x["n_tokens"].as_py(), np.frombuffer(words, "<u4"), x["checkpoints"].values.to_numpy(), states).astype("<u4")
                if zlib.crc32(found.tobytes()) != x["ids_crc32"].as_py():
                    raise ValueError("the decoded ids of a frame don't have their checksum")
                size = x["doc_tokens"].values.to_numpy()
                ends = np.cumsum(size)
                view = memoryview(found).cast("B")
                crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
                cells = [pa.array(np.full(len(size), x["shard"].as_py(), np.int32)), x["doc_ids"].values, pa.array(ends - size + x["first"].as_py()), pa.array(size), pa.array(crc, pa.int64())]
                if with_ids:
                    cells.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(found.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cells, names=kind.names)

    columns = ["shard", "first", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "states", "words", "words_crc32", "ids_crc32"]
    docs = spark.read.parquet(f"{folder}/frames").select(*columns).mapInArrow(decode, kind)
    shards = spark.read.parquet(f"{folder}/shards").select("shard", F.col("start").alias("before"))
    out = docs.join(F.broadcast(shards), "shard")  # a row per shard: as many as tasks wrote the store
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-store")
    write_tokens(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, folder, with_ids=False)
