"""Keyed delta encoding: each version of a key's blob against the one before.

Encoding needs nothing but the previous raw blob, so it is a lag window and one Arrow UDF, all keys and versions side by
side.  Decoding is a fold over rows sorted by key and order, which holds the key's last blob and nothing else; streams
have a stateful processor (see lamina.streaming).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import deltas
from ..functions import wire as w
from ..functions.varint import decode_varint, varint_hex


def with_previous(rows: DataFrame, key: str | list[str], order_by: str, blob: str, name: str = "previous", remove: str | None = None) -> DataFrame:
    """Adds the key's blob before this one (null: the first, no key, or the key was removed before this row)."""
    keys = [key] if isinstance(key, str) else list(key)
    alone = F.when(F.col(keys[0]).isNull(), F.xxhash64(order_by))  # rows without key are no group
    lag = F.lag(blob).over(Window.partitionBy(*keys, alone).orderBy(order_by))
    known = F.col(keys[0]).isNotNull()
    return rows.withColumn(name, F.when(known & ~F.coalesce(F.col(remove), F.lit(False)) if remove else known, lag))


def _delta_udf(strict_min: bool):
    @F.pandas_udf(T.BinaryType())
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in pairs:
            yield pd.Series([None if b is None else deltas.delta(None if a is None else bytes(a), bytes(b), strict_min) for a, b in zip(old, new, strict=True)], dtype=object)

    return run


def delta_wire(previous: Column, blob: Column, strict_min: bool = False) -> Column:
    return _delta_udf(strict_min)(previous, blob)


def encode(rows: DataFrame, key: str | list[str], order_by: str, blob: str, strict_min: bool = False, remove: str | None = None) -> DataFrame:
    """Adds wire (binary) and mode.  First versions and rows without key are whole blobs, made without Python.

    key: a column, or several (an epoch beside the key clears the store).  remove: a boolean column; where true the key's
    blob is forgotten before the row.
    """
    out = with_previous(rows, key, order_by, blob, "_previous", remove)
    whole = F.unhex(F.concat(F.lit("00"), varint_hex(F.octet_length(blob)), F.hex(blob)))
    later = F.col("_previous").isNotNull()
    made = delta_wire(F.when(later, F.col("_previous")), F.when(later, F.col(blob)), strict_min)
    out = out.withColumn("wire", F.coalesce(made, whole)).drop("_previous")
    return out.withColumn("mode", mode_of(F.col("wire")))


def mode_of(wire: Column) -> Column:
    """0 whole, 1 patches, 2 exclusive-or."""
    return decode_varint(wire)["value"].cast("int")


def decode(rows: DataFrame, key: str | list[str], order_by: str, wire: str = "wire", blob: str = "blob", remove: str | None = None) -> DataFrame:
    """rows with blob instead of wire; a version without its predecessor is InvalidData.

    key and remove as given to encode().  Versions of a key are folded in order, one blob held at a time; rows without key
    are whole blobs and decoded where they lie.
    """
    keys = [key] if isinstance(key, str) else list(key)
    keep = [c for c in rows.columns if c not in (wire, blob)]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(blob, T.BinaryType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in [*keys, *([remove] if remove else []), wire]]
            for *at, data in zip(*columns, strict=True):
                forget = bool(at.pop()) if remove else False
                if at != here or forget or at[0] is None:
                    here, last = at, None
                last = deltas.apply(last, w.Reader(data))
                out.append(last)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.binary())], names=[*keep, blob])

    keyed = rows.filter(F.col(keys[0]).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, order_by).mapInArrow(fold, schema)
    return keyed.unionByName(rows.filter(F.col(keys[0]).isNull()).mapInArrow(fold, schema))


def store_stats(rows: DataFrame, key: str, order_by: str, blob: str) -> DataFrame:
    """One row: n_keys and cached_bytes of the store after all rows (the last blob of each key)."""
    last = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.octet_length(blob), F.col(order_by)).alias("n"))
    return last.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cached_bytes"))


def keys(rows: DataFrame, key: str, order_by: str, blob: str) -> DataFrame:
    """key, cached_bytes: the keys that the store holds after all rows, with the size of their last blob."""
    known = rows.filter(F.col(key).isNotNull() & F.col(blob).isNotNull())
    return known.groupBy(key).agg(F.max_by(F.octet_length(blob), F.col(order_by)).cast("long").alias("cached_bytes"))


def contains_key(rows: DataFrame, key: str, value) -> bool:
    return not rows.filter(F.col(key) == value).isEmpty()


def patch_stats(previous: Column, blob: Column) -> Column:
    """struct(changed, n_patches) of a pair of blobs: bytes that differ and the runs they are sent in, by the codec's rule."""

    @F.pandas_udf("changed long, n_patches long")
    def run(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        found = [None if a is None or b is None else deltas.differing(bytes(a), bytes(b)) for a, b in zip(old, new, strict=True)]
        return pd.DataFrame([(None, None) if at is None else (len(at), len(deltas.runs(at)[0])) for at in found], columns=["changed", "n_patches"])

    return run(previous, blob)


@F.pandas_udf(T.StringType())
def xor_hex(old: pd.Series, new: pd.Series) -> pd.Series:
    """Exclusive-or of two blobs, the shorter filled up with zeros (hex)."""
    return pd.Series([None if a is None or b is None else deltas.exclusive_or(bytes(a), bytes(b)).hex().upper() for a, b in zip(old, new, strict=True)])
