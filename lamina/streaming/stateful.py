"""Dictionary and delta codecs over streams: keyed state through applyInPandasWithState.

Rows of a key inside a micro-batch are put in order before they are folded.  A row at or before the last one seen is late:
an error, never dropped.  With timeout_ms the state of an idle key is cleared (a slot boundary).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import deltas
from ..functions import wire as w


def _ordered(parts: Iterator[pd.DataFrame], order_by: str, last) -> pd.DataFrame:
    rows = pd.concat(list(parts)).sort_values(order_by, kind="stable")
    if last is not None and len(rows) and rows[order_by].iloc[0] <= last:
        raise w.InvalidData("a late row: its place in the order has passed")
    return rows


def _timeout(timeout_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout


def encode_deltas(stream: DataFrame, key: str, order_by: str, blob: str, timeout_ms: int | None = None) -> DataFrame:
    """key, order_by, wire of each row; the state is the key's last blob."""
    schema = T.StructType([stream.schema[key], stream.schema[order_by], T.StructField("wire", T.BinaryType())])

    def step(_, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, at = state.get if state.exists else (None, None)
        rows = _ordered(parts, order_by, at)
        out = []
        for data in rows[blob]:
            data = bytes(data)
            out.append(deltas.delta(last, data))
            last = data
        state.update((last, int(rows[order_by].iloc[-1])))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield rows[[key, order_by]].assign(wire=out)

    return stream.groupBy(key).applyInPandasWithState(step, schema, "blob binary, at long", "append", _timeout(timeout_ms))


def decode_deltas(stream: DataFrame, key: str, order_by: str, wire: str = "wire", timeout_ms: int | None = None) -> DataFrame:
    """key, order_by, blob of each row; a version without its predecessor is InvalidData."""
    schema = T.StructType([stream.schema[key], stream.schema[order_by], T.StructField("blob", T.BinaryType())])

    def step(_, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, at = state.get if state.exists else (None, None)
        last = None if last is None else bytes(last)
        rows = _ordered(parts, order_by, at)
        out = []
        for data in rows[wire]:
            last = deltas.apply(last, w.Reader(bytes(data)))
            out.append(last)
        state.update((last, int(rows[order_by].iloc[-1])))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield rows[[key, order_by]].assign(blob=out)

    return stream.groupBy(key).applyInPandasWithState(step, schema, "blob binary, at long", "append", _timeout(timeout_ms))


def _dictionary(stream: DataFrame, scope: str, order_by: str, columns: list[T.StructField], value: T.DataType, timeout_ms: int | None, frozen, work) -> DataFrame:
    """Folds rows with the scope's values in order of id as state; work(row, ids, values) gives the columns' cells."""
    frozen = list(dict.fromkeys(frozen or []))  # the same in every task and never in the state
    schema = T.StructType([stream.schema[scope], stream.schema[order_by], *columns])
    state_schema = T.StructType([T.StructField("vals", T.ArrayType(value)), T.StructField("at", T.LongType())])

    def step(_, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        own, at = state.get if state.exists else ([], None)
        values = [*frozen, *own]
        ids = {v: i for i, v in enumerate(values, 1)}
        rows = _ordered(parts, order_by, at)
        cells = list(zip(*[work(row, ids, values) for row in rows.to_dict("records")], strict=True))
        state.update((values[len(frozen) :], int(rows[order_by].iloc[-1])))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield rows[[scope, order_by]].assign(**{c.name: pd.Series(x, index=rows.index, dtype=object) for c, x in zip(columns, cells, strict=True)})

    return stream.groupBy(scope).applyInPandasWithState(step, schema, state_schema, "append", _timeout(timeout_ms))


def encode_dictionary(stream: DataFrame, scope: str, order_by: str, value: str, timeout_ms: int | None = None, frozen: list | None = None) -> DataFrame:
    """scope, order_by, value, wire_id of each row: one dictionary per scope; the state is its values in order of id.

    frozen: values that every scope knows from the start, with the first ids; clearing a scope keeps them.
    """

    def work(row, ids, values):
        v = row[value]
        known = ids.get(v, 0)
        if not known:
            values.append(v)
            ids[v] = len(values)
        return v, known

    return _dictionary(stream, scope, order_by, [stream.schema[value], T.StructField("wire_id", T.LongType())], stream.schema[value].dataType, timeout_ms, frozen, work)


def decode_dictionary(stream: DataFrame, scope: str, order_by: str, value: str, wire_id: str = "wire_id", timeout_ms: int | None = None, frozen: list | None = None) -> DataFrame:
    """scope, order_by, value of each row: value is given where wire_id is 0 and looked up elsewhere; an unknown id is
    InvalidData.  Inverse of encode_dictionary with the same frozen values."""

    def work(row, ids, values):
        number = int(row[wire_id])
        if number == 0:
            values.append(row[value])
            return (row[value],)
        if not 1 <= number <= len(values):
            raise w.InvalidData("an id without a value")
        return (values[number - 1],)

    return _dictionary(stream, scope, order_by, [stream.schema[value]], stream.schema[value].dataType, timeout_ms, frozen, work)
