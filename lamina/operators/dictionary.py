"""Dictionary (dedupe) encoding as windows, aggregates and joins.

A stream is a DataFrame with an order column (unique within a scope) and optional scope columns (a scope is a stream of
its own: clearing is a new epoch in the scope).  The first occurrence of a value gets the next id, from 1, in one
counter for all types; its wire id is 0 and its packed bytes follow; later occurrences are the id alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.varint import varint_hex, varint_len

#: A frozen dictionary of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _coarse(order: Column, kind: T.DataType) -> Column | None:
    """A number that never falls where the order rises; None: not known for the type."""
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.FractionalType)):
        return order
    if isinstance(kind, T.DateType):
        return F.datediff(order, F.lit("1970-01-01").cast("date"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(order)
    if isinstance(kind, (T.StringType, T.BinaryType)):  # the first seven bytes
        return F.conv(F.rpad(F.hex(F.substring(order.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    if isinstance(kind, T.StructType) and len(kind):
        return _coarse(order[kind[0].name], kind[0].dataType)
    return None


def _number(first: DataFrame, order_by: str, name: str, base: Column, parts: int = 64) -> DataFrame:
    """Adds 1, 2, ... + base in order over the whole table.

    The order, or a number that follows it, is cut at approximate percentiles into ranges that are numbered side by side,
    each from the count of the ranges before it; only orders of other types (arrays) are numbered by one window.
    """
    coarse = _coarse(F.col(order_by), first.schema[order_by].dataType)
    if coarse is None:
        return first.withColumn(name, F.row_number().over(Window.orderBy(order_by)).cast("long") + base)
    cuts = first.agg(F.percentile_approx(coarse, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    ranged = first.withColumn("_range", sum(((coarse >= F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0)))
    ranged = ranged.withColumn("_range", F.coalesce("_range", F.lit(-1)))  # nulls come first
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", before.alias("_before"))  # at most `parts` rows
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(order_by)))
    return inside.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_in") + F.col("_before") + base).drop("_range", "_in", "_before")


def prime(values: DataFrame, order_by: str, value: str, type_col: str | None = None) -> DataFrame:
    """A dictionary (type, value, id) from a list of values in order; repeats keep their first place.

    Ids are given to the distinct values alone: the window that numbers them sees one row for each.
    """
    kind = F.col(type_col) if type_col else F.lit("")
    first = values.select(kind.alias("type"), F.col(value).alias("value"), F.col(order_by).alias("_at")).groupBy("type", "value").agg(F.min("_at").alias("_at"))
    return _number(first, "_at", "id", F.lit(0).cast("long")).select("type", "value", "id")


def encode(stream: DataFrame, value: str, order_by: str, scope: list[str] | None = None, type_col: str | None = None, frozen: DataFrame | None = None, epoch: str | None = None) -> DataFrame:
    """Adds id (the dictionary's), wire_id (0 for a first occurrence, else the id) and is_new to every row.

    Within scopes a window per scope numbers the first occurrences.  A stream without scope is numbered over its distinct
    values alone (aggregate, rank, join back), so that no window ever holds the whole stream.  Values of the frozen
    dictionary (type, value, id) are known from the start and never enter the numbering.  epoch (see clear_type_epochs):
    a value is new again in each epoch of its type, while ids go on.
    """
    scope = list(scope or [])
    kind = [c for c in (type_col, epoch) if c]
    rows = stream
    base = F.lit(0).cast("long")
    if frozen is not None:
        known = frozen.select(F.col("type").alias("_ft"), F.col("value").alias("_fv"), F.col("id").alias("_fid"))
        test = rows[value].eqNullSafe(known["_fv"])
        test = test & ((rows[type_col] == known["_ft"]) if type_col else (known["_ft"] == ""))
        rows = rows.join(_small(known), test, "left").drop("_ft", "_fv")
        base = F.lit(frozen.agg(F.max("id")).first()[0] or 0).cast("long")
        fresh = rows.filter("_fid is null")
    else:
        rows = rows.withColumn("_fid", F.lit(None).cast("long"))
        fresh = rows
    keys = [*scope, *kind, value]
    first = fresh.groupBy(*keys).agg(F.min(order_by).alias("_first"))
    if scope:
        ranked = first.withColumn("_own", F.row_number().over(Window.partitionBy(*scope).orderBy("_first")).cast("long") + base)
    else:
        ranked = _number(first, "_first", "_own", base)
    ranked = ranked.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    out = rows.join(ranked, reduce(lambda a, b: a & b, [rows[k].eqNullSafe(ranked[f"_k_{k}"]) for k in keys]) & rows["_fid"].isNull(), "left").drop(*[f"_k_{k}" for k in keys])
    new = F.col("_fid").isNull() & (F.col(order_by) == F.col("_first"))
    number = F.coalesce("_fid", "_own")
    return out.select(*stream.columns, number.alias("id"), F.when(new, F.lit(0).cast("long")).otherwise(number).alias("wire_id"), new.alias("is_new"))


def wire(encoded: DataFrame, packed_hex: Column) -> Column:
    """Wire form (hex) of an encoded row; packed_hex is the value's fixed-width form."""
    return F.when(F.col("is_new"), F.concat(F.lit("00"), packed_hex)).otherwise(varint_hex(F.col("wire_id")))


def wire_size(packed_width: Column | int) -> Column:
    width = packed_width if isinstance(packed_width, Column) else F.lit(packed_width)
    return F.when(F.col("is_new"), width + 1).otherwise(varint_len(F.col("wire_id")))


def decode(stream: DataFrame, value: str, order_by: str, scope: list[str] | None = None, type_col: str | None = None, frozen: DataFrame | None = None) -> DataFrame:
    """Fills value on rows of a wire stream: wire_id, and value where wire_id is 0.  An unknown id is InvalidData.

    The dictionary is global over types: rows with wire_id 0 numbered in order, scope by scope.  An id counts as known
    only if its value stands earlier, and, with type_col, has the row's type.
    """
    scope = list(scope or [])
    base = F.lit((frozen.agg(F.max("id")).first()[0] or 0) if frozen is not None else 0).cast("long")
    kind = F.col(type_col) if type_col else F.lit("")
    new = stream.filter("wire_id = 0")
    if scope:
        new = new.withColumn("_id", F.row_number().over(Window.partitionBy(*scope).orderBy(order_by)).cast("long") + base)
    else:
        new = _number(new, order_by, "_id", base)
    dictionary = new.select(*scope, "_id", kind.alias("_type"), F.col(value).alias("_value"), F.col(order_by).alias("_since"))
    dictionary = dictionary.withColumnsRenamed({k: f"_k_{k}" for k in scope})
    # first occurrences carry their value; only the others look theirs up, so 0 is no key of the join
    later = stream.filter("wire_id <> 0")
    test = reduce(lambda a, b: a & b, [later[k].eqNullSafe(dictionary[f"_k_{k}"]) for k in scope], (later["wire_id"] == dictionary["_id"]) & (later[order_by] > dictionary["_since"]))
    if type_col:
        test = test & (later[type_col] == dictionary["_type"])
    out = later.join(dictionary, test, "left").drop(*[f"_k_{k}" for k in scope])
    found, known = F.col("_value"), F.col("_since").isNotNull()
    if frozen is not None:
        old = frozen.select(F.col("id").alias("_fid"), F.col("type").alias("_ft"), F.col("value").alias("_fv"))
        same = out["wire_id"] == old["_fid"]
        out = out.join(_small(old), same & (out[type_col] == old["_ft"]) if type_col else same, "left")
        found, known = F.coalesce("_fv", "_value"), known | F.col("_fid").isNotNull()
    result = F.when(known, found).otherwise(F.raise_error(F.lit("InvalidData: an id without a value")))
    filled = out.select(*[result.alias(c) if c == value else F.col(c) for c in stream.columns])
    return stream.filter("wire_id = 0").unionByName(filled)


def dictionary_of(encoded: DataFrame, value: str, scope: list[str] | None = None, type_col: str | None = None) -> DataFrame:
    """scope, type, value, id of the values that an encoded stream added."""
    kind = F.col(type_col) if type_col else F.lit("")
    return encoded.filter("is_new").select(*(scope or []), kind.alias("type"), F.col(value).alias("value"), "id")


def stats(dictionary: DataFrame, scope: list[str] | None = None, width: Column | int = 8) -> DataFrame:
    """Per scope: n_values, n_types, n_bytes (packed)."""
    size = width if isinstance(width, Column) else F.lit(width)
    return dictionary.groupBy(*(scope or [])).agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("type").alias("n_types"), F.sum(size).cast("long").alias("n_bytes"))


def stats_by_type(dictionary: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per scope and type: n_values, least and greatest id."""
    return dictionary.groupBy(*(scope or []), "type").agg(F.count(F.lit(1)).alias("n_values"), F.min("id").alias("least_id"), F.max("id").alias("greatest_id"))


def size(dictionary: DataFrame) -> int:
    """Values in a dictionary, a frozen one included; 0: it is empty."""
    return dictionary.count()


def values_for_type(dictionary: DataFrame, kind: str) -> DataFrame:
    return dictionary.filter(F.col("type") == kind).select("id", "value")


def clear_type_epochs(stream: DataFrame, order_by: str, clear: str, scope: list[str] | None = None, type_col: str | None = None) -> DataFrame:
    """Adds epoch: how many rows marked by the boolean column clear stand at or before each row of its scope and type.

    For encode(..., epoch="epoch").  Without scope and type the marked rows alone, which are few, are numbered.
    """
    keys = [*(scope or []), *([type_col] if type_col else [])]
    if keys:
        window = Window.partitionBy(*keys).orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
        return stream.withColumn("epoch", F.sum(F.col(clear).cast("int")).over(window))
    marks = stream.filter(F.col(clear)).agg(F.array_sort(F.collect_list(order_by)).alias("_marks"))  # one row: the clearings
    return stream.crossJoin(F.broadcast(marks)).withColumn("epoch", F.size(F.filter("_marks", lambda m: m <= F.col(order_by)))).drop("_marks")


def encode_nested(rows: DataFrame, array_col: str, order_by: str, scope: list[str] | None = None) -> DataFrame:
    """Dictionary-encode the elements of an array column in row and element order: adds wire_ids, array(wire_id)."""
    scope = list(scope or [])
    leaves = rows.select(*scope, order_by, F.posexplode(array_col).alias("_i", "_leaf")).withColumn("_pos", F.struct(order_by, "_i"))
    done = encode(leaves, "_leaf", "_pos", scope).groupBy(order_by, *scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "wire_id"))), lambda x: x["wire_id"]).alias("wire_ids"))
    done = done.withColumnsRenamed({k: f"_k_{k}" for k in [order_by, *scope]})
    test = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(done[f"_k_{k}"]) for k in [order_by, *scope]])
    return rows.join(done, test, "left").select(*rows.columns, F.coalesce("wire_ids", F.array().cast("array<bigint>")).alias("wire_ids"))
