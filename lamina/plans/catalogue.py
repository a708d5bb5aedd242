"""The named queries over the driver's tables, each with the SQL that must give the same rows.

Wire bytes are upper-case hexadecimal text.  Compressed bytes depend on the compressor's version, so queries that compress
give the identity of a round trip together with columns that SQL can check; the bytes are pinned by tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import varint as v
from ..functions import wide
from ..functions import wire as w
from ..operators import columns, delta, dictionary, flagged, records, structural

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the same rules in DuckDB SQL


def _pairs(x: str) -> str:
    return f"array_to_string(list_reverse(regexp_extract_all({x}, '..')), '')"


def _even(x: str) -> str:
    """Hex digits of a number, an even count."""
    return f"CASE WHEN length(to_hex({x})) % 2 = 1 THEN '0' || to_hex({x}) ELSE to_hex({x}) END"


def _varint(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN 0 AND 127 THEN lpad(to_hex({x}), 2, '0') ELSE to_hex(128 + ((length(to_hex({x})) + 1) // 2)) || {_pairs(_even(x))} END"


def _varint_len(x: str) -> str:
    return f"(CASE WHEN {x} BETWEEN 0 AND 127 THEN 1 ELSE 1 + (length(to_hex({x})) + 1) // 2 END)"


def _le8(x: str) -> str:
    return _pairs(f"lpad(to_hex({x}), 16, '0')")


def _zigzag(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 2 * {x} ELSE -2 * {x} - 1 END)"


def _signed(x: str) -> str:
    return _varint(_zigzag(x))


def _text(x: str) -> str:
    """Raw flagged form of a short string."""
    return f"({_varint(f'(2 * octet_length(encode({x})))')}) || hex(encode({x}))"


# ---- integers


@_query(f"SELECT o_orderkey, {_varint('o_orderkey')} AS wire_hex, {_varint_len('o_orderkey')}::INTEGER AS wire_len FROM orders")
def varint_orderkey(spark, sf_dir):
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select("o_orderkey", v.varint_hex(key).alias("wire_hex"), v.varint_len(key).alias("wire_len"))


@_query(f"SELECT {_varint_len('l_partkey')}::INTEGER AS wire_len, count(*) AS n, sum({_varint_len('l_partkey')})::BIGINT AS wire_bytes FROM lineitem GROUP BY ALL")
def varint_width_histogram(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(v.varint_len(F.col("l_partkey")).alias("wire_len"))
    return rows.groupBy("wire_len").agg(F.count(F.lit(1)).alias("n"), F.sum("wire_len").alias("wire_bytes"))


@_query(f"SELECT o_orderkey, {_varint('(o_orderkey * 1000003)')} AS wire_hex, o_orderkey * 1000003 AS decoded, {_varint_len('(o_orderkey * 1000003)')}::INTEGER AS next_offset FROM orders")
def varint_decode_roundtrip(spark, sf_dir):
    value = F.col("o_orderkey") * 1000003
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", v.varint_hex(value).alias("wire_hex")).withColumn("d", v.decode_varint(F.unhex("wire_hex")))
    return rows.select("o_orderkey", "wire_hex", F.col("d.value").alias("decoded"), F.col("d.next_offset").alias("next_offset"))


_CENTS = "CAST(round(c_acctbal * 100) AS BIGINT)"


@_query(f"SELECT c_custkey, {_CENTS} AS cents, {_zigzag(_CENTS)} AS zigzag, {_signed(_CENTS)} AS wire_hex, {_CENTS} AS back FROM customer")
def zigzag_acctbal_cents(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    z = v.zigzag(F.col("cents"))
    return rows.select("c_custkey", "cents", z.alias("zigzag"), v.int_wire(F.col("cents")).alias("wire_hex"), v.zigzag_inverse(z).alias("back"))


@_query(f"""SELECT event_id, CASE WHEN value > 100 THEN '01' ELSE '00' END AS flag_hex,
  CASE WHEN value > 100 THEN '01' || {_varint('event_id')} ELSE '00' END AS option_hex FROM events""")
def bool_option_codec(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 100, F.col("event_id")).alias("x"))
    flag = v.bool_wire(F.col("x").isNotNull())
    return rows.select("event_id", flag.alias("flag_hex"), structural.wire_hex(F.col("x"), T.LongType(), True, {"unsigned": True}).alias("option_hex"))


@_query(f"SELECT o_orderkey, {_le8('o_orderkey')} || {_le8('o_custkey')} AS packed_hex, o_custkey AS unpacked FROM orders")
def pack_fixed_le(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.concat(v.pack_int(F.col("o_orderkey")), v.pack_int(F.col("o_custkey"))).alias("packed_hex"))
    return rows.withColumn("unpacked", v.unpack_int(F.substring(F.unhex("packed_hex"), 9, 8)))


@_query(f"SELECT o_orderkey, {_pairs('hex(o_totalprice::BIT::BLOB)')} AS float_hex FROM orders")
def float_bits_le(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", structural.float_hex(F.col("o_totalprice")).alias("float_hex"))


@_query(f"SELECT p_partkey, (p_size % 256)::INTEGER AS size_u8, lpad(to_hex(p_size % 256), 2, '0') AS u8_hex, p_partkey + 1 AS nonzero_key, {_varint('(p_partkey + 1)')} AS nonzero_hex FROM part")
def byte_and_nonzero(spark, sf_dir):
    rows = _read(spark, sf_dir, "part")
    small = F.pmod(F.col("p_size"), F.lit(256))
    key = v.nonzero(F.col("p_partkey") + 1)
    return rows.select("p_partkey", small.alias("size_u8"), v.uint_wire(small, 8).alias("u8_hex"), key.alias("nonzero_key"), v.varint_hex(key).alias("nonzero_hex"))


# ---- structures


def _plain(df: DataFrame) -> T.StructType:
    """The schema with no field nullable and integers unsigned."""
    return T.StructType([T.StructField(f.name, f.dataType, False, {"unsigned": True}) for f in df.schema])


@_query(f"SELECT n_nationkey, {_varint('n_nationkey')} || {_text('n_name')} || {_varint('n_regionkey')} AS wire_hex FROM nation")
def struct_codec_nation(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return rows.select("n_nationkey", structural.wire_hex(F.struct(*rows.columns), _plain(rows)).alias("wire_hex"))


@_query("""SELECT event_id, lpad(to_hex(CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'refund' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END), 2, '0')
  || CASE WHEN event_type = 'purchase' THEN """ + _varint("user_id") + """ ELSE '' END AS wire_hex FROM events""")  # fmt: skip
def enum_event_type(spark, sf_dir):
    rows = _read(spark, sf_dir, "events")
    tag = F.when(F.col("event_type").isin("click", "purchase", "refund", "signup"), F.col("event_type")).otherwise("other")
    body = structural.T.StructType([T.StructField("user_id", T.LongType(), False, {"unsigned": True})])
    variants = {"click": None, "purchase": (F.struct("user_id"), body), "refund": None, "signup": None, "other": None}
    return rows.select("event_id", structural.enum_hex(tag, variants).alias("wire_hex"))


@_query(f"""SELECT o_custkey, len(keys)::INTEGER AS n, {_varint('len(keys)')} || array_to_string(list_transform(keys, lambda x: {_varint('x')}), '') AS wire_hex
FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY o_custkey)""")
def array_codec_custorders(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    wire = structural.wire_hex(F.col("keys"), T.ArrayType(T.LongType(), False), False, {"unsigned": True})
    return rows.select("o_custkey", F.size("keys").alias("n"), wire.alias("wire_hex"))


@_query(f"""SELECT o_custkey, {_varint('len(p)')} || array_to_string(list_transform(p, lambda x: {_text('x.s')} || {_signed('x.n')}), '') AS wire_hex
FROM (SELECT o_custkey, list_sort(list({{'s': s, 'n': n}})) AS p FROM (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey)""")
def map_codec_status_counts(spark, sf_dir):
    counts = _read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return rows.select("o_custkey", structural.wire_hex(F.col("m"), T.MapType(T.StringType(), T.LongType(), False)).alias("wire_hex"))


@_query("""SELECT vec_id, len(embedding)::INTEGER AS n, (CASE WHEN len(embedding) <= 127 THEN 1 ELSE 1 + (length(to_hex(len(embedding))) + 1) // 2 END + 4 * len(embedding))::INTEGER AS wire_len, true AS same FROM embeddings""")
def array_codec_embeddings(spark, sf_dir):
    kind = T.ArrayType(T.FloatType(), False)
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.unhex(structural.wire_hex(F.col("embedding"), kind)).alias("wire"))
    back = structural.decode_column(F.col("wire"), kind)
    return rows.select("vec_id", F.size("embedding").alias("n"), F.octet_length("wire").alias("wire_len"), (back == F.col("embedding")).alias("same"))


@_query(f"""SELECT o_orderkey, '01' || {_varint('o_orderkey')} || '01' || {_varint('o_custkey')} || '01' || {_text('o_orderstatus')} AS wire_hex,
  o_orderkey AS key_back, o_custkey AS cust_back, o_orderstatus AS status_back FROM orders""")
def struct_roundtrip_orders(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    kind = T.StructType([T.StructField(f.name, f.dataType, True, {"unsigned": True}) for f in rows.schema])
    rows = rows.select("o_orderkey", structural.wire_hex(F.struct(*rows.columns), kind).alias("wire_hex"))
    rows = rows.withColumn("d", structural.decode_column(F.unhex("wire_hex"), kind))
    return rows.select("o_orderkey", "wire_hex", F.col("d.o_orderkey").alias("key_back"), F.col("d.o_custkey").alias("cust_back"), F.col("d.o_orderstatus").alias("status_back"))


@_query("SELECT o_custkey, o_orderkey AS value, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS position FROM orders")
def stream_decode(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", v.int_wire(F.col("o_orderkey")).alias("h")))).alias("a"))
    wire = rows.select("o_custkey", F.unhex(F.array_join(F.transform("a", lambda x: x["h"]), "")).alias("wire"))
    return structural.decode_stream(wire, T.LongType()).select("o_custkey", "value", "position")


# ---- flagged bytes

_GATE = """(octet_length(b) >= 32 AND (list_max(list_transform(p[1:8], lambda x: ('0x' || x)::INTEGER)) - list_min(list_transform(p[1:8], lambda x: ('0x' || x)::INTEGER)) > 200
  OR len(list_distinct(p)) >= 28))"""


@_query(f"""SELECT doc_id, octet_length(b)::INTEGER AS n_bytes, {_GATE} AS gate, octet_length(b) >= 64 AND NOT {_GATE} AS tried
FROM (SELECT doc_id, encode(text) AS b, regexp_extract_all(left(hex(encode(text)), 64), '..') AS p FROM documents)""")
def entropy_gate_documents(spark, sf_dir):
    data = F.col("text").cast("binary")
    return _read(spark, sf_dir, "documents").select("doc_id", F.octet_length(data).alias("n_bytes"), flagged.looks_incompressible(data).alias("gate"), flagged.compressible(data).alias("tried"))


@_query(f"""SELECT 'region' AS t, r_regionkey::BIGINT AS k, {_text('r_name')} AS wire_hex FROM region UNION ALL SELECT 'nation', n_nationkey, {_text('n_name')} FROM nation
UNION ALL SELECT 'part', p_partkey, {_text('p_name')} FROM part WHERE octet_length(encode(p_name)) < 64""")
def flagged_short_raw(spark, sf_dir):
    one = lambda t, k, n: _read(spark, sf_dir, t).select(F.lit(t).alias("t"), F.col(k).cast("long").alias("k"), F.col(n).alias("x"))
    rows = one("region", "r_regionkey", "r_name").union(one("nation", "n_nationkey", "n_name")).union(one("part", "p_partkey", "p_name")).filter(F.octet_length("x") < 64)
    return rows.select("t", "k", flagged.flagged_hex(F.col("x"), True).alias("wire_hex"))


@_query("""SELECT t, k, octet_length(encode(x))::INTEGER AS raw_len, true AS same, true AS not_longer FROM (
  SELECT 'documents' AS t, doc_id AS k, text AS x FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations)""")
def flagged_text_roundtrip(spark, sf_dir):
    one = lambda t, k, n: _read(spark, sf_dir, t).select(F.lit(t).alias("t"), k.alias("k"), F.col(n).alias("x"))
    rows = one("documents", F.col("doc_id"), "text").union(one("pages", F.col("page_id"), "html")).union(one("conversations", F.col("conv_id") * 1000 + F.col("turn"), "text"))
    rows = rows.withColumn("wire", flagged.flagged(F.col("x"), True))
    size = F.octet_length("x")
    return rows.select("t", "k", size.alias("raw_len"), (flagged.read_flagged(F.col("wire"), True) == F.col("x")).alias("same"), (F.octet_length("wire") <= size + v.varint_len(size.cast("long") * 2)).alias("not_longer"))


@_query(f"""SELECT lang, count(*) AS n, sum(octet_length(b))::BIGINT AS raw_bytes, sum((octet_length(b) >= 64 AND NOT {_GATE})::INTEGER)::BIGINT AS n_tried, true AS not_longer
FROM (SELECT lang, encode(text) AS b, regexp_extract_all(left(hex(encode(text)), 64), '..') AS p FROM documents) GROUP BY lang""")
def flagged_size_report(spark, sf_dir):
    """Sizes depend on the compressor's version; what SQL can say is that none grows and only what was tried shrinks."""
    data = F.col("text").cast("binary")
    rows = _read(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("raw"), flagged.compressible(data).alias("tried"), flagged.flagged(F.col("text"), True).alias("wire"))
    head = F.col("raw") + flagged.flagged_header_len(F.col("raw"))
    right = F.when(flagged.is_compressed(F.col("wire")), F.col("tried") & (F.octet_length("wire") < head)).otherwise(F.octet_length("wire") == head)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raw_bytes"), F.sum(F.col("tried").cast("long")).alias("n_tried"), F.bool_and(right).alias("not_longer"))


# ---- dictionary

_DEDUPE = """WITH f AS (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS fp FROM orders),
d AS (SELECT *, dense_rank() OVER (ORDER BY fp) AS id FROM f), e AS (SELECT *, CASE WHEN fp = o_orderkey THEN 0 ELSE id END AS wire_id FROM d)"""


def _encoded_orders(spark, sf_dir):
    return dictionary.encode(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@_query(f"""{_DEDUPE} SELECT o_orderkey, o_custkey, id, wire_id, CASE WHEN wire_id = 0 THEN '00' || {_le8('o_custkey')} ELSE {_varint('wire_id')} END AS wire_hex,
  (CASE WHEN wire_id = 0 THEN 9 ELSE {_varint_len('wire_id')} END)::INTEGER AS wire_len, {_varint_len('o_custkey')}::INTEGER AS plain_len FROM e""")
def dedupe_encode_custkey(spark, sf_dir):
    rows = _encoded_orders(spark, sf_dir)
    return rows.select("o_orderkey", "o_custkey", "id", "wire_id", dictionary.wire(rows, v.pack_int(F.col("o_custkey"))).alias("wire_hex"), dictionary.wire_size(8).alias("wire_len"), v.varint_len(F.col("o_custkey")).alias("plain_len"))


@_query(f"{_DEDUPE} SELECT o_orderkey, wire_id, o_custkey FROM e")
def dedupe_decode_custkey(spark, sf_dir):
    wire = _encoded_orders(spark, sf_dir).select("o_orderkey", "wire_id", F.when(F.col("is_new"), F.col("o_custkey")).alias("o_custkey"))
    return dictionary.decode(wire, "o_custkey", "o_orderkey").select("o_orderkey", "wire_id", "o_custkey")


_PRIMED = """WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS fid FROM customer WHERE c_custkey <= 100),
f AS (SELECT o.*, fid, CASE WHEN fid IS NULL THEN min(o_orderkey) OVER (PARTITION BY o_custkey) END AS fp FROM orders o LEFT JOIN p ON o_custkey = c_custkey),
d AS (SELECT *, CASE WHEN fid IS NULL THEN (SELECT count(*) FROM p) + dense_rank() OVER (ORDER BY fp NULLS LAST) ELSE fid END AS id FROM f)"""


@_query(f"{_PRIMED} SELECT o_orderkey, o_custkey, id, CASE WHEN fp = o_orderkey THEN 0 ELSE id END AS wire_id, o_custkey AS decoded FROM d")
def dedupe_primed(spark, sf_dir):
    frozen = dictionary.prime(_read(spark, sf_dir, "customer").filter("c_custkey <= 100"), "c_custkey", "c_custkey")
    rows = dictionary.encode(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", frozen=frozen)
    wire = rows.select("o_orderkey", "o_custkey", "id", "wire_id", F.when(F.col("is_new"), F.col("o_custkey")).alias("decoded"))
    return dictionary.decode(wire, "decoded", "o_orderkey", frozen=frozen)


@_query("""WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS epoch FROM events), f AS (SELECT *, min(event_id) OVER (PARTITION BY epoch, user_id) AS fp FROM e)
SELECT epoch, event_id, user_id, CASE WHEN fp = event_id THEN 0 ELSE dense_rank() OVER (PARTITION BY epoch ORDER BY fp) END AS wire_id FROM f""")
def dedupe_epoch_clear(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("epoch"), "event_id", "user_id")
    return dictionary.encode(rows, "user_id", "event_id", ["epoch"]).select("epoch", "event_id", "user_id", "wire_id")


_MIXED = """WITH s AS (SELECT 2 * event_id AS pos, 'user' AS t, user_id::VARCHAR AS x FROM events UNION ALL SELECT 2 * event_id + 1, 'type', event_type FROM events),
f AS (SELECT *, min(pos) OVER (PARTITION BY t, x) AS fp FROM s), d AS (SELECT *, dense_rank() OVER (ORDER BY fp) AS id FROM f)"""


def _mixed_stream(spark, sf_dir):
    rows = _read(spark, sf_dir, "events")
    users = rows.select((F.col("event_id") * 2).alias("pos"), F.lit("user").alias("t"), F.col("user_id").cast("string").alias("x"))
    return users.union(rows.select((F.col("event_id") * 2 + 1).alias("pos"), F.lit("type").alias("t"), F.col("event_type").alias("x")))


@_query(f"{_MIXED} SELECT pos, t, CASE WHEN fp = pos THEN 0 ELSE id END AS wire_id, x AS decoded FROM d")
def dedupe_mixed_types(spark, sf_dir):
    rows = dictionary.encode(_mixed_stream(spark, sf_dir), "x", "pos", type_col="t")
    wire = rows.select("pos", "t", "wire_id", F.when(F.col("is_new"), F.col("x")).alias("decoded"))
    return dictionary.decode(wire, "decoded", "pos", type_col="t")


@_query(f"{_MIXED} SELECT t AS type, count(*) AS n_values, min(id) AS least_id, max(id) AS greatest_id FROM d WHERE fp = pos GROUP BY t")
def dedupe_stats(spark, sf_dir):
    rows = dictionary.encode(_mixed_stream(spark, sf_dir), "x", "pos", type_col="t")
    return dictionary.stats_by_type(dictionary.dictionary_of(rows, "x", type_col="t"))


@_query(f"{_DEDUPE} SELECT count(*) AS n, count(*) FILTER (wire_id = 0) AS n_new, sum(CASE WHEN wire_id = 0 THEN 9 ELSE {_varint_len('wire_id')} END)::BIGINT AS dedupe_bytes, sum({_varint_len('o_custkey')})::BIGINT AS varint_bytes, (8 * count(*))::BIGINT AS packed_bytes FROM e")
def dedupe_savings(spark, sf_dir):
    rows = _encoded_orders(spark, sf_dir)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_new").cast("long")).alias("n_new"), F.sum(dictionary.wire_size(8)).alias("dedupe_bytes"),
        F.sum(v.varint_len(F.col("o_custkey"))).alias("varint_bytes"), (F.count(F.lit(1)) * 8).alias("packed_bytes"),
    )


@_query("""WITH l AS (SELECT o_custkey, o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS x, unnest([0, 1]) AS i FROM orders),
f AS (SELECT *, min(o_orderkey * 2 + i) OVER (PARTITION BY o_custkey, x) AS fp FROM l), d AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY fp) AS id FROM f)
SELECT o_orderkey, max(CASE WHEN i = 0 THEN CASE WHEN fp = o_orderkey * 2 THEN 0 ELSE id END END) AS first_id, max(CASE WHEN i = 1 THEN CASE WHEN fp = o_orderkey * 2 + 1 THEN 0 ELSE id END END) AS second_id FROM d GROUP BY o_orderkey""")
def dedupe_nested_leaves(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.array("o_orderstatus", "o_orderpriority").alias("leaves"))
    done = dictionary.encode_nested(rows, "leaves", "o_orderkey", ["o_custkey"])
    return done.select("o_orderkey", F.get("wire_ids", F.lit(0)).alias("first_id"), F.get("wire_ids", F.lit(1)).alias("second_id"))


# ---- delta

_PREV = "SELECT event_id, user_id, encode(props) AS b, lag(encode(props)) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events"
_AT = "list_filter(range(1, octet_length(b) + 1), lambda i: i > octet_length(a) OR substr(hex(a), 2 * i - 1, 2) <> substr(hex(b), 2 * i - 1, 2))"


def _event_pairs(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.col("props").cast("binary").alias("b"))
    return delta.with_previous(rows, "user_id", "event_id", "b", "a")


@_query(f"SELECT event_id, hex(a) AS previous_hex, octet_length(b)::INTEGER AS n FROM ({_PREV})")
def delta_lag_pairs(spark, sf_dir):
    return _event_pairs(spark, sf_dir).select("event_id", F.hex("a").alias("previous_hex"), F.octet_length("b").alias("n"))


@_query(f"""SELECT event_id, len(p)::BIGINT AS changed, len(list_filter(range(1, len(p) + 1), lambda k: k = 1 OR p[k] - p[k - 1] > 8))::BIGINT AS n_patches
FROM (SELECT event_id, {_AT} AS p FROM ({_PREV}) WHERE a IS NOT NULL)""")
def delta_rle_patches(spark, sf_dir):
    rows = _event_pairs(spark, sf_dir).filter("a is not null").select("event_id", delta.patch_stats(F.col("a"), F.col("b")).alias("s"))
    return rows.select("event_id", "s.changed", "s.n_patches")


@_query(f"""SELECT event_id, array_to_string(list_transform(range(1, greatest(octet_length(a), octet_length(b)) + 1),
  lambda i: printf('%02X', xor(('0x' || rpad(hex(a), 4096, '0')[2 * i - 1:2 * i])::INTEGER, ('0x' || rpad(hex(b), 4096, '0')[2 * i - 1:2 * i])::INTEGER))), '') AS xor_hex FROM ({_PREV}) WHERE a IS NOT NULL""")
def delta_xor_hex(spark, sf_dir):
    return _event_pairs(spark, sf_dir).filter("a is not null").select("event_id", delta.xor_hex(F.col("a"), F.col("b")).alias("xor_hex"))


@_query(f"""SELECT conv_id, turn, octet_length(encode(text))::INTEGER AS raw_len, f AS is_first, CASE WHEN f THEN '00' || {_varint('octet_length(encode(text))')} || hex(encode(text)) END AS whole_hex, true AS mode_ok
FROM (SELECT *, turn = min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations)""")
def delta_modes(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("b"))
    done = delta.encode(rows, "conv_id", "turn", "b")
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))
    return done.select("conv_id", "turn", F.octet_length("b").alias("raw_len"), first.alias("is_first"), F.when(first, F.hex("wire")).alias("whole_hex"), (F.col("mode").between(0, 2) & (~first | (F.col("mode") == 0))).alias("mode_ok"))


@_query("""SELECT turn = first AS is_first, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS raw_bytes, true AS bounded
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) GROUP BY ALL""")
def delta_mode_report(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("b"))
    done = delta.encode(rows, "conv_id", "turn", "b", strict_min=True)
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))
    whole = 1 + v.varint_len(F.octet_length("b")) + F.octet_length("b")
    done = done.select(first.alias("is_first"), F.octet_length("b").alias("raw"), (F.octet_length("wire") <= whole).alias("ok"))
    return done.groupBy("is_first").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raw_bytes"), F.bool_and("ok").alias("bounded"))


#: Pairs of blobs whose mode follows from their lengths: one byte changed in 240 (patches), all bytes shifted by a constant
#: (patches hold more than half, the exclusive-or is one repeated byte), and two hashes (nothing shrinks).
@_query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS mode, CASE event_id % 3 WHEN 0 THEN 240 WHEN 1 THEN 300 ELSE 32 END AS n, true AS same,
  CASE event_id % 3 WHEN 0 THEN '01' || '81F0' || '01' || lpad(to_hex(event_id % 100), 2, '0') || '01' || '7A' WHEN 2 THEN '0020' || upper(sha256('b' || event_id)) END AS wire_hex FROM events""")
def delta_strategy(spark, sf_dir):
    rows, key = _read(spark, sf_dir, "events").select("event_id"), F.col("event_id")
    kind, at = F.pmod(key, F.lit(3)), F.pmod(key, F.lit(100)).cast("int")
    base = F.repeat(F.lit("x"), 240)
    hashed = lambda c: F.unhex(F.sha2(F.concat(F.lit(c), key.cast("string")), 256))
    old = F.when(kind == 0, base.cast("binary")).when(kind == 1, F.repeat(F.lit("A"), 300).cast("binary")).otherwise(hashed("a"))
    new = F.when(kind == 0, F.concat(F.substring(base, F.lit(1), at), F.lit("z"), F.substring(base, at + 2, F.lit(240))).cast("binary")).when(kind == 1, F.repeat(F.lit("B"), 300).cast("binary")).otherwise(hashed("b"))
    pairs = rows.select("event_id", F.explode(F.array(F.struct(F.lit(1).alias("pos"), old.alias("b")), F.struct(F.lit(2).alias("pos"), new.alias("b")))).alias("p")).select("event_id", "p.*")
    done = delta.encode(pairs, "event_id", "pos", "b")
    back = delta.decode(done, "event_id", "pos").filter("pos = 2")
    wire = done.filter("pos = 2").select("event_id", "wire")
    return back.join(wire, "event_id").select("event_id", "mode", F.octet_length("blob").alias("n"), (F.col("blob") == F.col("b")).alias("same"), F.when(F.col("mode") != 2, F.hex("wire")).alias("wire_hex"))


@_query(f"""SELECT event_id, f OR r AS whole, CASE WHEN f OR r THEN '00' || {_varint('octet_length(b)')} || hex(b) END AS whole_hex, hex(b) AS blob_hex
FROM (SELECT event_id, encode(props) AS b, event_id % 7 = 0 AS r, event_id = min(event_id) OVER (PARTITION BY user_id) AS f FROM events)""")
def delta_remove_key(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.col("props").cast("binary").alias("b"), (F.pmod("event_id", F.lit(7)) == 0).alias("forget"))
    rows = delta.with_previous(rows, "user_id", "event_id", "b", "previous", "forget").withColumn("whole", F.col("previous").isNull()).drop("previous")
    done = delta.encode(rows, "user_id", "event_id", "b", remove="forget").drop("b", "mode").withColumn("kept", F.col("wire"))
    back = delta.decode(done, "user_id", "event_id", remove="forget")
    return back.select("event_id", "whole", F.when(F.col("whole"), F.hex("kept")).alias("whole_hex"), F.hex("blob").alias("blob_hex"))


@_query("SELECT 'events' AS t, user_id AS k, event_id AS pos, hex(encode(props)) AS blob_hex FROM events UNION ALL SELECT 'conversations', conv_id, turn, hex(encode(text)) FROM conversations")
def delta_roundtrip(spark, sf_dir):
    out = None
    for table, key, at, text in (("events", "user_id", "event_id", "props"), ("conversations", "conv_id", "turn", "text")):
        rows = _read(spark, sf_dir, table).select(F.lit(table).alias("t"), F.col(key).alias("k"), F.col(at).cast("long").alias("pos"), F.col(text).cast("binary").alias("b"))
        back = delta.decode(delta.encode(rows, "k", "pos", "b").drop("b", "mode"), "k", "pos").select("t", "k", "pos", F.hex("blob").alias("blob_hex"))
        out = back if out is None else out.union(back)
    return out


@_query("SELECT count(*) AS n_keys, sum(n)::BIGINT AS cached_bytes FROM (SELECT arg_max(octet_length(encode(props)), event_id) AS n FROM events GROUP BY user_id)")
def delta_store_stats(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.col("props").cast("binary").alias("b"))
    return delta.store_stats(rows, "user_id", "event_id", "b")


# ---- contexts, records and other types as columns

_LEAVES = """WITH l AS (SELECT o_custkey % 16 AS scope, o_orderkey, o_custkey % 50 AS part, o_orderkey % 40 AS supp, o_orderkey * 3 AS pos FROM orders),
v AS (SELECT scope, pos, 'part' AS t, part AS x FROM l UNION ALL SELECT scope, pos + 1, 'supp', supp FROM l UNION ALL SELECT scope, pos + 2, 'part', part + 1 FROM l),
f AS (SELECT *, min(pos) OVER (PARTITION BY scope, t, x) AS fp FROM v), d AS (SELECT *, dense_rank() OVER (PARTITION BY scope ORDER BY fp) AS id FROM f),"""


@_query(f"""{_LEAVES} h AS (SELECT pos, CASE WHEN fp = pos THEN '00' || {_le8('x')} ELSE {_varint('id')} END AS h FROM d)
SELECT o_orderkey, {_varint('o_orderkey')} || a.h || '01' || b.h || c.h AS wire_hex, part AS part_back, supp AS supp_back, part + 1 AS next_back
FROM l JOIN h a ON a.pos = l.pos JOIN h b ON b.pos = l.pos + 1 JOIN h c ON c.pos = l.pos + 2""")
def context_dictionary(spark, sf_dir):
    """Dictionary leaves of two types inside one struct: ids in order of rows and fields, scope by scope, and back."""
    part, supp = w.Keyed("part", w.U64), w.Keyed("supp", w.U64)
    kind = w.Struct(("key", w.U64), ("part", part), ("supp", w.Option(supp)), ("more", w.Struct(("next", part))))
    rows = _read(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(16)).alias("scope"), "o_orderkey", F.pmod("o_custkey", F.lit(50)).alias("part"), F.pmod("o_orderkey", F.lit(40)).alias("supp"))
    value = F.struct(F.col("o_orderkey").alias("key"), "part", "supp", F.struct((F.col("part") + 1).alias("next")).alias("more"))
    wire = columns.encode_rows(rows.select("scope", "o_orderkey", value.alias("v")), "v", kind, "o_orderkey", "scope").drop("v").withColumn("kept", F.col("wire"))
    back = columns.decode_rows(wire, "wire", kind, "o_orderkey", "scope", value="b")
    return back.select("o_orderkey", F.hex("kept").alias("wire_hex"), F.col("b.part").alias("part_back"), F.col("b.supp").alias("supp_back"), F.col("b.more.next").alias("next_back"))


@_query(f"""SELECT event_id, {_varint('event_id')} AS head_hex, CASE WHEN f OR c THEN '00' || {_varint('octet_length(b)')} || hex(b) END AS whole_hex, hex(b) AS blob_hex
FROM (SELECT event_id, encode(props) AS b, e <> lag(e, 1, e) OVER w AS c, row_number() OVER w = 1 AS f FROM (SELECT *, event_id // 1000 AS e FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def context_delta(spark, sf_dir):
    """A byte leaf inside a struct as a delta to the key's last blob; the store is emptied at each slot."""
    kind = w.Struct(("id", w.U64), ("body", w.BYTES))
    rows = _read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("slot"), "user_id", "event_id", F.struct(F.col("event_id").alias("id"), F.col("props").cast("binary").alias("body")).alias("v"))
    options = {"dictionary": False, "key": "user_id"}
    wire = columns.encode_rows(rows.withColumn("part", F.pmod("user_id", F.lit(8))), "v", kind, "event_id", ["part", "slot"], **options).drop("v")
    back = columns.decode_rows(wire.withColumn("kept", F.col("wire")), "wire", kind, "event_id", ["part", "slot"], **options)
    head = v.varint_len(F.col("event_id"))
    body = F.substring(F.hex("kept"), head * 2 + 1, F.lit(1 << 20))
    first = F.row_number().over(Window.partitionBy("user_id", "slot").orderBy("event_id")) == 1
    return back.select("event_id", F.substring(F.hex("kept"), F.lit(1), head * 2).alias("head_hex"), F.when(first, body).alias("whole_hex"), F.hex("value.body").alias("blob_hex"))


_REWARD_TAG = "c_custkey % 4"


@_query(f"""SELECT c_custkey, {_text('c_name')} || {_signed(_CENTS)} || {_varint('c_custkey * 1000003')} || CASE WHEN c_custkey % 5 = 0 THEN '00' ELSE '01' || lpad(to_hex({_REWARD_TAG}), 2, '0') END
  || CASE WHEN c_custkey % 3 = 0 THEN '00' ELSE '01' || lpad(to_hex(c_custkey % 200), 2, '0') END AS wire_hex, c_name AS name_back, {_CENTS} AS cents_back,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ['Fee', 'Rent', 'Staking', 'Voting'][{_REWARD_TAG} + 1] END AS type_back FROM customer""")
def record_reward(spark, sf_dir):
    key = F.col("c_custkey")
    kinds = F.array(*[F.lit(x) for x in records.REWARD_TYPES])
    value = F.struct(
        F.col("c_name").alias("pubkey"), F.round(F.col("c_acctbal") * 100).cast("long").alias("lamports"), (key * 1000003).cast("long").alias("post_balance"),
        F.when(key % 5 != 0, F.get(kinds, F.pmod(key, F.lit(4)).cast("int"))).alias("reward_type"), F.when(key % 3 != 0, F.pmod(key, F.lit(200)).cast("short")).alias("commission"),
    )
    rows = _read(spark, sf_dir, "customer").select("c_custkey", columns.encode_value(value, "record.Reward").alias("wire"))
    rows = rows.withColumn("b", columns.decode_value(F.col("wire"), "record.Reward"))
    return rows.select("c_custkey", F.hex("wire").alias("wire_hex"), F.col("b.pubkey").alias("name_back"), F.col("b.lamports").alias("cents_back"), F.col("b.reward_type").alias("type_back"))


_PUBKEY = "lpad(to_hex({x}), 64, '0')"


@_query(f"""WITH m AS (SELECT o_custkey % 10 AS scope, o_orderkey AS pos, o_custkey AS a, o_orderkey % 20 AS b FROM orders),
v AS (SELECT scope, pos * 2 AS p, a AS x FROM m UNION ALL SELECT scope, pos * 2 + 1, b FROM m), f AS (SELECT *, min(p) OVER (PARTITION BY scope, x) AS fp FROM v),
d AS (SELECT *, dense_rank() OVER (PARTITION BY scope ORDER BY fp) AS id FROM f), h AS (SELECT p, CASE WHEN fp = p THEN '00' || {_PUBKEY.format(x='x')} ELSE {_varint('id')} END AS h FROM d)
SELECT pos AS o_orderkey, '830200' || lpad(to_hex(pos % 255 + 1), 2, '0') || '02' || i.h || j.h || {_PUBKEY.format(x='pos')} || '01' || '07' || '04' || '0001' || '02' || '41' AS wire_hex, 2::BIGINT AS n_keys
FROM m JOIN h i ON i.p = pos * 2 JOIN h j ON j.p = pos * 2 + 1""")
def record_message(spark, sf_dir):
    """A message record with its public keys in a dictionary: header, two keys, hash, one instruction."""
    long_key = lambda x: F.unhex(F.lpad(F.hex(x), 64, "0"))
    u8 = lambda x: F.lit(x).cast("short")
    value = F.struct(
        F.struct(u8(2).alias("required_signatures"), u8(0).alias("readonly_signed"), (F.pmod("o_orderkey", F.lit(255)) + 1).cast("short").alias("readonly_unsigned")).alias("header"),
        F.array(long_key(F.col("o_custkey")), long_key(F.pmod("o_orderkey", F.lit(20)))).alias("account_keys"), long_key(F.col("o_orderkey")).alias("recent_blockhash"),
        F.array(F.struct(u8(7).alias("program_id_index"), F.unhex(F.lit("0001")).alias("accounts"), F.unhex(F.lit("41")).alias("data"))).alias("instructions"),
    )
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(10)).alias("scope"), value.alias("v"))
    wire = columns.encode_rows(rows, "v", "record.LegacyMessageBody", "o_orderkey", "scope").withColumn("kept", F.col("wire"))
    back = columns.decode_rows(wire, "wire", "record.LegacyMessageBody", "o_orderkey", "scope", value="b")
    same = F.when(F.col("b.account_keys") == F.col("v.account_keys"), F.size("b.account_keys").cast("long"))
    return back.select("o_orderkey", F.hex("kept").alias("wire_hex"), same.alias("n_keys"))


@_query(f"""SELECT event_id, CASE event_type WHEN 'click' THEN '00' WHEN 'purchase' THEN '01' || {_varint('user_id')} ELSE '02' || {_text('event_type')} END AS wire_hex,
  CASE event_type WHEN 'click' THEN 'Click' WHEN 'purchase' THEN 'Purchase' ELSE 'Other' END AS tag, CASE WHEN event_type = 'purchase' THEN user_id END AS user_back,
  CASE WHEN event_type NOT IN ('click', 'purchase') THEN event_type END AS name_back FROM events""")
def enum_decode(spark, sf_dir):
    kind = w.Enum("Click", ("Purchase", w.U64), ("Other", w.STR))
    tag = F.when(F.col("event_type") == "click", "Click").when(F.col("event_type") == "purchase", "Purchase").otherwise("Other")
    value = F.struct(tag.alias("tag"), F.col("user_id").alias("Purchase"), F.col("event_type").alias("Other"))
    rows = _read(spark, sf_dir, "events").select("event_id", columns.encode_value(value, kind).alias("wire")).withColumn("b", columns.decode_value(F.col("wire"), kind))
    return rows.select("event_id", F.hex("wire").alias("wire_hex"), "b.tag", F.col("b.Purchase").alias("user_back"), F.col("b.Other").alias("name_back"))


@_query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '01' || {_varint('o_custkey')} || {_varint('(o_custkey + 9)')} ELSE '00' || {_text('o_orderstatus')} END AS result_hex,
  {_varint('o_custkey')} || {_varint('(o_orderkey % 7)')} || {_varint('300')} AS array_hex, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 9 END AS end_back, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS error_back,
  o_orderkey % 7 AS second_back, {_le8('o_orderkey')} || lpad(to_hex(o_orderkey % 256), 2, '0') || '2C010000' AS packed_hex, o_orderkey AS packed_back FROM orders""")
def result_range_array_pack(spark, sf_dir):
    """Results, ranges, fixed arrays and fixed-width structs as columns, and back."""
    result, three = w.Result(w.range_of(w.U64), w.STR), w.Array(w.U64, 3)
    fixed = w.Struct(("key", w.U64), ("low", w.U8), ("rest", w.Array(w.U16, 2)))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    value = F.struct((key % 2 == 0).alias("ok"), F.struct(cust.alias("start"), (cust + 9).alias("end")).alias("value"), F.col("o_orderstatus").alias("error"))
    packed = F.struct(key.alias("key"), F.pmod(key, F.lit(256)).cast("short").alias("low"), F.array(F.lit(300), F.lit(0)).alias("rest"))
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", columns.encode_value(value, result).alias("r"), columns.encode_value(F.array(cust, key % 7, F.lit(300).cast("long")), three).alias("a"), columns.pack_value(packed, fixed).alias("p"))
    rows = rows.withColumns({"rb": columns.decode_value(F.col("r"), result), "ab": columns.decode_value(F.col("a"), three), "pb": columns.unpack_value(columns.fits(F.col("p"), 13), fixed)})
    return rows.select("o_orderkey", F.hex("r").alias("result_hex"), F.hex("a").alias("array_hex"), F.col("rb.value.end").alias("end_back"), F.col("rb.error").alias("error_back"), F.get("ab", F.lit(1)).alias("second_back"), F.hex("p").alias("packed_hex"), F.col("pb.key").alias("packed_back"))


@_query("""WITH e AS (SELECT event_id, event_type AS t, user_id % 40 AS x, sum((event_id % 500 = 0)::INTEGER) OVER (PARTITION BY event_type ORDER BY event_id) AS epoch FROM events),
f AS (SELECT *, min(event_id) OVER (PARTITION BY t, epoch, x) AS fp FROM e), d AS (SELECT *, dense_rank() OVER (ORDER BY fp) AS id FROM f)
SELECT event_id, t, CASE WHEN fp = event_id THEN 0 ELSE id END AS wire_id, x AS decoded FROM d""")
def dedupe_clear_type(spark, sf_dir):
    """Values of a type are forgotten where a row of the type is marked; ids go on in one counter."""
    rows = _read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("t"), F.pmod("user_id", F.lit(40)).alias("x"), (F.pmod("event_id", F.lit(500)) == 0).alias("clear"))
    rows = dictionary.clear_type_epochs(rows, "event_id", "clear", type_col="t")
    done = dictionary.encode(rows, "x", "event_id", type_col="t", epoch="epoch")
    wire = done.select("event_id", "t", "wire_id", F.when(F.col("is_new"), F.col("x")).alias("decoded"))
    return dictionary.decode(wire, "decoded", "event_id", type_col="t")


# ---- wide integers


@_query(f"""SELECT o_orderkey, bits::INTEGER AS bits, CASE WHEN v < 128 THEN lpad(to_hex(v), 2, '0') ELSE to_hex(128 + ((length(to_hex(v)) + 1) // 2)) || {_pairs(_even('v'))} END AS wire_hex
FROM (SELECT o_orderkey, o_orderkey % 100 AS bits, (o_orderkey::UHUGEINT * (1::UHUGEINT << (o_orderkey % 100)::UHUGEINT)) AS v FROM orders)""")
def u256_varint(spark, sf_dir):
    """Integers beyond 64 bits: binary of full width, least byte first, through the column codec."""
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(100)).cast("int").alias("bits"))
    rows = rows.withColumn("v", wide.shift_left(wide.from_long(F.col("o_orderkey")), F.col("bits"))).withColumn("wire", columns.encode_value(F.col("v"), "u256"))
    same = columns.decode_value(F.col("wire"), "u256") == F.col("v")
    return rows.select("o_orderkey", "bits", F.when(same, F.hex("wire")).alias("wire_hex"))


@_query("""SELECT o_orderkey, to_hex((o_orderkey::UHUGEINT << (o_orderkey % 60)::UHUGEINT) + o_custkey::UHUGEINT) AS sum_hex,
  to_hex((o_orderkey::UHUGEINT << (o_orderkey % 60)::UHUGEINT) + o_custkey::UHUGEINT - 1) AS difference_hex, to_hex((o_orderkey::UHUGEINT << (o_orderkey % 60)::UHUGEINT) >> 3::UHUGEINT) AS shifted_hex FROM orders""")
def u128_arithmetic(spark, sf_dir):
    key = wide.from_long(F.col("o_orderkey"), 128)
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", wide.shift_left(key, F.pmod("o_orderkey", F.lit(60)), 128).alias("v"))
    rows = rows.withColumn("s", wide.add(F.col("v"), wide.from_long(F.col("o_custkey"), 128), 128))
    one = wide.from_long(F.lit(1), 128)
    return rows.select("o_orderkey", wide.number_hex(F.col("s")).alias("sum_hex"), wide.number_hex(wide.subtract(F.col("s"), one, 128)).alias("difference_hex"), wide.number_hex(wide.shift_right(F.col("v"), F.lit(3), 128)).alias("shifted_hex"))


@_query(f"""SELECT o_custkey, len(k)::INTEGER AS n, array_to_string(list_transform(k, lambda x: {_le8('x')}), '') AS packed_hex, list_sum(k)::BIGINT AS back_sum
FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS k FROM orders GROUP BY o_custkey)""")
def pack_slice_custorders(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    rows = rows.withColumn("p", columns.pack_slices(F.col("k"), w.U64)).withColumn("n", F.size("k"))
    back = columns.unpack_vecs(F.col("p"), F.col("n"), w.U64)
    return rows.select("o_custkey", "n", F.hex("p").alias("packed_hex"), F.aggregate(back, F.lit(0).cast("long"), lambda a, x: a + x).alias("back_sum"))
