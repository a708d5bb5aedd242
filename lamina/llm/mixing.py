"""Mixing sources to target weights: Poisson replication.

Each source gets a rate, the mean number of copies that brings its mass to its target; each document draws its number of
copies by inverting the Poisson distribution of that rate at a uniform number hashed from a seed and its id; copies are
then dealt out in an order hashed from seed, id and copy number.  The draw depends on nothing but the id and the rate, so
a lost task draws the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, partitions, read_table, stage

#: Larger rates are drawn as sums of draws of at most this mean (a sum of Poisson numbers is one), so exp() cannot underflow.
_CHUNK = 256


def _uniform(seed: int, *parts: Column) -> Column:
    """53-bit-safe uniform number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(f"{seed}"), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per source: n_docs, mass (UTF-8 bytes of its texts plus one per document), weight, rate.

    Target weights are the given ones (a source not named: 0), or mass ** temperature; epochs times the whole mass is
    shared out by weight.  Mass is counted over all documents; a null source is a source of its own.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("mass"))
    if weights is None:
        weight = F.floor(F.pow(F.col("mass").cast("double"), F.lit(float(temperature))) * 1000).cast("long")
    else:
        table = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, round(w * 1_000_000))]) if weights else None
        weight = F.coalesce(F.try_element_at(table, F.col("source")).cast("long"), F.lit(0).cast("long")) if weights else F.lit(0).cast("long")
    sizes = stage(sizes.withColumn("weight", weight), "mixing-sources")
    total = sizes.agg(F.sum("mass").alias("mass"), F.sum("weight").alias("weight")).first()
    share = F.col("weight").cast("double") / F.lit(float(total["weight"] or 1))
    return sizes.withColumn("rate", share * F.lit(float(total["mass"] or 0) * float(epochs)) / F.col("mass").cast("double"))


def _with_distribution(rates: DataFrame) -> DataFrame:
    """Adds n_draws and cdf: the distribution function of one draw, as far as a uniform number can tell."""
    draws = F.greatest(F.ceil(F.col("rate") / _CHUNK), F.lit(1).cast("long")).cast("int")
    mean = F.col("rate") / F.col("n_draws")
    most = F.ceil(mean + F.sqrt(mean) * 12 + 30).cast("int")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c"))
    return rates.withColumn("n_draws", draws).withColumn("cdf", F.aggregate(F.sequence(F.lit(1), most), first, step, lambda s: s["c"]))


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The documents with all their columns, each as many times as drawn, in a global random order (partition by partition).

    Adds copy (from 1) and shuffle_key (long, the order).  An input column named so is replaced.  Rows with equal ids
    draw equal numbers; a null id draws like any other; null and empty texts weigh one byte.  No rows: none.
    """
    docs = docs.drop("copy", "shuffle_key")
    kept = docs.columns
    table = _with_distribution(source_rates(docs, weights, temperature, epochs, source_col, text_col)).select(F.col("source").alias("_source"), "n_draws", "cdf")
    table = table.select("_source", F.struct("n_draws", "cdf").alias("_draw"))
    rows = join_groups(docs.withColumn("_source", F.col(source_col)), table, ["_source"])
    one = lambda j: F.size(F.filter(F.col("_draw.cdf"), lambda c: c <= _uniform(seed, F.col(id_col), j)))
    rows = rows.withColumn("_copies", F.aggregate(F.sequence(F.lit(1), F.col("_draw.n_draws")), F.lit(0), lambda s, j: s + one(j)))
    rows = rows.filter(F.col("_copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    name = F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string"))
    rows = rows.withColumn("shuffle_key", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"))
    # the key is uniform below 2**60, so ranges of equal width are even and no sample has to be drawn first
    parts = partitions(docs.sparkSession)
    place = F.shiftright(F.shiftright("shuffle_key", 30) * parts, 30).cast("int")
    return rows.select(*kept, "copy", "shuffle_key").repartitionById(parts, place).sortWithinPartitions("shuffle_key")


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "shuffle_key", "text")


def mixed_sql(docs: str, columns: str) -> str:
    """DuckDB SQL over the relation docs for mix_sources with default parameters: columns of documents, copy, shuffle_key."""
    return f"""
SELECT {columns}, copy, ('0x' || substr(md5('17/order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM (
  SELECT d.*, unnest(range(1, d.copies + 1))::INTEGER AS copy FROM (
    SELECT x.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM x.source
      AND cdf.c <= ('0x' || substr(md5('17:' || coalesce(x.doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) AS copies
    FROM {docs} x) d)"""


def mixed_ctes(docs: str) -> str:
    return f"""
sizes AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS mass FROM {docs} GROUP BY source),
weighted AS (SELECT *, floor(pow(mass::DOUBLE, 0.5) * 1000)::BIGINT AS weight FROM sizes),
rates AS (SELECT source, weight::DOUBLE / (SELECT sum(weight) FROM weighted)::DOUBLE * (SELECT sum(mass) FROM weighted)::DOUBLE / mass::DOUBLE AS rate FROM weighted),
cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rates, range(0, 600) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30))"""


def oracle() -> str:
    return f"WITH {mixed_ctes('documents')}\nSELECT doc_id, source, copy, shuffle_key, text FROM ({mixed_sql('documents', '*')})"
