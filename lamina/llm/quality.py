"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Per document a few integer measures are counted.  Their distribution in each language and source is kept in a mergeable
quantile sketch: counts of logarithmic buckets (exact below 32, within 1/16 above), so that sketches of parts, or of the
sources of a language, are merged by adding counts and come out the same in any order.  Every group, of whatever size, has
thresholds of its own: its sketch is merged with its language's and the whole corpus's, each scaled to count as PRIOR
documents.  A document is dropped where a measure lies far outside the quartiles; the distance is counted in the group's
own spread, and for rates, which are zero in most documents, also in the lower quartile of the others and their share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, join_groups, let, read_table, stage

WINDOW = 8
#: Measure: (side of the fence, smoothing that is added to the spread, so that a group of copies has some).
MEASURES = {
    "symbol_rate": ("high", 40),
    "dup_line_rate": ("high", 110),
    "repeat_rate": ("high", 75),
    "word_length": ("both", 30),
}
#: A fence stands this many spreads beyond the quartile.
REACH = 3
#: Documents that a wider sketch counts as in a group's own, and parts of a document that sketches count in.
PRIOR, PARTS = 50, 1024


def _dup_positions(keys: Column) -> Column:
    """Ascending positions (from 1) of the elements that are found twice or more in an array of (key, position), sorted."""
    again = lambda p, j: ((j > 0) & (F.get(keys, j - 1)["k"] == p["k"])) | ((j < F.size(keys) - 1) & (F.get(keys, j + 1)["k"] == p["k"]))
    return F.array_sort(F.transform(F.filter(keys, again), lambda p: p["i"]))


def _keyed(values: Column) -> Column:
    return F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("k"), (i + 1).alias("i"))))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows found twice or more: hashes find the windows, the windows' own words confirm them."""
    hashes = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def confirmed(positions: Column) -> Column:
        texts = F.transform(positions, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("k"), i.alias("i")))
        return let(F.array_sort(texts), _dup_positions)

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, j: F.when(j == F.size(at) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(at, j + 1) - p)))
        return F.aggregate(reach, F.lit(0), lambda s, x: s + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(confirmed(let(_keyed(h), _dup_positions)), covered))

    return let(hashes, count)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = ()) -> DataFrame:
    """id, group columns g0.., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the measures."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE_CLASS + "+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    groups = [F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(group_cols)]
    rows = docs.select(F.col(id_col).alias("_id"), *keep, *groups, counted.alias("_w"), by_line.alias("_l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    rows = rows.select("_id", *keep, *[f"g{i}" for i in range(len(group_cols))], "_w.*", "_l.*", "n_symbols")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    per = lambda top, x, low: F.when(F.col(low) > 0, F.floor(F.col(x) * top / F.col(low))).otherwise(0).cast("long")
    return rows.withColumns({
        "base_failed": failed, "symbol_rate": per(1000, "n_symbols", "n_words"), "dup_line_rate": per(1000, "n_dup_lines", "n_lines"),
        "repeat_rate": per(1000, "n_repeat_words", "n_words"), "word_length": per(100, "word_chars", "n_words"),
    })


def bucket(value: Column) -> Column:
    """Bucket number of a natural number: itself below 32, else 16 buckets for each power of two."""
    power = F.length(F.bin(value)) - 1
    return F.when(value < 32, value.cast("int")).otherwise(32 + (power - 5) * 16 + F.call_function("shiftright", value, power - 4).cast("int") - 16)


def bucket_bound(code: Column, upper: bool) -> Column:
    """Least or greatest number of a bucket."""
    power, step = F.floor((code - 32) / 16).cast("int") + 5, F.pmod(code, F.lit(16)).cast("long") + 16
    low = F.call_function("shiftleft", step, power - 4)
    high = F.call_function("shiftleft", step + 1, power - 4) - 1
    return F.when(code < 32, code.cast("long")).otherwise(high if upper else low)


def _sketches(counts: DataFrame, keys: list[str], weight) -> DataFrame:
    """One row per group and measure: the sketch s, an array of (code, w), with w = weight(n, documents of the group)."""
    merged = counts.groupBy(*keys, "measure", "code").agg(F.sum("n").alias("n"))
    rows = merged.groupBy(*keys, "measure").agg(F.collect_list(F.struct("code", "n")).alias("s"), F.sum("n").alias("total"))
    return rows.select(*keys, "measure", F.transform("s", lambda x: F.struct(x["code"].alias("code"), weight(x["n"], F.col("total")).alias("w"))).alias("s"))


def fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: a column fence with, per measure, low and high. counts: keys, measure, code, n."""
    rows = _sketches(counts, keys, lambda n, total: n * PARTS).withColumnRenamed("s", "s_own")
    for depth in range(len(keys)):
        wider = _sketches(counts, keys[:depth], lambda n, total: F.floor(n * (PARTS * PRIOR) / total)).withColumnRenamed("s", f"s_{depth}")
        rows = join_groups(rows, wider, [*keys[:depth], "measure"])
    parts = [F.coalesce(f"s_{d}", F.array().cast("array<struct<code:int,w:bigint>>")) for d in ("own", *range(len(keys)))]
    rows = rows.select(*keys, "measure", F.array_sort(F.concat(*parts)).alias("s"))

    def quantile(sketch: Column, percent: int) -> Column:
        total = F.aggregate(sketch, F.lit(0).cast("long"), lambda a, x: a + x["w"])

        def code(t):
            seen = lambda a, x: F.struct((a["seen"] + x["w"]).alias("seen"), F.coalesce(a["found"], F.when((a["seen"] + x["w"]) * 100 >= t * percent, x["code"])).alias("found"))
            return F.aggregate(sketch, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("found")), seen, lambda a: a["found"])

        return let(total, code)

    weight = lambda sketch: F.aggregate(sketch, F.lit(0).cast("long"), lambda a, x: a + x["w"])
    some = F.filter("s", lambda x: x["code"] > 0)
    rows = rows.withColumns({
        "q1": bucket_bound(quantile(F.col("s"), 25), False), "q3": bucket_bound(quantile(F.col("s"), 75), True),
        "share": F.floor(weight(some) * 1000 / weight(F.col("s"))), "light": F.coalesce(bucket_bound(quantile(some, 25), False), F.lit(0).cast("long")),
    })
    smooth = reduce(lambda w, m: w.when(F.col("measure") == m, F.lit(MEASURES[m][1])), MEASURES, F.when(F.lit(False), F.lit(0)))
    out = []
    for m, (side, _) in MEASURES.items():
        own = F.col("measure") == m
        spread = REACH * (F.col("q3") - F.col("q1") + smooth + (F.floor(F.col("light") * F.col("share") / 1000) if side == "high" else 0))
        low = F.max(F.when(own, F.col("q1") - spread)) if side == "both" else F.lit(-1)
        out.append(F.struct(low.cast("long").alias("low"), F.max(F.when(own, F.col("q3") + spread)).cast("long").alias("high")).alias(m))
    return rows.groupBy(*keys).agg(F.struct(*out).alias("fence"))


def judge(rows: DataFrame, n_groups: int = 2) -> DataFrame:
    """Adds the method's verdict to the staged rows of measure(): column kept.

    Only documents that pass the base rules make up the sketches.
    """
    keys = [f"g{i}" for i in range(n_groups)]
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("code")) for m in MEASURES]))
    counts = rows.filter(~F.col("base_failed")).select(*keys, pairs.alias("p")).groupBy(*keys, "p.measure", "p.code").agg(F.count(F.lit(1)).alias("n"))
    table = stage(fences(stage(counts, "quality-sketch"), keys), "quality-fences")
    out = join_groups(rows, table, keys)
    inside = reduce(lambda a, b: a & b, [F.col(m).between(F.col("fence")[m]["low"], F.col("fence")[m]["high"]) for m in MEASURES])
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("fence")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the measures.

    Null and empty texts have no words and fail the base rules.  Null languages and sources are groups of their own;
    equal rows are judged alike, each as a row.  Other columns, clashing names included, are left out.  No rows: none.
    """
    rows = stage(measure(docs, id_col, text_col, (lang_col, source_col)), "quality-measures")
    return judge(rows).select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with all their columns and nothing else; rules as in quality_rules()."""
    body = F.struct(*docs.columns).alias("_row")
    rows = stage(measure(docs.select("*", body), id_col, text_col, (lang_col, source_col), keep=("_row",)), "quality-rows")
    return judge(rows).filter("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def measured_ctes(docs: str = "documents") -> str:
    """DuckDB CTEs whose last, judged, has one row per row of docs with rid, doc_id, the counts, base_failed and kept."""
    code = lambda m: f"CASE WHEN {m} < 32 THEN {m} ELSE 32 + (length(bin({m})) - 6) * 16 + ({m} >> (length(bin({m})) - 5)) - 16 END"
    low = "CASE WHEN q < 32 THEN q ELSE (q % 16 + 16) << ((q - 32) // 16 + 1) END"
    high = "CASE WHEN q < 32 THEN q ELSE ((q % 16 + 17) << ((q - 32) // 16 + 1)) - 1 END"
    union = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {code(m)} AS code FROM base WHERE NOT base_failed" for m in MEASURES)
    smooth = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, (_, v) in MEASURES.items()) + " END"
    typical = "CASE WHEN measure IN (" + ", ".join(f"'{m}'" for m, (side, _) in MEASURES.items() if side == "high") + ") THEN light * share // 1000 ELSE 0 END"
    scaled = f"floor(n * {PARTS * PRIOR} / total)::BIGINT"
    tests = " AND ".join(f"{m} <= fence['{m}'].hi" + (f" AND {m} >= fence['{m}'].lo" if side == "both" else "") for m, (side, _) in MEASURES.items())
    sketches = f"""
own AS (SELECT lang, source, measure, code, count(*) AS n FROM coded GROUP BY ALL),
by_lang AS (SELECT lang, measure, code, n, sum(n) OVER (PARTITION BY lang, measure) AS total FROM (SELECT lang, measure, code, sum(n)::BIGINT AS n FROM own GROUP BY ALL)),
by_all AS (SELECT measure, code, n, sum(n) OVER (PARTITION BY measure) AS total FROM (SELECT measure, code, sum(n)::BIGINT AS n FROM own GROUP BY ALL)),
there AS (SELECT DISTINCT lang, source, measure FROM own),
parts AS (SELECT lang, source, measure, code, n * {PARTS} AS w FROM own
  UNION ALL SELECT t.lang, t.source, measure, code, {scaled} FROM there t JOIN by_lang l USING (measure) WHERE t.lang IS NOT DISTINCT FROM l.lang
  UNION ALL SELECT t.lang, t.source, measure, code, {scaled} FROM there t JOIN by_all USING (measure)),
merged AS (SELECT lang, source, measure, code, sum(w)::BIGINT AS w FROM parts GROUP BY ALL),
seen AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY code) AS seen, sum(w) OVER (PARTITION BY lang, source, measure) AS total,
  sum(w) FILTER (code > 0) OVER (PARTITION BY lang, source, measure ORDER BY code) AS seen_some, sum(w) FILTER (code > 0) OVER (PARTITION BY lang, source, measure) AS total_some FROM merged),
codes AS (SELECT lang, source, measure, min(code) FILTER (seen * 100 >= total * 25) AS a, min(code) FILTER (seen * 100 >= total * 75) AS b,
  min(code) FILTER (code > 0 AND seen_some * 100 >= total_some * 25) AS c, coalesce(max(total_some), 0) * 1000 // max(total) AS share FROM seen GROUP BY ALL),
bounds AS (SELECT *, ({low.replace('q', 'a')}) AS q1, ({high.replace('q', 'b')}) AS q3, coalesce({low.replace('q', 'c')}, 0) AS light FROM codes),
spreads AS (SELECT *, {REACH} * (q3 - q1 + {smooth} + {typical}) AS spread FROM bounds),
fences AS (SELECT lang, source, map_from_entries(list((measure, {{'lo': q1 - spread, 'hi': q3 + spread}}))) AS fence FROM spreads GROUP BY ALL)"""
    return f"""
numbered AS (SELECT row_number() OVER () AS rid, *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM {docs}),
windows AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM numbered, unnest(range(1, len(words) - {WINDOW - 2})) t(i)),
repeated AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM repeated) GROUP BY rid),
counted AS (SELECT n.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
    coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM numbered n LEFT JOIN covered c USING (rid)),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbol_rate, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length FROM counted),
coded AS ({union}), {sketches},
judged AS (SELECT b.*, fence, NOT base_failed AND coalesce({tests}, true) AS kept FROM base b LEFT JOIN fences f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source)"""


def oracle() -> str:
    return f"WITH {measured_ctes()}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
