"""Line dedup: winnowing over line hashes.

A document is the sequence of its lines that hold a word.  Of every window of run_lines line hashes the smallest (the last
of equal ones) is selected; the selected lines, about two in run_lines + 1, are the fingerprints, and nothing else of a
document is looked at.  The guarantee: two equal runs of run_lines lines select the same line, whatever surrounds them.
Fingerprints that stand twice or more are joined by their surroundings, that is by how far a match extends to the left and
to the right of them: first positions with equal surroundings on both sides, of which the first stands for all, then these
few among one another, window by window.  Windows that follow one another make up the repeated run; later runs are
deleted, the first stays.  A line of long_words words or more is a window, and so a fingerprint, by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, drop_staged, let, numbered, read_table, stage

RUN_LINES, LONG_WORDS = 3, 50
_WORD = r"[^\x20\x09-\x0D]+"


def fingerprints(rows: DataFrame, run_lines: int, long_words: int) -> DataFrame:
    """One row per selected line: _rid, _id, fp (its hash), at (its number, from 1) and around, the windows that it stands
    for: i (first line), n (lines) and a 128-bit hash (a, b) of their content."""
    lines = F.filter(F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1), lambda x: x.rlike(_WORD))
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("second"), x).alias("g"), F.when(F.length(x) >= 2 * long_words - 1, F.regexp_count(x, F.lit(_WORD)) >= long_words).otherwise(F.lit(False)).alias("long")))
    none = F.array().cast("array<int>")

    def window(h, i, n: int):
        part = F.slice(h, i, n)
        hashes = F.transform(part, lambda x: x["h"])
        last = F.lit(n) - F.array_position(F.reverse(hashes), F.array_min(hashes)).cast("int")
        return F.struct((i + last).alias("at"), i.alias("i"), F.lit(n).alias("n"), F.xxhash64(F.lit(n), hashes).alias("a"), F.xxhash64(F.lit(n), F.transform(part, lambda x: x["g"])).alias("b"))

    def selected(h, windows):
        def one(at):
            near = F.slice(windows, F.greatest(at - run_lines + 1, F.lit(1)), F.least(at, F.lit(run_lines)))
            return F.struct(F.get(h, at - 1)["h"].alias("fp"), at.alias("at"), F.filter(near, lambda w: w["at"] == at).alias("around"))

        return F.transform(F.array_distinct(F.transform(windows, lambda w: w["at"])), one)

    def both(h):
        runs = F.transform(F.when(F.size(h) >= run_lines, F.sequence(F.lit(1), F.size(h) - run_lines + 1)).otherwise(none), lambda i: window(h, i, run_lines))
        alone = F.filter(F.transform(F.when(F.size(h) > 0, F.sequence(F.lit(1), F.size(h))).otherwise(none), lambda i: F.when(F.get(h, i - 1)["long"], window(h, i, 1))), lambda x: x.isNotNull())
        single = F.transform(alone, lambda w: F.struct(F.get(h, w["at"] - 1)["h"].alias("fp"), w["at"].alias("at"), F.array(w).alias("around")))
        return F.concat(let(runs, lambda w: selected(h, w)), single)

    return rows.select("_rid", "_id", F.explode(let(hashed, both)).alias("f")).select("_rid", "_id", "f.fp", "f.at", F.transform("f.around", lambda w: F.struct((w["i"] - F.col("f.at")).alias("s"), w["n"].alias("n"), w["a"].alias("a"), w["b"].alias("b"))).alias("around"))


def repeated_windows(rows: DataFrame, run_lines: int = RUN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """Windows (_rid, i, n) of the rows (_rid, _id, _text) that stand earlier, by id, row and line; null ids come first."""
    found = stage(fingerprints(rows, run_lines, long_words), "line-fingerprints")
    # staged by itself, and joined under a name that nothing behind it groups by, so that a hot fingerprint's rows are split
    common = stage(found.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("fp"), "line-common")
    anchors = found.join(common.hint("merge"), "fp", "left_semi").select(F.struct("_id", "_rid", "at").alias("place"), "around", F.xxhash64("around").alias("key1"), F.xxhash64(F.lit("second"), "around").alias("key2"))
    anchors = stage(anchors, "line-anchors")
    drop_staged(found)
    alike = stage(anchors.groupBy("key1", "key2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("c"), F.first("around").alias("around")), "line-alike")
    # the first of alike positions stands for all: its windows against those of others
    windows = alike.select("key1", "key2", "first", F.explode("around").alias("w")).select("key1", "key2", "w.*", F.struct(F.col("first._id").alias("id"), F.col("first._rid").alias("rid"), (F.col("first.at") + F.col("w.s")).alias("i")).alias("at"))
    windows = stage(windows, "line-windows")
    least = stage(windows.groupBy("a", "b").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("a", "b", "least"), "line-least")
    later = windows.join(least.hint("merge"), ["a", "b"]).filter(~F.col("at").eqNullSafe(F.col("least"))).select(F.col("at.rid").alias("_rid"), F.col("at.i").alias("i"), "n")
    # the others of alike positions: all their windows stand earlier
    several = stage(alike.filter("c > 1").select("key1", "key2", "first"), "line-several")
    copies = anchors.join(several.hint("merge"), ["key1", "key2"]).filter(~F.col("place").eqNullSafe(F.col("first"))).select("place", F.explode("around").alias("w"))
    copies = copies.select(F.col("place._rid").alias("_rid"), (F.col("place.at") + F.col("w.s")).alias("i"), F.col("w.n").alias("n"))
    return later.union(copies)


def dedup_lines(docs: DataFrame, run_lines: int = RUN_LINES, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns with later repeated runs deleted from the text; adds n_lines, n_removed, n_runs.

    Lines are what stands between line feeds; those without a word take no part and stay.  A line is deleted if it lies
    in a run of run_lines lines, or has long_words words or more, and the run stands earlier: in an earlier id (null
    first; of equal ids in either row), or higher up in the same text.  Null texts stay null, empty ones empty; a text
    all of whose lines are deleted becomes empty.  Columns named like an added one are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    kept = docs.columns
    rows = numbered(docs.select(F.struct(*kept).alias("_row")), "lines", codec="zstd")
    text = F.col("_row")[text_col].cast("string")
    hits = repeated_windows(rows.select("_rid", F.col("_row")[id_col].alias("_id"), text.alias("_text")), run_lines, long_words).groupBy("_rid").agg(F.collect_list(F.struct("i", "n")).alias("_hits"))
    hits = stage(hits, "line-hits")
    collect_garbage(docs.sparkSession)
    joined = rows.join(hits.hint("merge"), "_rid", "left")  # one row per document on either side, at any size
    lines = F.split(text, "\n", -1)

    def clean(x):
        places = F.filter(F.transform(x, lambda s, j: F.when(s.rlike(_WORD), j)), lambda j: j.isNotNull())

        def cut(p):
            gone = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda w: F.sequence(w["i"] - 1, w["i"] + w["n"] - 2)))))
            remain = let(F.transform(gone, lambda k: F.get(p, k)), lambda g: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), g))
            runs = let(gone, lambda g: F.size(F.filter(g, lambda k, j: (j == 0) | (F.get(g, j - 1) < k - 1))))
            return F.struct(F.array_join(F.transform(remain, lambda j: F.get(x, j)), "\n").alias("text"), F.size(gone).alias("n_removed"), runs.alias("n_runs"), F.size(p).alias("n_lines"))

        whole = lambda p: F.struct(F.array_join(x, "\n").alias("text"), F.lit(0).alias("n_removed"), F.lit(0).alias("n_runs"), F.size(p).alias("n_lines"))
        return let(places, lambda p: F.when(F.col("_hits").isNull(), whole(p)).otherwise(cut(p)))

    done = joined.withColumn("_new", F.when(text.isNotNull(), let(lines, clean)))
    out = [F.when(F.col("_new").isNotNull(), F.col("_new.text")).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in kept]
    count = lambda n: F.coalesce(F.col(f"_new.{n}"), F.lit(0)).cast("long").alias(n)
    return done.select(*out, count("n_lines"), count("n_removed"), count("n_runs"))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_runs", "text")


def dedup_ctes(docs: str, run_lines: int = RUN_LINES, long_words: int = LONG_WORDS) -> str:
    """DuckDB CTEs; the last, cleaned, has the columns of docs (ids unique) with the new text, n_lines, n_removed, n_runs."""
    more = "".join(f" || chr(10) || coalesce(lead(line, {k}) OVER w, '')" for k in range(1, run_lines))
    return f"""
raw_lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS j, unnest(string_split(text, chr(10))) AS line FROM {docs} WHERE text IS NOT NULL),
word_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i FROM raw_lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
run_keys AS (
  SELECT doc_id, i, {run_lines} AS n, line{more} AS k FROM word_lines WINDOW w AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(i, {run_lines - 1}) OVER w IS NOT NULL
  UNION ALL SELECT doc_id, i, 1, line FROM word_lines WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {long_words}),
later AS (SELECT doc_id, i, n FROM run_keys QUALIFY row_number() OVER (PARTITION BY n, k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM later),
marked AS (SELECT r.doc_id, r.j, r.line, w.i, g.i IS NOT NULL AS dead FROM raw_lines r LEFT JOIN word_lines w USING (doc_id, j) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i),
runs AS (SELECT doc_id, count(*) AS n_runs FROM (SELECT doc_id, i - lag(i, 1, -9) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM gone) WHERE step > 1 GROUP BY doc_id),
rebuilt AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT dead), '') AS new_text, count(i) AS n_lines, count(*) FILTER (dead) AS n_removed FROM marked GROUP BY doc_id),
cleaned AS (SELECT d.* EXCLUDE (text), CASE WHEN d.text IS NOT NULL THEN coalesce(new_text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs
  FROM {docs} d LEFT JOIN rebuilt USING (doc_id) LEFT JOIN runs USING (doc_id))"""


def oracle() -> str:
    return f"WITH {dedup_ctes('documents')}\nSELECT doc_id, n_lines, n_removed, n_runs, text FROM cleaned"
