"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import line_dedup, mixing, ngram_join, packing, quality
from lamina.llm.common import discard_unread, drop_staged, stage, staged_count, staged_since

#: Tables between steps that the last call of each stage left, by the stage's place.
_left: dict[int, list[str]] = {}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so do documents that lose all their lines to it. n_chars is counted anew."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS)).filter("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one of the smallest id stays."""
    return ngram_join.drop_near_duplicates(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn for its source's rate, in a global random order."""
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document with its place in a sequence of 2048 tokens. Workers keep no memo for other stages."""
    return packing.pack(docs, _tokenizer(), memo=300_000, keep_memo=False)


def _in_turn(place: int, step):
    """The stage, which first deletes what the one before staged: its result has been written and is read as docs."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_unread(spark, _left.pop(place - 1, []), docs)
        mark = staged_count()
        out = step(spark, docs, sf_dir)
        _left[place] = staged_since(mark)
        return out

    return functools.update_wrapper(run_stage, step)


_STEPS = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]
STAGES = [(name, _in_turn(place, step)) for place, (name, step) in enumerate(_STEPS)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again as the next one's documents."""
    docs = kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            before, kept = kept, stage(docs, "pipeline")
            drop_staged(before)
            docs = kept
    return docs


#: Packing's token ids are beyond SQL; tests/llm/test_queries.py holds each stage against SQL or brute force.
ORACLE_SQL = None
