"""Queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import line_dedup, mixing, ngram_join, packing, pii, quality, suffix_dedup, token_files, topk, url_filter

_MODULES = {
    "op1_topk": topk,
    "op2_quality": quality,
    "op3_token_files": token_files,
    "op4_pii": pii,
    "op5_line_dedup": line_dedup,
    "op6_ngram_join": ngram_join,
    "op7_packing": packing,
    "op8_url_filter": url_filter,
    "op9_mixing": mixing,
    "op10_suffix_dedup": suffix_dedup,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.oracle() for name, module in _MODULES.items() if hasattr(module, "oracle")}
