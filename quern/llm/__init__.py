"""Operators for preparing training corpora. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op1_mixture",
    "op2_toxicity",
    "op3_token_counts",
    "op4_warc_store",
    "op5_jaccard_join",
    "op6_language_id",
    "op7_quality_rules",
    "op8_byte_bpe",
    "op9_media",
    "op10_line_dedup",
)


def queries() -> dict:
    """The registered queries of all operators, by name."""
    return {name: query for module in MODULES for name, query in import_module(f"{__name__}.{module}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in import_module(f"{__name__}.{module}").ORACLE_SQL.items()}
