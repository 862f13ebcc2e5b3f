"""Operators for training-data corpora; nothing else in the library imports this subpackage."""

from importlib import import_module

MODULES = ("op1_winnowing", "op2_licenses", "op3_repeats", "op4_near_duplicates", "op5_mixing", "op6_media", "op7_sharding", "op8_secrets", "op9_sentencepiece", "op10_quality")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__name__}.{m}").ORACLE_SQL.items()}
