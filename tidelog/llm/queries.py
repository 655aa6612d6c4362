"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = ("op1_token_counts", "op2_language_id", "op3_html_text", "op4_lm_scoring", "op5_mixing", "op6_media", "op7_quality", "op8_suffix_dedup", "op9_packing", "op10_simhash")


def _each():
    for name in _MODULES:
        yield name, importlib.import_module(f"tidelog.llm.{name}")


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _each()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _each() if hasattr(module, "ORACLE_SQL")}
