"""The text operators' queries and their SQL."""

from __future__ import annotations

import importlib

#: Module and query; a module's SQL, where it has one, gives the same rows.
_ALL = [
    ("tokens", "op1_token_counts"),
    ("media", "op2_media_columns"),
    ("near_dedup", "op3_near_duplicates"),
    ("packing", "op4_harmonic_packing"),
    ("brown", "op5_brown_scores"),
    ("quality", "op6_quality_rules"),
    ("mixing", "op7_mix_sources"),
    ("chat", "op8_chat_format"),
    ("phrases", "op9_repeated_phrases"),
    ("licenses", "op10_license_scan"),
    ("rotated", "op11_rotated_codes"),
    ("audit", "op12_filter_audit"),
    ("lloyd", "op13_cover_codes"),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tilespark.llm.{module}"), name) for module, name in _ALL}


def oracle_sql() -> dict[str, str]:
    modules = {name: importlib.import_module(f"tilespark.llm.{module}") for module, name in _ALL}
    return {name: m.SQL for name, m in modules.items() if getattr(m, "SQL", None)}
