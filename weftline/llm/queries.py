"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

import importlib

#: query: module; a module's ORACLE, where it has one, is DuckDB SQL for the same rows.
MODULES = {
    "op1_topk": "op1_topk",
    "op2_html_text": "op2_html",
    "op3_langid": "op3_langid",
    "op4_embedding_dedup": "op4_embeddings",
    "op5_chat_format": "op5_chat",
    "op6_minhash": "op6_setsketch",
    "op7_suffix_dedup": "op7_substrings",
    "op8_bpe": "op8_bpe",
    "op9_mix": "op9_mix",
    "op10_line_dedup": "op10_lines",
    "op11_license_scan": "op11_license",
    "op12_filter_audit": "op12_audit",
    "op13_chat_repair": "op13_repair",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{m}"), name) for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{m}"), "ORACLE", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
