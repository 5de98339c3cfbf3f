"""Queries over the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_license_scan": ("licenses", "OP1_SQL"),
    "op2_line_dedup": ("line_dedup", "OP2_SQL"),
    "op3_language_id": ("language_id", None),
    "op4_lm_scoring": ("lm_scoring", "OP4_SQL"),
    "op5_byte_bpe": ("bpe", None),
    "op6_suffix_dedup": ("suffix_dedup", None),
    "op7_mix_sources": ("mixing", "OP7_SQL"),
    "op8_embedding_dedup": ("embedding_dedup", "OP8_SQL"),
    "op9_minhash_dedup": ("minhash_dedup", "OP9_SQL"),
    "op10_exact_topk": ("topk", "OP10_SQL"),
    "op11_conversation_repair": ("conversation_repair", "OP11_SQL"),
    "op12_embedding_whitening": ("whitening", None),
    "op13_toxicity": ("toxicity", None),
}


def _module(name: str):
    return importlib.import_module(f"treeloom.llm.{_MODULES[name][0]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(_module(name), sql) for name, (_, sql) in _MODULES.items() if sql}
