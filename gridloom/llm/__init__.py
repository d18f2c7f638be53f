"""Operators for training-data pipelines, and their queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1_ctw", "op6_superkmers", "op2_url_filter", "op7_fst_tokens", "op10_mcd_quality", "op3_toxicity", "op4_grace_dedup", "op5_simhash", "op8_mixing", "op9_sentencepiece")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"gridloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"gridloom.llm.{m}").ORACLES.items()}
