"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["token_counts", "ngram_join", "quality_rules", "chat_format", "mixing", "url_filter", "secrets", "piece_codec", "quality_classifier", "fingerprints"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"weftline.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"weftline.llm.{m}"), "ORACLE_SQL", {}).items()}
