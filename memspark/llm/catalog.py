"""The registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of this subpackage, one for each registered query.
MODULES = ("op1_quality_classifier", "op2_toxicity", "op3_minhash_near_dedup", "op4_html_extraction", "op5_best_fit_packing", "op6_token_counts", "op7_quality_rules", "op8_exact_topk", "op9_line_dedup", "op10_source_mixing", "op11_secret_scan", "op12_spelling_variants", "op13_conversation_repair")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"memspark.llm.queries.{_name}")
    QUERIES[_name] = _module.query
    if getattr(_module, "SQL", None):
        ORACLE_SQL[_name] = _module.SQL
