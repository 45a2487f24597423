"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: query name -> module and function.
WHERE = {
    "op1_media_columns": "media",
    "op2_html_extraction": "html_text",
    "op3_best_fit_packing": "packing",
    "op4_toxicity": "toxicity",
    "op5_sentencepiece": "sentencepiece_fst",
    "op6_secret_scans": "secrets",
    "op7_license_scans": "licenses",
    "op8_pii": "pii",
    "op9_quality_rules": "quality",
    "op10_near_duplicates": "near_duplicates",
    "op11_importance_resampling": "resampling",
    "op12_pu_quality": "pu_quality",
    "op13_filter_audit": "filter_audit",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tidemark.llm.{module}"), name) for name, module in WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm.filter_audit import OP13_SQL
    from tidemark.llm.quality import OP9_SQL

    return {"op9_quality_rules": OP9_SQL, "op13_filter_audit": OP13_SQL}
