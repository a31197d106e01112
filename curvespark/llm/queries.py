"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

#: Module and function of each query, in the operators' order.
OPERATORS = (
    ("suffix_tree", "op1_lm_score"), ("licences", "op2_license_scan"), ("language", "op3_language_id"), ("neardup", "op4_near_dedup"), ("packing", "op5_packing"),
    ("bpe", "op6_bpe"), ("toxicity", "op7_toxicity"), ("quality", "op8_quality_rules"), ("warc", "op9_warc"), ("topk", "op10_exact_topk"),
)


def queries() -> dict:
    import corpus_pipeline

    out = {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for module, name in OPERATORS}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None) for module, name in OPERATORS}
    out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {k: v for k, v in out.items() if v}
