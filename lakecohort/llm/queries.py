"""Queries of the training-data operators, by the names under which they are registered, and SQL where it can express them."""

from __future__ import annotations

from importlib import import_module

#: name -> module of this package that has a function of that name
MODULES = {
    "op1_language_id": "langid",
    "op2_topk_search": "maxscore",
    "op3_token_counts": "bpe_count",
    "op4_decontaminate": "decontaminate",
    "op5_lm_score": "ppm",
    "op6_substring_dedup": "paragraphs",
    "op7_token_matrix": "bestfit",
    "op8_minhash_dedup": "minhash",
    "op9_html_text": "html",
    "op10_packing": "packing",
    "op11_pattern_packing": "pattern_packing",
    "op12_merkle_manifest": "merkle",
    "op13_filter_audit": "filter_audit",
}


def queries() -> dict:
    def lazy(name, module):
        return lambda spark, sf_dir: getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return {name: lazy(name, module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
