"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: module -> (query functions, {query: SQL constant})
_MODULES = {
    "ann_tree": (["op9_nearest_neighbours"], {}),
    "exact_dedup": (["op10_exact_dedup"], {"op10_exact_dedup": "OP10_SQL"}),
    "fill_in_middle": (["op11_fill_in_middle"], {"op11_fill_in_middle": "OP11_SQL"}),
    "filter_audit": (["op12_filter_audit"], {"op12_filter_audit": "OP12_SQL"}),
    "html_extract": (["op5_main_text"], {}),
    "language_id": (["op13_language_id"], {}),
    "mixing": (["op2_mixing"], {"op2_mixing": "OP2_SQL"}),
    "near_dedup": (["op6_near_dedup"], {"op6_near_dedup": "OP6_SQL"}),
    "packing": (["op8_packing"], {}),
    "suffix_dedup": (["op1_suffix_dedup"], {"op1_suffix_dedup": "OP1_SQL"}),
    "token_count": (["op4_token_count"], {}),
    "token_store": (["op3_token_store"], {}),
    "toxicity": (["op7_toxicity"], {}),
}


def queries() -> dict:
    out = {}
    for module, (names, _) in _MODULES.items():
        loaded = importlib.import_module(f"arborel.llm.{module}")
        out |= {name: getattr(loaded, name) for name in names}
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for module, (_, sql) in _MODULES.items():
        loaded = importlib.import_module(f"arborel.llm.{module}")
        out |= {name: getattr(loaded, constant) for name, constant in sql.items()}
    return out
