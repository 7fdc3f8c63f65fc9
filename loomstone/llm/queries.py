"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

#: name: module of this package that has ``query`` and perhaps ``ORACLE_SQL``.
MODULES = {
    "op1_edit_fingerprints": "edit_fingerprint",
    "op2_language_id": "language_id",
    "op3_tiff_media": "tiff",
    "op4_line_dedup": "line_dedup",
    "op5_ngram_jaccard_join": "jaccard_join",
    "op6_lm_scoring": "lm_scoring",
    "op7_best_fit_packing": "packing",
    "op8_substring_dedup": "substring_dedup",
    "op9_suffix_array_dedup": "suffix_dedup",
    "op10_bpe_codec": "bpe",
    "op11_filter_audit": "filter_audit",
    "op12_lexical_search": "lexical_search",
    "op13_secret_scan": "secret_scan",
}


def _run(module: str):
    def query(spark, sf_dir):
        return importlib.import_module(f"{__package__}.{module}").query(spark, sf_dir)

    return query


def queries() -> dict:
    return {name: _run(m) for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {k: v for k, v in found.items() if v}
