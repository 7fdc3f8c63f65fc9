"""Every query of the library by name, with its SQL."""

from __future__ import annotations

import importlib

from .base import QUERIES

FAMILIES = ("access", "text", "delta", "search", "guard", "memory", "evaluation", "store", "folds", "more", "composite", "citing", "ingesting", "office")
for _name in FAMILIES:
    importlib.import_module(f"{__package__}.{_name}")


def flagship(spark, sf_dir):
    return QUERIES["retrieve"][0](spark, sf_dir)


def queries() -> dict:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
