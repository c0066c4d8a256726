"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Modules in the order of their operators.
MODULES = ["url_filter", "decontaminate", "materialise", "nndescent", "quality", "html_extract", "pii", "chat", "jaccard", "pack", "codec", "hard_negatives", "align"]


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{module}"), name, {})
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE_SQL")
