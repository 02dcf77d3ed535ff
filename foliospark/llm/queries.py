"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import importlib

#: In the order of the operator list.
MODULES = ("toxicity", "decontamination", "licenses", "quality", "near_dedup", "substring_dedup", "warc", "packing", "pii", "secrets")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"{__package__}.{m}").ORACLE.items()}
