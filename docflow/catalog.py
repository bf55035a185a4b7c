"""All named queries of the engine and their SQL counterparts."""

from __future__ import annotations

import importlib

_MODULES: list[str] = ["docflow.queries_text", "docflow.queries_state", "docflow.queries_diag", "docflow.queries_io", "docflow.queries_saves"]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= importlib.import_module(m).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= importlib.import_module(m).ORACLE
    return out
