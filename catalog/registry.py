"""Collects the bound queries of every family."""

from __future__ import annotations

import importlib

FAMILIES = ["timeline", "session_align", "session_metrics", "text_tables", "history", "capture_tables"]


def _modules():
    return [importlib.import_module(f"catalog.{name}") for name in FAMILIES]


def queries() -> dict:
    out = {}
    for module in _modules():
        for name, (query, _sql) in module.QUERIES.items():
            assert name not in out, name
            out[name] = query
    return out


def oracle_sql() -> dict:
    return {n: sql for m in _modules() for n, (_q, sql) in m.QUERIES.items() if sql}
