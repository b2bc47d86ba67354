"""Registered queries with the SQL they are checked against."""

from __future__ import annotations

import importlib

AREAS = ("usage", "text", "code", "routes", "guard", "live")


def _modules():
    return [importlib.import_module(f"quillmill.suite.{a}") for a in AREAS]


def all_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
