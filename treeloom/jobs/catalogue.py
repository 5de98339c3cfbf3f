"""Registered queries of the library, and the SQL that must give the same rows."""

from __future__ import annotations

import importlib

MODULES = ("texts", "vectors", "activity", "streams", "trees", "building")


def queries() -> dict:
    out = {}
    for m in MODULES:
        out.update(importlib.import_module(f"treeloom.jobs.{m}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        out.update(importlib.import_module(f"treeloom.jobs.{m}").ORACLES)
    return out
