"""Registered queries."""

from __future__ import annotations

import importlib

MODULES = ("programs", "arithmetic", "texts", "files", "keyed_sets", "sql_statements", "ordering_reports", "comparisons", "graphs_jobs", "program_shapes")


def load():
    from recordloom.plans import registry

    for m in MODULES:
        importlib.import_module(f"recordloom.plans.{m}")
    return registry.QUERIES, registry.ORACLE
