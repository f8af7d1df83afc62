"""All registered queries, gathered from the modules of this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ("kpi", "charts", "profiling", "cleaning", "evaluation", "business", "linking", "classification", "boards", "loading")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"workload.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
