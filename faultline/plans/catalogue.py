"""All registered queries and their SQL oracles, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ["core_problems", "measures", "relational", "lsh", "szz", "quality", "experiments", "sources"]


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        try:
            module = importlib.import_module(f"faultline.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"faultline.plans.{m}":
                raise
            continue
        out.update(getattr(module, name, {}))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
