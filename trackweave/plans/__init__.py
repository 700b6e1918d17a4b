"""All registered queries that are not part of the optional training-data subpackage."""

from __future__ import annotations

from importlib import import_module

from trackweave.plans.registry import ORACLES, QUERIES, Query

MODULES = ("prediction_plans", "graph_plans", "lineage_plans", "table_plans", "chain_plans", "crop_plans", "file_plans")


def _load() -> None:
    for name in MODULES:
        import_module(f"trackweave.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
