"""Domain views over the supplied tables and the registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def _load() -> None:
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")


def all_queries() -> dict:
    _load()
    from panelwright.plans.registry import QUERIES

    return dict(QUERIES)


def all_checks() -> dict:
    _load()
    from panelwright.plans.registry import CHECKS

    return dict(CHECKS)
