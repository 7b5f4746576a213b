"""Every operator as a runnable query over the driver tables, with its check SQL."""

from __future__ import annotations

import importlib

MODULES = (
    "profiling", "quality", "cleaning", "filters", "metrics", "grouped", "joins", "retail", "verification", "ledgers",
    "routing", "evidence", "sources",
)


def load() -> dict:
    """Imports all query modules and returns the registry."""
    from grainwise.queries.base import REGISTRY

    for name in MODULES:
        importlib.import_module(f"grainwise.queries.{name}")
    return REGISTRY
