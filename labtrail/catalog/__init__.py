"""Named queries over the driver's tables and their check SQL."""

from __future__ import annotations

import importlib

AREAS = ["scalars", "records", "insights", "timelines", "patients", "accounts", "payloads", "quality", "looser", "streams", "dashboard", "folders"]
_loaded = False


def load():
    """Register every area once; returns (queries, check SQL)."""
    global _loaded
    from labtrail.catalog import registry

    if not _loaded:
        _loaded = True
        for area in AREAS:
            module = importlib.import_module(f"labtrail.catalog.{area}")
            module.register()
    return registry.QUERIES, registry.ORACLES
