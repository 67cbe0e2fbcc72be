"""Named queries over the given tables with their check SQL."""

import importlib

PARTS = ("tables", "timeline", "dashboard", "outliers", "prediction", "live")


def load():
    """All registered queries and checks."""
    from dockflow.catalog import base

    for part in PARTS:
        importlib.import_module(f"dockflow.catalog.{part}")
    return base.QUERIES, base.CHECKS
