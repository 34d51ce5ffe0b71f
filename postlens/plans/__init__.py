"""Operators bound to the test tables."""

from __future__ import annotations

import importlib
import pkgutil


def registered():
    """(queries, oracles) of every queries_* module."""
    from postlens.plans import catalog

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return dict(catalog.QUERIES), dict(catalog.ORACLES)
