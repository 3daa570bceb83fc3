"""Imports every query module so that the registry is full."""

import importlib
import pkgutil

from streetgrove.plans import queries as _queries
from streetgrove.plans.registry import MODULE_OF, ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(_queries.__path__)):
    importlib.import_module(f"{_queries.__name__}.{_module}")

__all__ = ["MODULE_OF", "ORACLES", "QUERIES"]
