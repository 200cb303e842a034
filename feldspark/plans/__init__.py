"""Runnable plans. ``load_catalog`` imports every module that registers queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return importlib.import_module(f"{__name__}.catalog")
