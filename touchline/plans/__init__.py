"""Registered queries, grouped like the operator inventory."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every plan module so that its queries are registered."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
