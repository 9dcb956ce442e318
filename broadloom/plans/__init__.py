"""Registered queries: each applies library operators to the tables of a data folder."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package, so that its queries register themselves."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
