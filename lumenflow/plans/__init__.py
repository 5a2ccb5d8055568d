"""Queries over the standard tables, one module for each family of operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("catalogue", "streams", "kernels", "scalars", "formats", "relational", "maintenance", "timing", "signals", "planes")


def load_all() -> None:
    """Imports every module of queries, which registers them."""
    for m in MODULES:
        import_module(f"{__name__}.{m}")
