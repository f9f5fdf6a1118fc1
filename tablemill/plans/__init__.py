"""Registered queries."""

import importlib

MODULES = ["sql_surface", "tables", "corpus", "records"]


def load_all() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        importlib.import_module(f"tablemill.plans.{name}")
