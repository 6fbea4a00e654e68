"""Loads every module that registers queries."""

from importlib import import_module

MODULES = (
    "scalars",
    "replicates",
    "intervals",
    "ranking",
    "sampling",
    "learning",
    "sources",
)


def load() -> None:
    for name in MODULES:
        import_module(f"sitelab.plans.queries_{name}")
