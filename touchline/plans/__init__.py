"""Whole pipelines and the registered queries with their SQL oracles."""

from importlib import import_module

MODULES = ("tables", "scalars", "histories", "inplay", "networks", "forecasts", "fits", "outputs", "streams")


def load_queries() -> None:
    """Import every query module once; importing registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
