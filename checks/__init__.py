"""Registered queries, their inputs and their DuckDB counterparts."""


def load() -> None:
    """Imports the modules that register queries."""
    import importlib
    for name in ("sources_events", "search_joins", "aggregates", "scores", "streams"):
        importlib.import_module(f"checks.{name}")
