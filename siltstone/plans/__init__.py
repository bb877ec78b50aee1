"""Registered queries of the library."""

import importlib

MODULES = ("text_queries", "keyword_queries", "dedup_queries", "relational_queries", "split_queries", "stats_queries", "item_queries", "stream_queries", "convert_queries", "build_queries", "more_queries")


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
