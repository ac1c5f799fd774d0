"""The runnable queries and their oracles."""

from importlib import import_module

MODULES = ["matching_cases", "text_cases", "grid_cases", "nested_cases", "freetext_cases", "mixed_cases", "sink_cases"]


def load_cases() -> None:
    for name in MODULES:
        import_module(f"suite.{name}")
