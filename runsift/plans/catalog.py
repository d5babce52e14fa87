"""Imports every query module once."""

from importlib import import_module

MODULES = ["summary_queries", "relational_queries", "gate_queries", "token_queries", "text_queries", "file_queries", "model_queries", "builder_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"runsift.plans.{name}")
