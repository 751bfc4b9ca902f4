"""The core's query modules; each has QUERIES (name -> callable(spark, root)) and SQL (name -> DuckDB text)."""

from __future__ import annotations

from importlib import import_module

NAMES = ("records", "corpus", "relations")


def modules() -> list:
    return [import_module(f"codeloom.plans.{name}") for name in NAMES]
