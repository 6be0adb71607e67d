"""Runnable queries, one or more per operator, with SQL counterparts where SQL can say it."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("sources", "joins", "aggregates", "windows", "functions", "archive", "models", "streams"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
