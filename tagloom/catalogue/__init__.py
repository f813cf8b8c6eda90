"""Every registered query with its SQL oracle."""

from importlib import import_module

from tagloom.catalogue.base import ORACLES, QUERIES

MODULES = ["scan", "joins", "aggregates", "windows", "quality", "relation", "features", "learning", "streams", "reports"]
for _name in MODULES:
    import_module(f"tagloom.catalogue.{_name}")

__all__ = ["ORACLES", "QUERIES"]
