"""Collects every query module."""

import importlib
import os

from catalog.common import ORACLE, QUERIES

for _name in sorted(f[:-3] for f in os.listdir(os.path.dirname(__file__)) if f.endswith("_queries.py")):
    importlib.import_module(f"catalog.{_name}")

__all__ = ["QUERIES", "ORACLE"]
