"""All registered queries. Importing this module fills the registry."""

from __future__ import annotations

import importlib

from binlens.plans.registry import ORACLE, QUERIES

_MODULES = ["q_evaluate", "q_extract", "q_prepare", "q_models", "q_select", "q_stream"]
for _m in _MODULES:
    importlib.import_module(f"binlens.plans.{_m}")

__all__ = ["QUERIES", "ORACLE"]
