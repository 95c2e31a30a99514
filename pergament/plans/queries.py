"""All queries of the library: importing the modules fills the registry."""

from __future__ import annotations

from pergament.plans import box_queries, record_queries, text_queries  # noqa: F401
from pergament.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
