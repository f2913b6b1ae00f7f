"""All registered queries and checks."""

from __future__ import annotations

import importlib

from pulsegrid.plans.registry import CHECKS, QUERIES

GROUPS = [
    "population_queries",
    "source_queries",
    "cleaning_queries",
    "grading_queries",
    "advice_queries",
    "history_queries",
    "model_queries",
    "risk_queries",
    "stream_queries",
]

for _name in GROUPS:
    importlib.import_module(f"pulsegrid.plans.{_name}")

__all__ = ["CHECKS", "QUERIES"]
