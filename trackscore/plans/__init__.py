"""Query plans composed from the operators."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ["box_queries", "track_queries", "score_queries", "event_queries", "model_queries",
           "file_queries"]


def all_queries():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
