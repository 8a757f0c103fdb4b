"""All registered queries and oracles."""

from __future__ import annotations

import importlib

MODULES = ["q_curate", "q_chat", "q_validate", "q_metrics", "q_geometry", "q_tokens", "q_io"]


def load():
    for m in MODULES:
        importlib.import_module(f"tessera.plans.{m}")
    from .registry import ORACLES, QUERIES
    return QUERIES, ORACLES
