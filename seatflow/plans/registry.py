"""Loads every query module so the catalogue is complete."""

from __future__ import annotations

import importlib

from seatflow.plans.catalog import REGISTRY, Query

MODULES = ("seatflow.plans.q_tables", "seatflow.plans.q_replay", "seatflow.plans.q_changes",
           "seatflow.plans.q_stream")


def all_queries() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(m)
    return dict(REGISTRY)
