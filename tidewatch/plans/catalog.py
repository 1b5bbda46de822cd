"""Collects every registered query."""

from __future__ import annotations

import importlib

from tidewatch.plans.registry import ORACLES, QUERIES

_MODULES = ("q_series", "q_ingest", "q_eval", "q_scoring")


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tidewatch.plans.{m}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return {name: build() for name, build in ORACLES.items()}
