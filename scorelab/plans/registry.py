"""Loads every query module and exposes the registered queries and oracles."""

from __future__ import annotations

import importlib

from scorelab.plans import catalog

_MODULES = [
    "scorelab.plans.scoring_queries",
    "scorelab.plans.analytics_queries",
    "scorelab.plans.text_queries",
    "scorelab.plans.stream_queries",
    "scorelab.plans.io_queries",
    "scorelab.plans.sketch_queries",
    "scorelab.plans.robust_queries",
]


def _load():
    for m in _MODULES:
        importlib.import_module(m)


def all_queries():
    _load()
    return dict(catalog.QUERIES)


def all_oracles():
    _load()
    return dict(catalog.ORACLES)
