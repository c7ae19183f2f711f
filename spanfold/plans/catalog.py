"""All registered queries; importing the query modules fills the registry."""

from __future__ import annotations

import importlib

from spanfold.plans.registry import REGISTRY

QUERY_MODULES = ("q_metrics", "q_spans", "q_tokens", "q_candidates", "q_model")

for _m in QUERY_MODULES:
    importlib.import_module(f"spanfold.plans.{_m}")


def queries():
    return {name: fn for name, (fn, _sql) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_fn, sql) in REGISTRY.items() if sql is not None}
