"""Registered queries: every operator applied to the given tables."""

from __future__ import annotations

from importlib import import_module

from corpusflow.plans.common import ORACLES, QUERIES

MODULES = ("web", "text", "discovery", "corpus", "activity", "retrieval", "streams")
for _name in MODULES:
    import_module(f"corpusflow.plans.{_name}")


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
