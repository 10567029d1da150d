"""Registered queries, one module per operator family."""

from __future__ import annotations

from importlib import import_module

from loomframe.plans.registry import ORACLES, QUERIES, Query

MODULES = (
    "flagship",
    "reading",
    "shaping",
    "writing",
    "joining",
    "grouping",
    "scalars",
    "searching",
    "spatial",
    "checking",
    "increments",
    "building",
    "tracing",
    "timing",
)


def _load() -> None:
    for name in MODULES:
        import_module(f"loomframe.plans.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
