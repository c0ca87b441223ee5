"""All queries of the document engine, gathered from their modules."""

from __future__ import annotations

from vellum.plans import carried, house, layered, linked, manuscripts, numbered, prose, protocol, redlines, relational, tabled, workload
from vellum.plans.registry import Query

MODULES = (manuscripts, relational, prose, house, workload, redlines, linked, carried, numbered, protocol, tabled, layered)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        out.update(module.REGISTRY.queries())
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out.update(module.REGISTRY.oracle_sql())
    return out
