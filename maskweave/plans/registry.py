"""All registered queries: name → (spark builder, oracle SQL builder or None)."""

from __future__ import annotations

from maskweave.plans import core, iac, more, payloads, rules_plans, scans

REGISTRY: dict = {}
for _mod in (core, scans, iac, rules_plans, more, payloads):
    REGISTRY.update(_mod.QUERIES)


def queries() -> dict:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict:
    return {k: v[1]() for k, v in REGISTRY.items() if v[1] is not None}
