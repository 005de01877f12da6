"""The query catalogue: one callable for each query, and its oracle SQL."""

from __future__ import annotations

from tessera.plans import q_agg, q_func, q_join, q_scan
from tessera.plans.registry import Query

BLOCKS = (q_scan.BLOCK, q_agg.BLOCK, q_join.BLOCK, q_func.BLOCK)


def queries() -> dict[str, Query]:
    return {name: q for block in BLOCKS for name, q in block.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for block in BLOCKS for name, sql in block.oracle.items()}
