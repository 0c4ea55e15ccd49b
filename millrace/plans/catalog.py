"""All queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under a name."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


from millrace.plans import analysis, capability, charts, comparisons, designed, discrimination, evaluation, experiments, models, orthogonal, panels, processes, stats, trajectories, tshaped  # noqa: E402, F401
