"""Query catalogue: name -> (Spark builder, DuckDB oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a DataFrame; the oracle runs on DuckDB views
of the same Parquet tables. A missing oracle means a rows-only check (iterative fitting,
random draws).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    ops: tuple[str, ...]
    bench: bool = True


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, ops: tuple[str, ...] = (), bench: bool = True):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, sql, ops, bench)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    """Import every query module (they register on import) and return the registry."""
    from rankspark.plans import (  # noqa: F401
        q_embeddings,
        q_events,
        q_files,
        q_fit,
        q_orders,
        q_prompts,
        q_responses,
    )

    return REGISTRY
