"""Query registry: name -> (Spark builder, oracle SQL or None).

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables; the oracle is an independent DuckDB SQL text over the same
tables (views in ``plans.fixtures``). ``None`` marks fit-dependent or
non-SQL operators, checked by row count plus unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from plotwise.plans import q_prep, q_stats, q_similar, q_models, q_chain, q_recommender  # noqa: F401
