"""Registry of named queries (one per operator of the inventory) and their DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the given tables; ``ORACLE[name]`` is
the equivalent DuckDB SQL over the same tables when one exists.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # model fits last: the heaviest queries run after every relational one
    from sluice.catalog import curation, evaluation, lines, effort, denoise, sinks, models  # noqa: F401
