"""Queries over the driver's tables and the DuckDB SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def FLAGSHIP(spark, sf_dir):
    """The discover-filter-deduplicate-cut path over ``pages``."""
    return QUERIES["newest_per_host"](spark, sf_dir)


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``, with its oracle where SQL expresses it."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add
