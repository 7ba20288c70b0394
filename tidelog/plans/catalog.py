"""The registry of queries: each operator is registered once, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = tuple(f"tidelog.plans.{m}_queries" for m in ("log", "scan", "scalar", "aggregate", "checker", "maintenance", "decode", "stream", "lifecycle"))


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``."""

    def register(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return register


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES
