"""Registration of queries: each has a Spark form over tables and, where SQL can express it, SQL for the same tables.

Domain tables that the driver's data lacks are derived from it by SQL text that Spark and other engines read alike, so that both sides of a comparison start
from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.derive import DERIVED

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FLAGSHIP = "a01_nearest_per_category"

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def needed(sql: str) -> list[str]:
    """Derived tables that sql reads, in an order in which each follows what it reads itself."""
    out: list[str] = []
    for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql):
        if name in DERIVED and name not in out:
            for inner in needed(DERIVED[name]):
                if inner not in out:
                    out.append(inner)
            if name not in out:
                out.append(name)
    return out


def with_derived(sql: str) -> str:
    names = needed(sql)
    return f"WITH {', '.join(f'{n} AS ({DERIVED[n]})' for n in names)} SELECT * FROM ({sql}) AS result" if names else sql


class Tables:
    """The tables of a folder, and the derived ones, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in DERIVED:
            raise AttributeError(name)
        sql = with_derived(f"SELECT * FROM {name}")
        used = [b for b in BASE if re.search(rf"\b(FROM|JOIN) {b}\b", sql)]
        for b in used:
            sql = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", sql)
        return self.spark.sql(sql, **{b: getattr(self, b) for b in used})


def query(name: str, sql: str | None = None):
    """Register a function of Tables under name."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = with_derived(sql)
        return f

    return add


def _load() -> None:
    from .plans import details, evidence, exports, geometry, knowledge, matching, networks, planning, reporting, scalars, search  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
