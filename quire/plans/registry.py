"""Query register: Spark queries beside their SQL oracles, and the inputs both derive.

A derived input is written once in SQL both engines read, or twice where a function
differs. Queries take it as a DataFrame, oracles as a common table expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.session import spread

# tables with long texts or many rows for per-row work, and their ids
SPREAD = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id", "lineitem": "l_orderkey"}
BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
DERIVED: dict[str, tuple[str, str]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def derive(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    DERIVED[name] = (spark_sql, duck_sql or spark_sql)


def _needed(sql: str) -> list[str]:
    """Derived inputs a statement names, dependencies first."""
    out: list[str] = []
    for name, (a, b) in DERIVED.items():
        if re.search(rf"\b{name}\b", sql):
            for dep in _needed(a + " " + b):
                if dep not in out and dep != name:
                    out.append(dep)
            if name not in out:
                out.append(name)
    return out


def oracle(sql: str) -> str:
    """Statement with the inputs it names in front of it."""
    names = _needed(sql)
    ctes = [f"{n} AS ({DERIVED[n][1].strip()})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[5:]]) if ctes else body
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


class Tables:
    """Tables of one folder and the inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table, SPREAD[name]) if name in SPREAD else table
        sql, _ = DERIVED[name]
        needed = [n for n in [*BASE, *_needed(sql)] if re.search(rf"\b{n}\b", sql) and n != name]
        text = re.sub(r"[{}]", lambda m: m.group(0) * 2, sql)
        for n in needed:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in needed})


def query(name: str, sql: str | None = None):
    """Register ``f(tables)`` under ``name`` with its oracle."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return register
