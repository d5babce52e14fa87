"""Queries over the driver tables, each with its SQL twin where one exists.

A stand-in is a table derived from a given table by SQL that both engines
read alike, so the twin and the DataFrame query start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STANDINS: dict[str, str] = {}


class Tables:
    """Lazy access to the given tables and the stand-ins of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in STANDINS:
            sql = STANDINS[name]
            used = {n: getattr(self, n) for n in _names_in(sql) if n != name}
            sql = sql.replace("{", "{{").replace("}", "}}")
            for n in used:
                sql = re.sub(rf"\b{n}\b", "{" + n + "}", sql)
            return self.spark.sql(sql, **used)
        raise AttributeError(name)


def _names_in(sql: str) -> list[str]:
    return [n for n in [*TABLES, *STANDINS] if re.search(rf"\b{n}\b", sql)]


def standin(name: str, sql: str) -> None:
    STANDINS[name] = sql


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def full_sql(sql: str) -> str:
    """Put the stand-ins a twin uses in front of it as common table expressions."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for n in _names_in(text):
            if n in STANDINS and n not in ordered:
                visit(STANDINS[n].replace(n, "")) if n in STANDINS[n] else visit(STANDINS[n])
                if n not in ordered:
                    ordered.append(n)

    visit(sql)
    if not ordered:
        return sql
    ctes = ", ".join(f"{n} AS ({STANDINS[n]})" for n in ordered)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
