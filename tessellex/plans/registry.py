"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with QUERIES and SQL.
MODULES: tuple[str, ...] = ("corpus_queries", "record_queries", "builder_queries")


def _collect(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The query of the smoke check."""
    return queries()["flagship"](spark, folder)
