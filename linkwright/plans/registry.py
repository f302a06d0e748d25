"""Registered queries by name, and the SQL that each one matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add
