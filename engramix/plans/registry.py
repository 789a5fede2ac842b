"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.model import Model, with_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register ``f(model)`` under its name. ``needs``: model tables of the oracle, in order."""

    def register(f: Callable[[Model], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            if needs:
                head = with_model(*needs)
                if text[:14].upper() == "WITH RECURSIVE":
                    head, text = f"WITH RECURSIVE{head[4:]}", f"WITH{text[14:]}"
                text = f"{head}, {text[5:].lstrip()}" if text[:5].upper() == "WITH " else f"{head}\n{text}"
            ORACLE_SQL[f.__name__] = text
        return f

    return register
