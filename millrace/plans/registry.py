"""Named queries over the test tables, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.feeds import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: Tables of long texts.
TEXTS = ("documents", "pages")


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        found = table(self.spark, self.folder, name)
        return spread(found) if name in TEXTS else found


def query(name: str, sql: str | None = None):
    """Register ``f(t)``, t the tables; ``sql`` gives the same rows in DuckDB."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


from . import changes, domain, relational, scalars  # noqa: E402, F401
