"""Registered relational queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritstone.plans import dialect
from gritstone.sources.catalog import Catalog, tables_in, with_views
from gritstone.sources.templates import ALL, PREVIOUS_ROW, PREVIOUS_ROW_ORACLE, Template


def run_template(template: Template) -> Callable[[SparkSession, str], DataFrame]:
    """The template over a folder's tables, bound with typed arguments."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        Catalog(spark, sf).register(tables_in(template.sql))
        used = dialect.positions(template.sql)
        types, values = dict(enumerate(template.types, 1)), dict(enumerate(template.values, 1))
        return spark.sql(dialect.to_spark(template.sql), args=dialect.bind(types, values, used))

    return run


def previous_row(spark: SparkSession, sf: str) -> DataFrame:
    Catalog(spark, sf).register(["lineitem"])
    return spark.sql(PREVIOUS_ROW)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run_template(t) for name, t in ALL.items()} | {"rw_09": previous_row}
ORACLES: dict[str, str] = {name: with_views(dialect.inline(t.sql, t.types, t.values)) for name, t in ALL.items()} | {"rw_09": with_views(PREVIOUS_ROW_ORACLE, ["lineitem"])}
