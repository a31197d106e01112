"""All queries of the engine's own operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curvespark.plans import kernels, more, native

assert kernels  # registers its queries
native.SQL.update(more.TWINS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.QUERIES["certified_range"](spark, sf_dir)


def queries() -> dict:
    return dict(native.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(native.SQL)
