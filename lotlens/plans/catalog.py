"""The registered queries and, under the same names, SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotlens.plans import areas, basics, build, curated, curated_more, embedded, files, listings, lookups, profiles, pulls, scalars, scoring, serving, state, streams, texts, units, validation, versions  # noqa: F401  they register
from lotlens.plans.registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.signal_lift(Tables(spark, sf_dir))
