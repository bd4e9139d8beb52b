"""Counts that a writing plan observes in the pass that writes."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation


def write_observed(df: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict[str, int]:
    """Writes `df` and gives the named aggregates over them, without another scan.

    A plan that Spark finds to be empty while it runs drops the node that observes: then all counts are 0.
    """
    seen = Observation()
    write(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    try:
        found = seen.get
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        found = {}
    return {name: found.get(name) or 0 for name in counts}
