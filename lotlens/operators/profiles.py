"""Profiles of a table's columns as states that merge: kept by source and day, never read again.

A state holds, for each column, its filled rows and extremes, a HyperLogLog sketch of its distinct values, a KLL sketch
of a number's quantiles, and counts of its values. The states of many sources and days merge into that of any
set of them. Stated errors: distinct values within 1.5 % (2^`LG_K` registers, at 1 sigma 0.8 %), quantiles within 1.7 %
of the ranks (k = 200); frequent values are counted exactly, over whole values: a state keeps the counts of all of them
unless `kept` bounds it, and then a merged count is low by at most the smallest kept count of each state that does
not hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.operators.windows import first_n

LG_K = 14


def _kind(df: DataFrame, c: str) -> str:
    return dict(df.dtypes)[c]


def _is_number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def column_states(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row for each group and column: rows, filled, least and most (as text), distinct and quantile sketches.

    One pass over the table and one partial aggregation for all columns. NaN counts as empty.
    """
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(columns):
        number = _is_number(_kind(df, c))
        value = F.when(~F.isnan(c), F.col(c)) if _kind(df, c) in ("float", "double") else F.col(c)
        text = value.cast("string")
        aggs += [F.count(value).alias(f"_n{i}"), F.min(value).cast("string").alias(f"_a{i}"), F.max(value).cast("string").alias(f"_z{i}"), F.hll_sketch_agg(text, LG_K).alias(f"_d{i}")]
        aggs += [(F.kll_sketch_agg_double(value.cast("double")) if number else F.lit(None).cast("binary")).alias(f"_q{i}"), F.lit(number).alias(f"_t{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    each = [F.struct(F.lit(c).alias("column"), F.col(f"_t{i}").alias("number"), F.col(f"_n{i}").alias("filled"), F.col(f"_a{i}").alias("least"), F.col(f"_z{i}").alias("most"), F.col(f"_d{i}").alias("distinct"), F.col(f"_q{i}").alias("quantiles")) for i, c in enumerate(columns)]
    return wide.select(*by, F.col("_rows").alias("rows"), F.explode(F.array(*each)).alias("_s")).select(*by, "rows", "_s.*")


def value_states(df: DataFrame, by: Sequence[str], columns: Sequence[str], kept: int | None = None) -> DataFrame:
    """The values of each group and column with their counts: all, or the `kept` most frequent ones."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    n = df.select(*by, pairs.alias("_p")).select(*by, "_p.*").filter("value is not null").groupBy(*by, "column", "value").agg(F.count("*").alias("n"))
    return n if kept is None else first_n(n, [*by, "column"], [F.desc("n"), F.col("value")], kept)


def merged_profile(states: DataFrame, by: Sequence[str] = (), at: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """by, column, rows, filled, least, most, n_distinct, quantiles (at the given ranks, of numbers) of merged states."""
    least = lambda f, c: F.when(F.bool_or("number"), f(F.col(c).try_cast("double")).cast("string")).otherwise(f(c))
    merged = states.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), least(F.min, "least").alias("least"), least(F.max, "most").alias("most"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"), F.bool_or("number").alias("number"), F.kll_merge_agg_double("quantiles").alias("_q"),
    )
    ranks: list[Column] = [F.when(F.col("number") & (F.col("filled") > 0), F.kll_sketch_get_quantile_double("_q", F.lit(float(x)))) for x in at]
    return merged.select(*by, "column", "rows", "filled", "least", "most", "n_distinct", F.array(*ranks).alias("quantiles"))


def merged_values(states: DataFrame, by: Sequence[str] = (), n: int = 10) -> DataFrame:
    """by, column, value, n of the most frequent values over merged states."""
    total = states.groupBy(*by, "column", "value").agg(F.sum("n").alias("n"))
    return first_n(total, [*by, "column"], [F.desc("n"), F.col("value")], n)
