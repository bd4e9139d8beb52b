"""Aggregations that the pipelines share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.operators.windows import ranked


def share(part: Column, whole: Column, digits: int = 4, factor: float = 100.0) -> Column:
    return F.round(F.try_divide(factor * part, whole), digits)


def lift(rate: Column, baseline: Column, digits: int = 4) -> Column:
    """Null at a baseline of 0."""
    return F.round(F.try_divide(rate, baseline), digits)


def safe_sum(c: Column) -> Column:
    """Sum of what is a number."""
    return F.sum(F.coalesce(c.try_cast("double"), F.lit(0.0)))


def first_k_text(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], k: int = 3, sep: str = "; ", max_length: int = 200, name: str = "text") -> DataFrame:
    """The first k values of each group by the order and the value, joined and cut.

    The group is cut to k rows already in each task, and their texts are taken in the order in which the rows stand for
    that: nothing is collected, sorted or hashed again, and no group is ever held whole.
    """
    sort = [F.col(c) for c in (*order, value)]
    kept = ranked(df.filter(F.col(value).isNotNull()).select(*by, *order, value), by, sort, "_rank").filter(F.col("_rank") <= k)
    later = [F.lead(value, i).over(Window.partitionBy(*by).orderBy(*sort)) for i in range(1, k)]
    texts = kept.select(*by, "_rank", F.concat_ws(sep, value, *later).alias("_text")).filter("_rank = 1")
    return texts.select(*by, F.left("_text", F.lit(max_length)).alias(name))


def labelled_text(label: str, value: str, sep: str = ", ") -> Column:
    """Distinct "label: value" in order."""
    return F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", label, value))), sep)


def bucket(value: Column, edges: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first edge that the value doesn't exceed."""
    out = F.when(F.lit(False), "")
    for edge, label in edges:
        out = out.when(value <= edge, label)
    return out.otherwise(otherwise)


def histogram(df: DataFrame, label: Column, *sums: str, name: str = "bucket") -> DataFrame:
    return df.groupBy(label.alias(name)).agg(F.count("*").alias("n"), *[F.sum(s).alias(f"sum_{s}") for s in sums])


def changed_value(name: Column) -> Column:
    """Two or more distinct normalised names."""
    return F.count_distinct(F.upper(F.trim(name))) >= 2


def merge_sources(df: DataFrame, by: Sequence[str], source: str, confidence: str, attributes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: sorted distinct sources, the largest confidence, first non-null attributes by the order."""
    firsts = [F.min_by(F.when(F.col(a).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.struct(*order))).alias(a) for a in attributes]
    return df.groupBy(*by).agg(F.sort_array(F.collect_set(source)).alias("sources"), F.max(confidence).alias(confidence), *firsts)


def metric_report(df: DataFrame, **metrics: Column) -> DataFrame:
    """metric, value: one aggregation, turned to rows."""
    row = df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def gap_analysis(expected: DataFrame, found: DataFrame, key: str, target: str, n: str) -> DataFrame:
    """Gap and class of every key: full, partial or zero; a missing count is 0 and a surplus is no gap."""
    have = F.coalesce(F.col(n), F.lit(0))
    out = expected.join(found, key, "left").withColumn(n, have)
    status = F.when(F.col(n) >= F.col(target), "full").when(F.col(n) > 0, "partial").otherwise("zero")
    return out.withColumn("gap", F.greatest(F.lit(0), F.col(target) - F.col(n))).withColumn("status", status)


def profile(df: DataFrame, key: str, date: str) -> DataFrame:
    """Rows, keys, distinct keys, share of keyed rows and the range of a date."""
    return df.agg(F.count("*").alias("n_rows"), F.count(key).alias("n_keyed"), F.count_distinct(key).alias("n_keys"), share(F.count(key), F.count("*")).alias("pct_keyed"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def top_values(df: DataFrame, c: str, k: int) -> DataFrame:
    """The k most frequent values, by value at ties."""
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)


def value_formats(df: DataFrame, c: str, k: int) -> DataFrame:
    """The k most frequent formats of a text column (digits as 9, letters as A) with a sample: the smallest value of each."""
    shape = F.regexp_replace(F.regexp_replace(F.col(c), "[0-9]", "9"), r"[A-Za-z]", "A")
    return df.select(shape.alias("format"), F.col(c).alias("_v")).groupBy("format").agg(F.count("*").alias("n"), F.min("_v").alias("sample")).orderBy(F.desc("n"), "format").limit(k)


def adaptive_since(df: DataFrame, c: str, cutoff: str, floor: str) -> DataFrame:
    """Rows from the cutoff on; from the floor on if the source ends before the cutoff."""
    newest = df.agg(F.max(c).alias("_max"))
    start = F.when(F.col("_max") < F.lit(cutoff).cast("date"), F.lit(floor).cast("date")).otherwise(F.lit(cutoff).cast("date"))
    return df.crossJoin(F.broadcast(newest)).filter(F.col(c) >= start).drop("_max")
