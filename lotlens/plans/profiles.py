"""Profiles by source and day, merged without reading the table again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.operators import profiles
from lotlens.plans.files import scratch
from lotlens.plans.registry import Tables, query

COLUMNS = ("event_id", "user_id", "value", "name")


def _rows(t: Tables) -> DataFrame:
    """Events with a text column; some values are missing."""
    name = F.when(F.col("event_id") % 7 > 0, F.concat("event_type", (F.col("user_id") % 13).cast("string")))
    return t.events.select("event_type", F.col("ts").cast("date").alias("day"), "event_id", "user_id", F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("value"), name.alias("name"))


def _stored(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The states of each source and day, written and read back."""
    path = scratch(t.spark)
    profiles.column_states(_rows(t), ["event_type", "day"], COLUMNS).write.parquet(f"{path}/columns")
    profiles.value_states(_rows(t), ["event_type", "day"], ["user_id", "name"]).write.parquet(f"{path}/values")
    return t.spark.read.parquet(f"{path}/columns"), t.spark.read.parquet(f"{path}/values")


_EVENTS = "WITH e AS (SELECT event_type, event_id, user_id, CASE WHEN event_id % 5 > 0 THEN value END AS value, CASE WHEN event_id % 7 > 0 THEN event_type || (user_id % 13) END AS name FROM events) "


@query(_EVENTS + " UNION ALL ".join(f"SELECT event_type, '{c}' AS \"column\", count(*) AS rows, count({c}) AS filled, {'NULL' if c == 'name' else f'CAST(min({c}) AS DOUBLE)'} AS least, {'NULL' if c == 'name' else f'CAST(max({c}) AS DOUBLE)'} AS most, true AS distinct_within, true AS median_within FROM e GROUP BY 1" for c in COLUMNS))
def merged_profiles(t: Tables) -> DataFrame:
    """Counts and extremes exactly, distinct values and medians within the stated errors, by source over all days."""
    columns, _ = _stored(t)
    merged = profiles.merged_profile(columns, ["event_type"])
    long = _rows(t).select("event_type", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"), F.lit(None if c == "name" else True).alias("number")) for c in COLUMNS])).alias("x")).select("event_type", "x.*")
    value = F.col("v").try_cast("double")
    asked = merged.select("event_type", "column", F.col("quantiles")[0].alias("median"))
    exact = long.join(asked, ["event_type", "column"]).groupBy("event_type", "column").agg(F.count_distinct("v").alias("exact"), F.count_if(value < F.col("median")).alias("below"), F.count_if(value <= F.col("median")).alias("upto"), F.count("v").alias("n"))
    out = merged.join(exact, ["event_type", "column"])
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 1 + 0.03 * F.col("exact")
    middle = F.col("quantiles")[0].isNull() | ((F.col("below") <= 0.535 * F.col("n")) & (F.col("upto") >= 0.465 * F.col("n")))
    return out.select("event_type", "column", "rows", "filled", F.col("least").try_cast("double").alias("least"), F.col("most").try_cast("double").alias("most"), near.alias("distinct_within"), middle.alias("median_within"))


@query(_EVENTS + " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM e WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT 10)" for c in ("user_id", "name")))
def merged_top_values(t: Tables) -> DataFrame:
    """The most frequent values over all sources and days, from the states' counts."""
    return profiles.merged_values(_stored(t)[1])
