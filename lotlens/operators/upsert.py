"""Versions of keyed tables: each operator returns the new state, to be written as a whole or by partition."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.operators.observed import write_observed
from lotlens.operators.windows import best_per_group


def _sides(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with the new columns as _n_*, and _old, _new telling where a row comes from."""
    old = target.withColumn("_old", F.lit(True))
    new = updates.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in updates.columns if c not in keys], F.lit(True).alias("_new"))
    return old.join(new, list(keys), "full")


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """On a known key the update's values replace all columns but those to keep; unknown keys are added.

    Of several updates of a key the first of the order holds; the order must be total.
    """
    return upsert_marked(target, updates, keys, order, keep).drop("_change")


def upsert_marked(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """`upsert` with `_change`: new, updated (whether or not a value differs) or kept."""
    both = _sides(target, best_per_group(updates, keys, order), keys)
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c not in updates.columns:
            columns.append(F.col(c))
        else:
            take_new = F.col("_new").isNotNull() & (F.col("_old").isNull() if c in keep else F.lit(True))
            columns.append(F.when(take_new, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNotNull(), "updated").otherwise("kept")
    return both.select(*columns, change.alias("_change"))


def insert_first_wins(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    fresh = best_per_group(rows, keys, order).join(target, list(keys), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def insert_last_wins(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first of the order wins among the rows, and each row replaces what was there."""
    fresh = best_per_group(rows, keys, order)
    return target.join(fresh, list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def patch_non_null(target: DataFrame, detail: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Filled text fields of the detail overwrite, empty ones don't; of several filled ones the largest holds."""
    new = detail.groupBy(*keys).agg(*[F.max(c).alias(f"_n_{c}") for c in columns])
    out = target.join(new, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(f"_n_{c}"), F.lit("")), F.col(c)) for c in columns}).select(*target.columns)


def backfill_if_empty(target: DataFrame, lookup: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The lookup's value where the column is empty, the smallest of several."""
    out = target.join(lookup.groupBy(*keys).agg(F.min(column).alias("_fill")), list(keys), "left")
    empty = F.col(column).isNull() | (F.col(column) == "")
    return out.withColumn(column, F.when(empty, F.col("_fill")).otherwise(F.col(column))).select(*target.columns)


def reset_source(target: DataFrame, source: str, column: str = "source") -> DataFrame:
    return target.filter(~F.col(column).eqNullSafe(F.lit(source)))


def new_only(rows: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(processed, list(keys), "left_anti")


def evolve(df: DataFrame, **columns: object) -> DataFrame:
    """Adds absent columns with a default."""
    return df.withColumns({c: F.lit(v) for c, v in columns.items() if c not in df.columns})


def prefer_primary(primary: DataFrame | None, fallback: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The primary table, or the fallback with its missing columns as nulls."""
    chosen = fallback if primary is None else primary
    return chosen.select(*[F.col(c) if c in chosen.columns else F.lit(None).cast("string").alias(c) for c in columns])


def track_snapshot(state: DataFrame, pull: DataFrame, source: str, now: str) -> DataFrame:
    """New state of (source, source_id, price, status, first_seen, last_seen) after a pull of one source.

    What is pulled is active, with the first sight kept and the last one set; what this source no longer shows is
    inactive; other sources stay. An id that is pulled twice has the larger price.
    """
    now_col = F.lit(now).cast("timestamp")
    mine = pull.groupBy("source_id").agg(F.max(F.col("price").cast("double")).alias("_price")).select(F.lit(source).alias("source"), "source_id", "_price", F.lit(True).alias("_pulled"))
    both = state.join(mine, ["source", "source_id"], "full")
    seen = F.col("_pulled").isNotNull()
    return both.select(
        "source", "source_id",
        F.when(seen, F.col("_price")).otherwise(F.col("price")).alias("price"),
        F.when(seen, "active").when(F.col("source") == source, "inactive").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen", now_col).alias("first_seen"),
        F.when(seen, now_col).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def append_daily_price(history: DataFrame, pull: DataFrame, source: str, day: str) -> DataFrame:
    """One price row per listing and day, the larger price of an id that is pulled twice; a second pull of the day replaces the first."""
    prices = pull.groupBy("source_id").agg(F.max(F.col("price").cast("double")).alias("price"))
    fresh = prices.select(F.lit(source).alias("source"), "source_id", F.lit(day).cast("date").alias("snapshot_date"), "price")
    return history.join(fresh, ["source", "source_id", "snapshot_date"], "left_anti").unionByName(fresh)


def run_log(phase: str, processed: DataFrame, inserted: DataFrame, at: str, notes: str = "") -> DataFrame:
    """One audit row of a run."""
    n = processed.agg(F.count("*").alias("processed")).crossJoin(inserted.agg(F.count("*").alias("inserted")))
    return n.select(F.lit(phase).alias("phase"), "processed", "inserted", F.lit(at).cast("timestamp").alias("run_at"), F.lit(notes).alias("notes"))


def observed_run(write: Callable[[DataFrame], None], rows: DataFrame, inserted: Column, phase: str, at: str, notes: str = "") -> DataFrame:
    """Writes the rows and gives the audit row of the run, with counts that the writing plan itself observed."""
    n = write_observed(rows, write, processed=F.count("*"), inserted=F.count_if(inserted))
    return rows.sparkSession.range(1).select(F.lit(phase).alias("phase"), *[F.lit(n[c]).cast("bigint").alias(c) for c in ("processed", "inserted")], F.lit(at).cast("timestamp").alias("run_at"), F.lit(notes).alias("notes"))
