"""Window-shaped operators; every order is total, so results don't depend on arrival."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_n(df, by, order, 1)


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Spark keeps at most n rows of a group in each task before it shuffles them."""
    return ranked(df, by, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, by: Sequence[str], order: Column, *ties: str) -> DataFrame:
    """The row with the largest order of each group, by aggregation alone."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(order, *ties)).alias("_row"))
    return best.select(*by, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def first_by_source(parts: Sequence[DataFrame], by: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Union of the parts in their order; the first row of a key wins."""
    out = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_part", F.lit(i)), allowMissingColumns=True)
    return best_per_group(out, by, [F.col("_part"), *[F.col(t) for t in ties]]).drop("_part")


def drop_last_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], counts: DataFrame, n: str) -> DataFrame:
    """Without the last n rows of each group, n by group from `counts`."""
    out = ranked(df.join(counts, list(by), "left"), by, order, "_back")
    return out.filter(F.col("_back") > F.coalesce(F.col(n), F.lit(0))).drop("_back", n)


def changes(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """The rows at which the value differs from the row before, with the earlier value in `previous`."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def global_rank(df: DataFrame, value: str, tie: str, name: str = "rank", cell_rows: int = 100_000, most_cells: int = 2000) -> DataFrame:
    """An exact rank from 0 over all rows, the largest value first and the smallest tie, without one task that sorts them all.

    Approximate quantiles, taken once, cut the values into cells of about `cell_rows` rows, at most `most_cells`. A
    value that holds a cell or more of its own is cut again by quantiles of the tie (a number). A running sum over the
    cells' counts gives where each begins, and rows are numbered inside their cell. The cuts only decide who counts
    where. Rows without a value come last.
    """
    at = [i / most_cells for i in range(1, most_cells)]
    cuts = df.agg(F.count("*").alias("n"), F.percentile_approx(value, at, 20_000).alias("v"), F.percentile_approx(tie, at, 20_000).alias("t")).first()
    step = -(-most_cells // max(1, min(most_cells, -(-cuts.n // cell_rows))))
    times = Counter((cuts.v or [])[step - 1 :: step])
    edges = sorted(times)
    heavy = sorted(e for e in edges if times[e] > 1)
    ties = sorted(set((cuts.t or [])[:: max(1, len(cuts.t or []) // max(times.values(), default=1))]))
    count_up_to = lambda cut, c: F.size(F.filter(F.array(*[F.lit(e) for e in cut]), lambda e: e < c)) if cut else F.lit(0)
    c = F.col(value)
    alone = c.isin(*heavy) if heavy else F.lit(False)
    place = F.struct(
        c.isNull().alias("none"), (-(count_up_to(edges, c) + F.when(c.isin(*edges), 1).otherwise(0) if edges else F.lit(0))).alias("part"),
        F.coalesce(alone, F.lit(False)).alias("alone"), F.when(alone, count_up_to(ties, F.col(tie))).otherwise(0).alias("tied"),
    )
    celled = df.withColumn("_cell", place)
    before = F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))  # a few rows for each cell
    starts = celled.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(F.desc_nulls_last(value), tie)) - 1
    return celled.withColumn("_in", inside).join(starts, "_cell").withColumn(name, F.col("_start") + F.col("_in")).drop("_cell", "_in", "_start")


def global_tiles(df: DataFrame, value: str, tie: str, tiles: int, name: str = "tile") -> DataFrame:
    """Tiles 1..n of the global order, the first ones a row larger where they can't be equal."""
    total = df.agg(F.count("*").alias("_total"))
    out = global_rank(df, value, tie, "_rank").crossJoin(F.broadcast(total))
    size, more = F.floor(F.col("_total") / tiles), F.col("_total") % tiles
    late = F.col("_rank") - more * (size + 1)
    tile = F.when(late < 0, F.floor(F.col("_rank") / (size + 1))).otherwise(more + F.floor(F.try_divide(late, size)))
    return out.withColumn(name, (tile + 1).cast("int")).drop("_rank", "_total")
