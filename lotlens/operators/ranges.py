"""Halving of over-full value ranges until each holds fewer rows than a source gives out at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Range = tuple[int | None, int | None]


def _ends(lo: Column, hi: Column, open_width: int) -> tuple[Column, Column]:
    """Ends to halve between: an open low end is 0, an open high end three times the low one (or `open_width`)."""
    low = F.coalesce(lo, F.lit(0).cast("bigint"))
    return low, F.coalesce(hi, F.when(low > 0, low * 3).otherwise(F.lit(open_width).cast("bigint")))


def _splits(lo: Column, hi: Column, least_width: int, open_width: int) -> Column:
    low, high = _ends(lo, hi, open_width)
    return high - low >= max(2, least_width)


def _middle(lo: Column, hi: Column, open_width: int) -> Column:
    low, high = _ends(lo, hi, open_width)
    return F.floor((low + high) / 2).cast("bigint")


def _levels(r: Range, most: int, least_width: int, open_width: int) -> int:
    """How often a range can be halved before what is left holds no value up to `most` or is too narrow."""
    lo, hi = r
    if hi is not None:
        n, width = 0, hi - (lo or 0)
        while width >= max(2, least_width):
            width, n = width - width // 2, n + 1
        return n
    low = lo or 0
    if low > most:
        return 0
    middle = (low + (low * 3 if low > 0 else open_width)) // 2
    return 1 + max(_levels((lo, middle), most, least_width, open_width), _levels((middle, None), most, least_width, open_width))


def halved_ranges(df: DataFrame, value: str, ranges: Sequence[Range], cap: int, least_width: int, open_width: int) -> DataFrame:
    """lo, hi (half open, null is an open end), n and complete of the ranges that are left.

    A range with `cap` rows or more is halved at the middle of its ends, rounded down, as long as it is `least_width`
    wide or more; then it stays over-full. Empty halves are ranges too. The ranges must not overlap; values in none of
    them, and nulls, count nowhere; a fraction falls where its number does.

    The way of a value down the halves does not depend on the counts, so the rows (first reduced to counts of distinct
    values) are counted in the ranges of all levels by one aggregation; which of these were ever opened follows from
    the counts alone, since no half holds more than its whole.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    most = df.agg(F.max(value)).first()[0]
    depth = max((_levels(r, int(most) if most is not None else 0, least_width, open_width) for r in ranges), default=0)
    end = lambda x: F.lit(x).cast("bigint")
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col("v") >= lo) & (F.lit(True) if hi is None else F.col("v") < hi)
    first = F.coalesce(*[F.when(inside(lo, hi), F.struct(end(lo).alias("lo"), end(hi).alias("hi"))) for lo, hi in ranges])

    def down(path: Column, _: Column) -> Column:
        at = F.element_at(path, -1)
        mid = _middle(at["lo"], at["hi"], open_width)
        half = F.when(F.col("v") < mid, F.struct(at["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), at["hi"].alias("hi")))
        return F.when(_splits(at["lo"], at["hi"], least_width, open_width), F.concat(path, F.array(half))).otherwise(path)

    path = F.array(F.col("first"))
    if depth:
        path = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), path, down)
    counted = values.withColumn("first", first).filter("first is not null").select("c", F.explode(path).alias("r")).groupBy("r.lo", "r.hi").agg(F.sum("c").alias("n"))
    # a half of a narrow range may be the range itself again only where it can't be split, so ends name a range
    full = counted.filter((F.col("n") >= cap) & _splits(F.col("lo"), F.col("hi"), least_width, open_width))
    mid = _middle(F.col("lo"), F.col("hi"), open_width)
    halves = full.select(F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))).alias("r")).select("r.lo", "r.hi")
    given = df.sparkSession.createDataFrame(list(ranges), "lo bigint, hi bigint")
    seen = counted.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "n")
    opened = given.union(halves)
    out = opened.join(seen, F.col("lo").eqNullSafe(F.col("_lo")) & F.col("hi").eqNullSafe(F.col("_hi")), "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))
    return out.filter((F.col("n") < cap) | ~_splits(F.col("lo"), F.col("hi"), least_width, open_width)).withColumn("complete", F.col("n") < cap)
