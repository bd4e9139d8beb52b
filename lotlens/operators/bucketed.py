"""Tables stored in buckets of one key, sorted within: joins on it without an exchange, look-ups that read one bucket."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.operators.windows import ranked

BUCKETS = 16


def write_bucketed(df: DataFrame, path: str, key: str, sort: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Writes the rows in `buckets` files by a hash of the key, sorted by it and then by `sort`, and reads them back.

    The table is known to the session's catalog under a name of its own; its files lie under `path`.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    # one task for each bucket, so one file
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key, *sort).saveAsTable(name)
    return df.sparkSession.table(name)


@dataclass(frozen=True)
class Kind:
    """One kind of records of a key: the day they are ordered by, what ties, the columns shown, how many, a category."""

    day: Column
    order: Sequence[Column]
    shown: Mapping[str, Column]
    limit: int | None = None
    category: Column | None = None


class BucketedStar:
    """Tables of records in buckets of one key; a kind may be a part of a table (`where`)."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.tables: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame, sort: Sequence[str] = ()) -> BucketedStar:
        self.tables[name] = write_bucketed(df, f"{self.path}/{name}", self.key, sort, self.buckets)
        return self

    def star(self, base: str, parts: Mapping[str, Mapping[str, Column]]) -> DataFrame:
        """The base table with aggregates of the others: each is grouped and joined in the buckets it lies in."""
        out = self.tables[base]
        for name, columns in parts.items():
            out = out.join(self.tables[name].groupBy(self.key).agg(*[c.alias(k) for k, c in columns.items()]), self.key, "left")
        return out

    def records(self, kinds: Mapping[str, tuple[str, Column, Kind]], keys: DataFrame | None = None, key: int | str | None = None) -> DataFrame:
        """key, kind, pos, day, record (JSON) of each kind, newest first and up to its limit.

        kinds: name -> (table, filter, what is shown). `key` asks for one key, and reads its bucket alone; `keys` for a
        table of them; neither for all.
        """
        out = None
        for name, (table, where, kind) in kinds.items():
            rows = self._asked(table, where, keys, key).select(self.key, kind.day.cast("date").alias("day"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(kind.order)]).alias("_tie"), F.to_json(F.struct(*[c.alias(n) for n, c in kind.shown.items()])).alias("record"))
            order = [F.col("day").desc_nulls_last(), F.col("_tie")]
            rows = ranked(rows, [self.key], order, "pos")
            if kind.limit is not None:
                rows = rows.filter(F.col("pos") <= kind.limit)
            rows = rows.select(F.col(self.key).alias("key"), F.lit(name).alias("kind"), "pos", "day", "record")
            out = rows if out is None else out.union(rows)
        return out

    def statistics(self, kinds: Mapping[str, tuple[str, Column, Kind]], keys: DataFrame | None = None, key: int | str | None = None, top: int = 10) -> DataFrame:
        """key, kind, measure (total, year, category), value, n: yearly counts of dated rows and the `top` categories."""
        out = None
        for name, (table, where, kind) in kinds.items():
            rows = self._asked(table, where, keys, key).select(self.key, kind.day.cast("date").alias("day"), (F.lit(None) if kind.category is None else kind.category).cast("string").alias("category"))
            told = F.array_compact(F.array(F.struct(F.lit("total").alias("measure"), F.lit(None).cast("string").alias("value")), F.when(F.col("day").isNotNull(), F.struct(F.lit("year").alias("measure"), F.year("day").cast("string").alias("value"))), *([] if kind.category is None else [F.struct(F.lit("category").alias("measure"), F.col("category").alias("value"))])))
            n = rows.select(self.key, F.explode(told).alias("m")).groupBy(self.key, F.col("m.measure").alias("measure"), F.col("m.value").alias("value")).agg(F.count("*").alias("n"))
            first = ranked(n, [self.key, "measure"], [F.desc("n"), F.col("value").asc_nulls_first()], "_pos").filter((F.col("measure") != "category") | (F.col("_pos") <= top))
            first = first.select(F.col(self.key).alias("key"), F.lit(name).alias("kind"), "measure", "value", "n")
            out = first if out is None else out.union(first)
        return out

    def _asked(self, table: str, where: Column, keys: DataFrame | None, key: int | str | None) -> DataFrame:
        rows = self.tables[table].filter(where)
        if key is not None:
            return rows.filter(F.col(self.key) == F.lit(key))
        return rows if keys is None else rows.join(keys.select(self.key).distinct(), self.key, "left_semi")
