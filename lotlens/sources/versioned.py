"""Keyed tables in a shared folder as a row of whole versions, of which each rewrites only the parts that it touches.

A part is a value of `part` (such as a source) and a bucket of the keys. A change reads the parts that it touches, and
writes their new rows under a folder of its own, ``data/at=<tag>/part=<p>/bucket=<b>``. It is committed by one small
table, ``versions/<n>``: a row for each part that has rows, with the tag of the folder that holds them. Untouched
parts keep the tag, hence the files, of the version before. A reader takes the newest version with a success marker, so
it sees all of a change or nothing; what a failed write left behind no version names, and no later one reuses.

One writer at a time: a version is written only if its folder does not exist, so of two writers that start from one
version the later fails, and its rows are not committed.

Counts of rows, new and updated ones come from the plan that writes, as observed metrics.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.operators import upsert as up
from lotlens.operators.observed import write_observed

BUCKETS = 16
_PARTS = "at string, part bigint, bucket int"


class VersionedTable:
    """A table with columns `schema` (a DDL string) whose `keys` are unique."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], part: Column | None = None, bucket: Column | None = None):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.part = (F.lit(0) if part is None else part).cast("bigint")
        self.bucket = (F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) if bucket is None else bucket).cast("int")
        self.columns = spark.createDataFrame([], schema).columns

    def versions(self) -> list[int]:
        """Committed versions in order; one without a success marker doesn't count."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS")))

    def parts(self, version: int | None = None) -> DataFrame:
        """at, part, bucket, rows, since of a version's parts; `since` is the version that wrote them."""
        version = self._newest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], f"{_PARTS}, rows bigint, since int")
        return self.spark.read.schema(f"{_PARTS}, rows bigint, since int").parquet(f"{self.path}/versions/{version}")

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.parts(version).select("at", "part", "bucket").collect())  # a row for each part

    def _rows(self, parts: list) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/data/at={r.at}/part={r.part}/bucket={r.bucket}" for r in parts]
        return self.spark.read.schema(f"{self.schema}, {_PARTS}").option("basePath", f"{self.path}/data").parquet(*folders).select(*self.columns)

    def _newest(self) -> int:
        return max(self.versions(), default=0)

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("part", self.part).withColumn("bucket", self.bucket)

    def _commit(self, old: list, touched: set, rows: DataFrame, base: int) -> dict[str, int]:
        """Writes the touched parts' rows (with a column `_change`), then the version that names them."""
        tag = uuid.uuid4().hex

        def write(counted: DataFrame) -> None:  # a task holds whole parts: one file for each
            dealt = self._keyed(counted.drop("_change")).repartition("part", "bucket")
            dealt.write.partitionBy("part", "bucket").parquet(f"{self.path}/data/at={tag}")

        changes = {name: F.count_if(F.col("_change") == name) for name in ("new", "updated")}
        counts = write_observed(rows, write, rows=F.count("*"), **changes)
        filled = self.spark.read.schema(f"{self.schema}, part bigint, bucket int").parquet(f"{self.path}/data/at={tag}").groupBy("part", "bucket").agg(F.count("*").alias("rows")) if counts["rows"] else None
        kept = [(r.at, r.part, r.bucket, r.rows, r.since) for r in old if (r.part, r.bucket) not in touched]
        manifest = self.spark.createDataFrame(kept, f"{_PARTS}, rows bigint, since int")
        if filled is not None:
            manifest = manifest.unionByName(filled.select(F.lit(tag).alias("at"), "part", "bucket", "rows", F.lit(base + 1).alias("since")))
        manifest.coalesce(1).write.mode("error").parquet(f"{self.path}/versions/{base + 1}")
        return {"version": base + 1, **counts}

    def change(self, touched_by: DataFrame | None, parts: Sequence[int], new_rows) -> dict[str, int]:
        """Replaces the parts that rows of `touched_by` fall in, and all of `parts`, by `new_rows(their rows now)`.

        The function gives the rows of these parts only, with `_change` as "new", "updated" or "kept".
        """
        base = self._newest()
        old = self.parts(base).collect()  # a row for each part
        touched = {(r.part, r.bucket) for r in old if r.part in set(parts)}
        if touched_by is not None:
            touched |= {(r.part, r.bucket) for r in self._keyed(touched_by).select("part", "bucket").distinct().collect()}
        if not touched:
            return {"version": base, "rows": 0, "new": 0, "updated": 0}
        return self._commit(old, touched, new_rows(self._rows([r for r in old if (r.part, r.bucket) in touched])), base)

    def upsert(self, updates: DataFrame, order: Sequence[Column], keep: Sequence[str] = ()) -> dict[str, int]:
        return self.change(updates, (), lambda now: up.upsert_marked(now, updates, self.keys, order, keep))

    def insert_first_wins(self, rows: DataFrame, order: Sequence[Column]) -> dict[str, int]:
        def merged(now: DataFrame) -> DataFrame:
            fresh = up.insert_first_wins(now.withColumn("_change", F.lit("kept")), rows, self.keys, order)
            return fresh.fillna("new", ["_change"]).select(*self.columns, "_change")

        return self.change(rows, (), merged)

    def insert_last_wins(self, rows: DataFrame, order: Sequence[Column]) -> dict[str, int]:
        return self.upsert(rows, order)

    def backfill_if_empty(self, lookup: DataFrame, keys: Sequence[str], column: str) -> dict[str, int]:
        """Fills the column where it is empty; every part may hold such a row."""

        def filled(now: DataFrame) -> DataFrame:
            before = now.withColumn("_before", F.col(column))
            out = up.backfill_if_empty(before, lookup, keys, column)
            return out.withColumn("_change", F.when(F.col(column).eqNullSafe(F.col("_before")), "kept").otherwise("updated")).drop("_before")

        return self.change(None, [r.part for r in self.parts().select("part").distinct().collect()], filled)

    def reset_source(self, part: int, source: str, column: str = "source") -> dict[str, int]:
        """Rows of one source go; other values that share its part stay."""
        return self.change(None, [part], lambda now: up.reset_source(now, source, column).withColumn("_change", F.lit("kept")))

    def track(self, pull: DataFrame, part: int, source: str, now: str) -> dict[str, int]:
        """A pull of one source into a table of (source, source_id, price, status, first_seen, last_seen)."""
        seen = pull.select("source_id").withColumn("source", F.lit(source))

        def tracked(state: DataFrame) -> DataFrame:
            known = state.select("source", "source_id", F.lit(True).alias("_known"))
            out = up.track_snapshot(state, pull, source, now).join(known, ["source", "source_id"], "left")
            pulled = (F.col("source") == source) & (F.col("status") == "active")
            return out.withColumn("_change", F.when(F.col("_known").isNull(), "new").when(pulled, "updated").otherwise("kept")).drop("_known")

        return self.change(seen, [part], tracked)
