"""Small helpers on sessions and frames that the operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with an eager checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a temporary folder takes its place if the
    driver is also the only executor (tests, laptops); on a cluster that is an error, since executors would not see
    each other's files. The files survive the loss of any executor; Spark deletes those that nothing refers to if the
    cluster sets ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Exactly the named columns, so that no other column of the input can clash with an operator's own."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def unsigned_crc32(col: Column) -> Column:
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary")).cast("long")


#: Cells whose counts one task sums.
CELL_BLOCK = 1000


def exact_rank(rows: DataFrame, group: list[str], cell: str, inner: list[str]) -> DataFrame:
    """An exact 0-based `rank` in each group, by numbered cells that are ordered within the group and sorted inside.

    Running sums over the cell counts, first of blocks of cells and then within each block, give each cell's offset;
    so a group may hold any share of the rows as long as its cells are small. Null groups are groups of their own.
    """
    keyed = rows.withColumn("_cell", _whole(*group, cell))
    counts = keyed.groupBy("_cell").agg(F.count("*").alias("_c"), F.first(_whole(*group)).alias("_group"), F.first(cell).alias("_n"))
    counts = counts.withColumn("_block", F.floor(F.col("_n") / CELL_BLOCK))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("_group", "_block").agg(F.sum("_c").alias("_c"))
    blocks = blocks.select("_group", "_block", F.coalesce(F.sum("_c").over(before("_group").orderBy("_block")), F.lit(0)).alias("_of_block"))
    inside = F.coalesce(F.sum("_c").over(before("_group", "_block").orderBy("_n")), F.lit(0))
    offsets = counts.withColumn("_inside", inside).join(blocks, ["_group", "_block"]).select("_cell", (F.col("_of_block") + F.col("_inside")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy(*inner)) - 1
    return keyed.withColumn("_in", within).join(offsets, "_cell").withColumn("rank", F.col("_in") + F.col("_before")).drop("_in", "_before", "_cell")


def _whole(*columns: str) -> Column:
    """A key that is equal where all columns are equal or null; no value stands for a null."""
    return F.struct(*[x for k, c in enumerate(columns) for x in (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k{k}"), F.col(c).isNull().alias(f"z{k}"))], F.lit(0).alias("one"))


def skew_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join on a column of which one value may hold a third of the rows.

    A side that is already dealt by the key would not be exchanged again, and Spark splits a hot key at run time only
    between two exchanges. A second key, a hash of the first, asks for both.
    """
    keyed = lambda df: df.withColumn("_hash", F.xxhash64(on))
    return keyed(left).join(keyed(right), [on, "_hash"]).drop("_hash")
