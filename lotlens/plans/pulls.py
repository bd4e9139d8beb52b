"""Paged pulls of a feed, as a table and as a stream that is resumed; the pages are written from the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.plans.files import scratch
from lotlens.plans.registry import Tables, query
from lotlens.plans.streams import _finished
from lotlens.sources import paged

ADAPTER = "lotlens.sources.paged:JsonFolder"


def _write_pages(t: Tables, path: str, where: str) -> None:
    record = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))
    t.orders.filter(where).repartition(4, "o_orderkey").select(record.alias("value")).write.text(path)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000")
def paged_table(t: Tables) -> DataFrame:
    """Two columns of one status: the filter and the columns reach the pages."""
    path = scratch(t.spark)
    _write_pages(t, f"{path}/pull_0", "o_orderkey % 2 = 0")
    _write_pages(t, f"{path}/pull_1", "o_orderkey % 2 = 1")
    paged.register(t.spark)
    rows = t.spark.read.format("pages").option("adapter", ADAPTER).option("path", path.removeprefix("file:")).schema("o_orderkey bigint, o_orderstatus string, o_totalprice double").load()
    return rows.filter("o_orderstatus = 'P' and o_totalprice > 1000").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 2 ELSE 3 END AS pull FROM orders")
def resumed_pull(t: Tables) -> DataFrame:
    """Three pulls, each resumed from the checkpoint: a page is read once."""
    path = scratch(t.spark)
    paged.register(t.spark)
    for pull in (1, 2, 3):
        _write_pages(t, f"{path}/in/pull_{pull}", f"o_orderkey % 3 = {pull - 1}")
        stream = t.spark.readStream.format("pages").option("adapter", ADAPTER).option("path", f"{path}/in".removeprefix("file:")).schema("o_orderkey bigint").load()
        _finished(stream.withColumn("pull", F.lit(pull)).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start())
    return t.spark.read.schema("o_orderkey bigint, pull int").parquet(f"{path}/out")
