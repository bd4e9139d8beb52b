"""Readers and writers on the provided data: what is written to a shared folder is read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.functions import clean
from lotlens.sources import io
from lotlens.plans.registry import Tables, query

#: Records of a JSON array, and captures of an index file.
BATCH = 500


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: in spark.checkpoint.dir, or a temporary one where there is no cluster."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/lotlens-{uuid.uuid4().hex}"


def write_batches(df: DataFrame, number: Column, path: str) -> None:
    """Files batch_<n>.json of the folder, each one array of the records with that number."""
    arrays = df.groupBy(number.alias("n")).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    arrays.repartition("n").write.partitionBy("n").text(path)
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in fs.listStatus(folder):
        if part.isDirectory():
            for k, file in enumerate(f for f in fs.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")):
                fs.rename(file.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part.getPath(), f"batch_{k:05d}.json"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_json_batches(t: Tables) -> DataFrame:
    """Suppliers as nested folders of JSON arrays."""
    path = scratch(t.spark)
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    write_batches(rows, F.floor(F.col("s_suppkey") / BATCH), path)
    return io.scan_json_batches(t.spark, path, rows.select("s_suppkey", "s_name", "s_acctbal").schema.simpleString()[7:-1].replace(":", " "))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def scan_table(t: Tables) -> DataFrame:
    return io.scan_table(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_totalprice > 100000 and o_orderstatus = 'F'")


@query("""SELECT c_custkey, '"' || c_name || '", of ' || c_mktsegment AS label, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer""")
def csv_round_trip(t: Tables) -> DataFrame:
    """Quotes, commas and nulls survive the writer and the reader."""
    path = scratch(t.spark)
    rows = t.customer.select("c_custkey", F.concat(F.lit('"'), "c_name", F.lit('", of '), "c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("segment"))
    io.write_csv(rows, path)
    return io.scan_csv(t.spark, path, "c_custkey bigint, label string, segment string")


@query("SELECT trim(url) AS url FROM pages")
def scan_lines(t: Tables) -> DataFrame:
    """Lines with blanks around them, and blank lines between."""
    path = scratch(t.spark)
    t.pages.select(F.explode(F.array(F.concat(F.lit("  "), "url", F.lit(" ")), F.lit("   "), F.lit(""))).alias("value")).write.text(path)
    return io.scan_lines(t.spark, path, "url")


@query("SELECT CAST(20240101000000 + page_id AS VARCHAR) AS timestamp, url AS original, unnest(['arrays', 'objects', 'fields']) AS layout FROM pages")
def scan_archive_index(t: Tables) -> DataFrame:
    """The captures of all pages, written in each of the three layouts; an array file holds the captures of `BATCH` pages."""
    rows = t.pages.select("page_id", (20240101000000 + F.col("page_id")).cast("string").alias("timestamp"), F.col("url").alias("original"))
    paths = {layout: scratch(t.spark) for layout in ("arrays", "objects", "fields")}
    capture = F.sort_array(F.collect_list(F.array("original", "timestamp")))
    rows.groupBy(F.floor(F.col("page_id") / BATCH)).agg(F.to_json(F.concat(F.array(F.array(F.lit("original"), F.lit("timestamp"))), capture)).alias("value")).select("value").repartition(8).write.option("maxRecordsPerFile", 1).text(paths["arrays"])
    rows.select(F.to_json(F.struct("timestamp", "original")).alias("value")).write.text(paths["objects"])
    rows.select(F.concat_ws(" ", F.lit("key"), "timestamp", "original", F.lit("text/html")).alias("value")).write.text(paths["fields"])
    read = [io.scan_archive_index(t.spark, path, layout).select("timestamp", "original", F.lit(layout).alias("layout")) for layout, path in paths.items()]
    return read[0].union(read[1]).union(read[2])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_mktsegment, '') AS c_mktsegment, '' AS remark, c_name || ' ' || c_mktsegment AS raw_text FROM customer")
def scan_dynamic(t: Tables) -> DataFrame:
    """A field that the source lacks is empty, and the filled text fields are joined."""
    return io.scan_dynamic(t.customer, ["c_custkey", "c_name", "c_mktsegment", "remark"], ["c_name", "remark", "c_mktsegment"]).drop("c_name")


@query("SELECT o_orderkey, o_orderpriority AS kind, o_totalprice AS price, 'A' || o_custkey AS agent, CASE WHEN o_orderkey % 2 = 0 THEN 'B' || o_orderkey END AS second_agent FROM orders")
def flatten_listing(t: Tables) -> DataFrame:
    """Orders as nested records of text, flattened by paths."""
    agent = lambda c: F.struct(c.alias("name"))
    second = F.when(F.col("o_orderkey") % 2 == 0, agent(F.concat(F.lit("B"), F.col("o_orderkey").cast("string"))))
    record = F.struct(F.col("o_orderpriority").alias("kind"), F.struct(F.col("o_totalprice").alias("list")).alias("price"), F.array_compact(F.array(agent(F.concat(F.lit("A"), F.col("o_custkey").cast("string"))), second)).alias("agents"))
    schema = "kind string, price struct<list:double>, agents array<struct<name:string>>"
    return io.flatten_listing(t.orders.select("o_orderkey", F.to_json(record).alias("j")), "j", schema, {"kind": "kind", "price": "price.list", "agent": "agents[0].name", "second_agent": "agents[1].name"}, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def table_round_trip(t: Tables) -> DataFrame:
    """Written by status; the filter prunes folders."""
    path = scratch(t.spark)
    io.write_table(t.orders.select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    return io.scan_table(t.spark, path, ["o_orderkey", "o_orderstatus"], "o_orderstatus in ('F', 'P')")


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_retailprice END AS price FROM part")
def json_lines_round_trip(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    io.write_json(t.part.select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("price")), path)
    return t.spark.read.schema("p_partkey bigint, p_name string, price double").json(path)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day FROM orders WHERE o_orderkey % 3 > 0")
def dated_lines(t: Tables) -> DataFrame:
    """Blank values of a text file are no dates: `not_blank` and `normalize_date` on what was read."""
    path = scratch(t.spark)
    day = F.when(F.col("o_orderkey") % 3 > 0, F.date_format(F.col("o_orderdate").cast("date"), "MM/dd/yyyy")).otherwise("")
    io.write_csv(t.orders.select("o_orderkey", day.alias("day")), path)
    read = t.spark.read.schema("o_orderkey bigint, day string").option("header", True).option("emptyValue", "").csv(path)
    return read.filter(clean.not_blank(F.col("day"))).select("o_orderkey", clean.normalize_date(F.col("day")).alias("first_day"))
