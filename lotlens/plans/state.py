"""Versions of keyed tables on the provided data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.operators import upsert as up
from lotlens.plans.registry import Tables, query

NOW = "2024-02-01 00:00:00"


def _target(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def _updates(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 2).alias("price"), F.lit("new").alias("status"))


_SIDES = """WITH t AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0), u AS (SELECT o_orderkey AS id, o_totalprice * 2 AS price, 'new' AS status FROM orders WHERE o_orderkey % 2 = 0) """


@query(_SIDES + "SELECT coalesce(t.id, u.id) AS id, coalesce(u.price, t.price) AS price, coalesce(t.status, u.status) AS status FROM t FULL JOIN u ON t.id = u.id")
def upsert(t: Tables) -> DataFrame:
    return up.upsert(_target(t), _updates(t), ["id"], [F.desc("price"), F.col("status")], keep=["status"])


@query(_SIDES + "SELECT * FROM t UNION ALL SELECT * FROM u WHERE id NOT IN (SELECT id FROM t)")
def insert_first_wins(t: Tables) -> DataFrame:
    return up.insert_first_wins(_target(t), _updates(t), ["id"], [F.col("price")])


@query(_SIDES + "SELECT * FROM u UNION ALL SELECT * FROM t WHERE id NOT IN (SELECT id FROM u)")
def insert_last_wins(t: Tables) -> DataFrame:
    return up.insert_last_wins(_target(t), _updates(t), ["id"], [F.col("price")])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'patched' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def patch_non_null(t: Tables) -> DataFrame:
    detail = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "patched").when(F.col("c_custkey") % 4 == 1, "").alias("c_mktsegment"))
    return up.patch_non_null(t.customer.select("c_custkey", "c_mktsegment"), detail, ["c_custkey"], ["c_mktsegment"])


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN n_name ELSE 'kept' END AS area FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def backfill_if_empty(t: Tables) -> DataFrame:
    area = F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 2, "kept")
    return up.backfill_if_empty(t.supplier.select("s_suppkey", "s_nationkey", area.alias("area")), t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("area")), ["s_nationkey"], "area").select("s_suppkey", "area")


@query("SELECT source, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY 1")
def reset_source(t: Tables) -> DataFrame:
    return up.reset_source(t.documents, "src3").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def new_only(t: Tables) -> DataFrame:
    return up.new_only(t.orders, t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey")


@query("SELECT n_nationkey, n_name, 0 AS n_seen FROM nation")
def evolve_schema(t: Tables) -> DataFrame:
    return up.evolve(t.nation, n_name="unknown", n_seen=0).select("n_nationkey", "n_name", "n_seen")


@query("SELECT s_suppkey, s_name, NULL::VARCHAR AS s_phone FROM supplier")
def prefer_primary(t: Tables) -> DataFrame:
    return up.prefer_primary(None, t.supplier, ["s_suppkey", "s_name", "s_phone"])


def _state(t: Tables) -> DataFrame:
    stamp = lambda c: F.col(c).cast("timestamp")
    return t.orders.filter("o_orderkey % 5 < 4").select(F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("source"), F.col("o_orderkey").cast("string").alias("source_id"), F.col("o_totalprice").alias("price"), F.lit("active").alias("status"), stamp("o_orderdate").alias("first_seen"), stamp("o_orderdate").alias("last_seen"))


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS source, o_orderkey AS id, o_totalprice AS price, CAST(o_orderdate AS DATE) AS seen FROM orders WHERE o_orderkey % 5 < 4),
 p AS (SELECT o_orderkey AS id, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 < 5)
SELECT coalesce(s.source, 'a') AS source, CAST(coalesce(s.id, p.id) AS VARCHAR) AS source_id, coalesce(p.price, s.price) AS price, CASE WHEN p.id IS NOT NULL THEN 'active' WHEN s.source = 'a' THEN 'inactive' ELSE 'active' END AS status,
 coalesce(seen, DATE '2024-02-01') AS first_day, CASE WHEN p.id IS NOT NULL THEN DATE '2024-02-01' ELSE seen END AS last_day FROM s FULL JOIN p ON s.source = 'a' AND s.id = p.id""")
def track_snapshot(t: Tables) -> DataFrame:
    pull = t.orders.filter("o_orderkey % 2 = 0 and o_orderkey % 7 < 5").select(F.col("o_orderkey").cast("string").alias("source_id"), (F.col("o_totalprice") + 1).alias("price"))
    out = up.track_snapshot(_state(t), pull, "a", NOW)
    return out.select("source", "source_id", "price", "status", F.col("first_seen").cast("date").alias("first_day"), F.col("last_seen").cast("date").alias("last_day"))


@query("""WITH h AS (SELECT 'a' AS source, CAST(o_orderkey AS VARCHAR) AS source_id, DATE '2024-02-01' - CAST(o_orderkey % 2 AS INTEGER) AS snapshot_date, o_totalprice AS price FROM orders WHERE o_orderkey % 3 = 0),
 p AS (SELECT 'a' AS source, CAST(o_orderkey AS VARCHAR) AS source_id, DATE '2024-02-01' AS snapshot_date, 1.0::DOUBLE AS price FROM orders WHERE o_orderkey % 4 = 0)
SELECT * FROM p UNION ALL SELECT * FROM h WHERE (source_id, snapshot_date) NOT IN (SELECT source_id, snapshot_date FROM p)""")
def daily_prices(t: Tables) -> DataFrame:
    h = t.orders.filter("o_orderkey % 3 = 0").select(F.lit("a").alias("source"), F.col("o_orderkey").cast("string").alias("source_id"), F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("o_orderkey") % 2).cast("int")).alias("snapshot_date"), F.col("o_totalprice").alias("price"))
    pull = t.orders.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").cast("string").alias("source_id"), F.lit(1.0).alias("price"))
    return up.append_daily_price(h, pull, "a", "2024-02-01")


@query("SELECT 'orders' AS phase, (SELECT count(*) FROM orders) AS processed, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS inserted, 'ok' AS notes")
def run_log(t: Tables) -> DataFrame:
    return up.run_log("orders", t.orders, t.orders.filter("o_orderstatus = 'P'"), NOW, "ok").drop("run_at")
