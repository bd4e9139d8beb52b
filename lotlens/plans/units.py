"""The unit universe: sources merged by key, gaps against expected counts, placeholders and coverage.

Stand-ins: a building is a customer that expects as many units as its nation key says; its units are its orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions import keys
from lotlens.operators import aggregates as agg
from lotlens.operators import joins, windows
from lotlens.plans.registry import Tables, query


def canonical_units(parts: list[DataFrame], key: str, unit: str, multi_source_confidence: float = 0.95) -> DataFrame:
    """One row per key and unit of parts with source, confidence and attributes; units of several sources gain confidence."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    attributes = [c for c in every.columns if c not in (key, unit, "source", "confidence")]
    merged = agg.merge_sources(every, [key, unit], "source", "confidence", attributes, ["source"])
    raised = F.when(F.size("sources") > 1, F.greatest(F.lit(multi_source_confidence), "confidence")).otherwise(F.col("confidence"))
    return merged.withColumn("confidence", raised)


def with_placeholders(units: DataFrame, expected: DataFrame, key: str, unit: str, target: str) -> DataFrame:
    """The units and, per building, placeholders for all that is missing, numbered on from the units found."""
    found = units.groupBy(key).agg(F.count("*").alias("found"))
    gaps = agg.gap_analysis(expected.select(key, target), found, key, target, "found")
    filled = joins.expand_gap(gaps, F.col("gap"), "_n")
    holes = filled.select(key, F.concat(F.lit("UNIT_"), keys.zero_filled((F.col("found") + F.col("_n")).cast("string"), 5)).alias(unit), F.lit(True).alias("is_placeholder"))
    return units.withColumn("is_placeholder", F.lit(False)).unionByName(holes, allowMissingColumns=True)


def numbered_units(buildings: DataFrame, key: str, n: str, cap: int) -> DataFrame:
    """Units 1..min(n, cap) of each building."""
    return joins.expand_gap(buildings, F.col(n), "unit", cap).select(key, F.col("unit").cast("string").alias("unit"))


def _units(t: Tables) -> DataFrame:
    """Orders as units of three sources, labelled in one pass."""
    status = F.col("o_orderstatus")
    source = F.when(status == "F", "deeds").when(status == "O", "permits").when(status == "P", "text")
    confidence = F.when(status == "F", 0.9).when(status == "O", 0.7).otherwise(0.5)
    o = t.orders.select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 6).cast("string").alias("unit"), source.alias("source"), confidence.alias("confidence"), "o_orderpriority").filter("source is not null")
    return canonical_units([o.groupBy("key", "unit", "source", "confidence").agg(F.min("o_orderpriority").alias("kind"))], "key", "unit")


_UNITS = """WITH s AS (SELECT o_custkey AS key, CAST(o_orderkey % 6 AS VARCHAR) AS unit, CASE o_orderstatus WHEN 'F' THEN 'deeds' WHEN 'O' THEN 'permits' ELSE 'text' END AS source,
   CASE o_orderstatus WHEN 'F' THEN 0.9::DOUBLE WHEN 'O' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, min(o_orderpriority) AS kind FROM orders GROUP BY 1, 2, 3, 4),
 u AS (SELECT key, unit, string_agg(source, ',' ORDER BY source) AS sources, CASE WHEN count(*) > 1 THEN greatest(0.95::DOUBLE, max(confidence)) ELSE max(confidence) END AS confidence, arg_min(kind, source) AS kind FROM s GROUP BY 1, 2),
 e AS (SELECT c_custkey AS key, c_nationkey AS expected, coalesce(n, 0) AS found FROM customer LEFT JOIN (SELECT key, count(*) AS n FROM u GROUP BY 1) n ON n.key = c_custkey) """


@query(_UNITS + "SELECT key, unit, sources, confidence, kind FROM u")
def canonical_unit_merge(t: Tables) -> DataFrame:
    return _units(t).withColumn("sources", F.array_join("sources", ",")).select("key", "unit", "sources", "confidence", "kind")


def _gaps(t: Tables) -> DataFrame:
    expected = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("expected"), "c_mktsegment")
    return agg.gap_analysis(expected, _units(t).groupBy("key").agg(F.count("*").alias("found")), "key", "expected", "found")


@query(_UNITS + "SELECT key, expected, found, greatest(0, expected - found) AS gap, CASE WHEN found >= expected THEN 'full' WHEN found > 0 THEN 'partial' ELSE 'zero' END AS status FROM e")
def gap_analysis(t: Tables) -> DataFrame:
    return _gaps(t).select("key", "expected", "found", "gap", "status")


@query(_UNITS + """SELECT key, unit, false AS is_placeholder FROM u UNION ALL SELECT key, 'UNIT_' || lpad(CAST(found + n AS VARCHAR), 5, '0'), true FROM (SELECT key, found, unnest(range(1, greatest(0, expected - found) + 1)) AS n FROM e)""")
def complete_coverage(t: Tables) -> DataFrame:
    expected = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("expected"))
    return with_placeholders(_units(t).select("key", "unit"), expected, "key", "unit", "expected")


@query(_UNITS + """, g AS (SELECT c_mktsegment, count(*) AS buildings, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(least(found, expected)) AS BIGINT) AS covered, count(*) FILTER (WHERE found = 0) AS empty FROM e JOIN customer ON c_custkey = key GROUP BY 1)
SELECT c_mktsegment AS segment, buildings, expected, covered, empty, round(100.0 * covered / expected, 4) AS pct FROM g""")
def coverage_report(t: Tables) -> DataFrame:
    covered = F.sum(F.least("found", "expected"))
    return _gaps(t).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("buildings"), F.sum("expected").alias("expected"), covered.alias("covered"), F.count_if(F.col("found") == 0).alias("empty"), agg.share(covered, F.sum("expected")).alias("pct"))


@query(_UNITS + "SELECT CASE WHEN expected <= 5 THEN '1-5' WHEN expected <= 15 THEN '6-15' ELSE 'over 15' END AS bucket, count(*) AS n, CAST(sum(expected) AS BIGINT) AS sum_expected, CAST(sum(found) AS BIGINT) AS sum_found FROM e GROUP BY 1")
def coverage_by_size(t: Tables) -> DataFrame:
    return agg.histogram(_gaps(t), agg.bucket(F.col("expected"), [(5, "1-5"), (15, "6-15")], "over 15"), "expected", "found")


@query("""SELECT p_partkey AS key, CAST(n AS VARCHAR) AS unit FROM (SELECT p_partkey, unnest(range(1, least(p_size, 20) + 1)) AS n FROM part)""")
def numbered_generation(t: Tables) -> DataFrame:
    return numbered_units(t.part.select(F.col("p_partkey").alias("key"), "p_size"), "key", "p_size", 20)


def add_missing(holes: DataFrame, key: str, order: str, added: DataFrame) -> DataFrame:
    """Placeholders that remain after units were added: each building loses its last ones, one for each unit."""
    n = added.groupBy(key).agg(F.count("*").alias("_added"))
    return windows.drop_last_n(holes, [key], [F.desc(order)], n, "_added")


@query(_UNITS + """, h AS (SELECT key, unnest(range(1, greatest(0, expected - found) + 1)) AS n FROM e), a AS (SELECT l_suppkey AS key, count(*) AS added FROM lineitem WHERE l_quantity = 50 GROUP BY 1)
SELECT key, CAST(n AS INTEGER) AS n FROM (SELECT h.key, n, row_number() OVER (PARTITION BY h.key ORDER BY n DESC) AS back, coalesce(added, 0) AS added FROM h LEFT JOIN a ON a.key = h.key) WHERE back > added""")
def replaced_placeholders(t: Tables) -> DataFrame:
    holes = joins.expand_gap(_gaps(t), F.col("gap"), "n").select("key", "n")
    return add_missing(holes, "key", "n", t.lineitem.filter("l_quantity = 50").select(F.col("l_suppkey").alias("key"))).select("key", "n")


@query("""WITH b AS (SELECT CAST((1 + c_nationkey % 5)::BIGINT * 1000000000 + (c_custkey % 200) * 10000 + CASE WHEN c_custkey % 3 = 0 THEN 7500 ELSE c_custkey % 90 END AS BIGINT) AS key, c_nationkey AS units FROM customer),
 k AS (SELECT o_orderkey, CAST((1 + o_custkey % 5)::BIGINT * 1000000000 + (o_orderkey % 250) * 10000 + CASE WHEN o_orderkey % 2 = 0 THEN 1000 + o_orderkey % 400 ELSE o_orderkey % 90 END AS BIGINT) AS key FROM orders),
 m AS (SELECT key // 10000 AS block, arg_min(key, -units::HUGEINT * 1000000000000 + key) AS main FROM b GROUP BY 1)
SELECT o_orderkey, coalesce(d.key, CASE WHEN k.key % 10000 >= 1000 THEN main END) AS resolved, CASE WHEN d.key IS NOT NULL THEN 'direct' WHEN k.key % 10000 >= 1000 AND main IS NOT NULL THEN 'condo' ELSE 'none' END AS method
FROM k LEFT JOIN (SELECT DISTINCT key FROM b) d ON d.key = k.key LEFT JOIN m ON m.block = k.key // 10000""")
def resolve_condo(t: Tables) -> DataFrame:
    lot = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    b = t.customer.select(((1 + F.col("c_nationkey") % 5) * F.lit(1_000_000_000).cast("long") + (F.col("c_custkey") % 200) * 10_000 + lot(F.col("c_custkey") % 3 == 0, F.lit(7500), F.col("c_custkey") % 90)).alias("key"), F.col("c_nationkey").alias("units"))
    k = t.orders.select("o_orderkey", ((1 + F.col("o_custkey") % 5) * F.lit(1_000_000_000).cast("long") + (F.col("o_orderkey") % 250) * 10_000 + lot(F.col("o_orderkey") % 2 == 0, 1000 + F.col("o_orderkey") % 400, F.col("o_orderkey") % 90)).alias("key"))
    return joins.resolve_condo(k, b, "key", "units").select("o_orderkey", "resolved", "method")
