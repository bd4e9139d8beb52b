"""Curated tables on the provided data.

Stand-ins: a building is a part, its key made of the part's number and size; raw records are orders, order lines and
customers, written as the text fields that the sources give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.plans import warehouse as wh
from lotlens.plans.registry import Tables, query

c = F.col


def text(x: Column) -> Column:
    return x.cast("string")


def _key() -> Column:
    return (1 + c("p_partkey") % 5) * F.lit(1_000_000_000).cast("long") + (c("p_partkey") % 90_000 + 1) * 10_000 + c("p_size")


_KEY = "((1 + p_partkey % 5) * 1000000000 + (p_partkey % 90000 + 1) * 10000 + p_size)"


def _pluto(t: Tables) -> DataFrame:
    return t.part.select(
        F.concat(text(_key()), F.lit(".00000000")).alias("bbl"), F.lit("MN").alias("borough"), F.concat(F.lit(" "), text(c("p_partkey") % 50), F.lit(" Main Street ")).alias("address"), text(10_001 + c("p_size") % 3).alias("zipcode"), c("p_brand").alias("bldgclass"),
        text(1900 + c("p_size")).alias("yearbuilt"), F.concat(text(c("p_size") % 12), F.lit(".50")).alias("numfloors"), text(c("p_size") - 5).alias("unitsres"), text(c("p_size")).alias("unitstotal"), c("p_name").alias("ownername"),
        text(c("p_retailprice") * 100).alias("assesstot"), text(c("p_size") * 801).alias("resarea"), F.when(c("p_size") % 2 == 0, text(40 + c("p_size") / 64)).otherwise("x").alias("latitude"), F.lit("").alias("longitude"),
    )


_BUILDINGS = f"""WITH b AS (SELECT CAST({_KEY} AS BIGINT) AS bbl, 'MN' AS borough, CAST(p_partkey % 50 AS VARCHAR) || ' MAIN STREET' AS address, CAST(10001 + p_size % 3 AS VARCHAR) AS zipcode, p_brand AS building_class, 1900 + p_size AS year_built,
  p_size % 12 + 0.5 AS num_floors, p_size - 5 AS units_residential, p_size AS units_total, p_name AS owner_name, p_retailprice * 100 AS assessed_total, p_size * 801 AS residential_area,
  CAST(round_even(p_size * 801 / (p_size - 5), 0) AS INTEGER) AS avg_unit_sqft, CAST(round_even(p_retailprice * 100 / (p_size - 5), 0) AS INTEGER) AS assessed_per_unit, CASE WHEN p_size % 2 = 0 THEN 40 + p_size / 64 END AS latitude
  FROM part WHERE p_size > 5 QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY p_size DESC, p_partkey % 50) = 1) """


@query(_BUILDINGS + "SELECT * FROM b")
def curated_buildings(t: Tables) -> DataFrame:
    return wh.buildings(_pluto(t)).drop("longitude")


@query("""SELECT CAST((1 + o_custkey % 5) * 1000000000 + (o_orderkey % 90000) * 10000 + o_custkey % 7000 AS BIGINT) AS bbl, o_orderpriority AS job_type, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS action_date, round(o_totalprice, 2) AS estimated_cost, CAST(o_custkey % 9 AS INTEGER) AS existing_units, 0 AS proposed_units FROM orders""")
def curated_permits(t: Tables) -> DataFrame:
    """Borough names, unpadded blocks and lots, dates of the form M/D/YYYY and amounts with signs."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("MANHATTAN", "Bronx", "BROOKLYN", "Queens", "STATEN ISLAND")]), (1 + c("o_custkey") % 5).cast("int"))
    raw = t.orders.select(
        name.alias("borough"), text(c("o_orderkey") % 90_000).alias("block"), F.concat(F.lit(" "), text(c("o_custkey") % 7000)).alias("lot"), c("o_orderpriority").alias("job_type"), F.lit("d").alias("job_description"), c("o_orderstatus").alias("job_status_description"),
        F.date_format(c("o_orderdate").cast("date"), "M/d/yyyy").alias("latest_action_date"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("initial_cost"), F.concat(text(c("o_custkey") % 9), F.lit(".9")).alias("existing_dwelling_units"), F.lit("none").alias("proposed_dwelling_units"),
    )
    return wh.permits(raw).drop("description")


def _bridge(t: Tables) -> DataFrame:
    """Building numbers of the parts, of which every fourth has no usable key."""
    return t.part.select(text(c("p_partkey")).alias("bin"), F.when(c("p_partkey") % 4 > 0, text(_key())).otherwise("0").alias("bbl"))


@query(f"""SELECT CAST({_KEY} AS BIGINT) AS bbl, l_returnflag AS severity, l_linestatus AS violation_type, CAST(l_shipdate AS DATE) AS issue_date, CAST(l_linenumber AS VARCHAR) AS status, round(l_extendedprice, 2) AS penalty, CASE WHEN l_linenumber > 1 THEN l_quantity END AS balance_due
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 4 > 0""")
def curated_violations(t: Tables) -> DataFrame:
    """Lines of buildings known by their number alone."""
    raw = t.lineitem.select(text(c("l_partkey")).alias("bin"), c("l_returnflag").alias("severity"), c("l_linestatus").alias("violation_type"), F.date_format(c("l_shipdate").cast("date"), "yyyyMMdd").alias("issue_date"), text(c("l_linenumber")).alias("ecb_violation_status"), F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("penality_imposed"), F.when(c("l_linenumber") > 1, text(c("l_quantity"))).otherwise("").alias("balance_due"))
    return wh.violations(raw, wh.bin_map(_bridge(t)))


@query(_BUILDINGS + """, r AS (SELECT c_custkey, CAST(c_custkey % 60 AS VARCHAR) || ' MAIN STREET' AS a, CASE WHEN c_custkey % 2 = 0 THEN CAST(10001 + c_nationkey % 4 AS VARCHAR) END AS z, c_name FROM customer),
 az AS (SELECT address AS a, zipcode AS z, min(bbl) AS bbl FROM b GROUP BY 1, 2), ao AS (SELECT address AS a, min(bbl) AS bbl FROM b GROUP BY 1)
SELECT coalesce(az.bbl, ao.bbl) AS bbl, c_name AS unit, DATE '2024-01-05' AS executed_date, CASE WHEN az.bbl IS NOT NULL THEN 'address and zip' ELSE 'address' END AS method FROM r LEFT JOIN az USING (a, z) JOIN ao ON ao.a = r.a""")
def curated_evictions(t: Tables) -> DataFrame:
    """Matched by address and zip, else by address."""
    raw = t.customer.select(F.concat(text(c("c_custkey") % 60), F.lit(" main st")).alias("eviction_address"), F.when(c("c_custkey") % 2 == 0, text(10_001 + c("c_nationkey") % 4)).alias("eviction_zip"), c("c_name").alias("eviction_apartment"), F.lit("1/5/2024").alias("executed_date"))
    return wh.evictions(raw, wh.buildings(_pluto(t)))


@query(f"""WITH k AS (SELECT *, (1 + c_custkey % 5) * 1000000000 + (c_custkey % 90000) * 10000 + c_nationkey AS key FROM customer)
SELECT CAST(key AS BIGINT) AS bbl, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '7 OAK ST' ELSE 'OAK ST' END AS address, c_mktsegment AS building_class FROM k""")
def curated_liens(t: Tables) -> DataFrame:
    """Blank house numbers and streets leave no gaps in the address."""
    k = c("c_custkey") % 3
    raw = t.customer.select(text(1 + c("c_custkey") % 5).alias("borough"), text(c("c_custkey") % 90_000).alias("block"), text(c("c_nationkey")).alias("lot"), F.when(k == 1, "7").when(k == 2, "").alias("house_number"), F.when(k == 0, "").otherwise("OAK ST").alias("street_name"), F.lit("m").alias("month"), F.lit("y").alias("cycle"), F.lit("2").alias("tax_class_code"), c("c_mktsegment").alias("building_class"))
    return wh.tax_liens(raw).select("bbl", "address", "building_class")


@query(_BUILDINGS + f""", d AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), l AS (SELECT l_orderkey, CAST(min({_KEY}) AS BIGINT) AS bbl FROM lineitem JOIN part ON p_partkey = l_partkey JOIN b ON b.bbl = {_KEY} GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, l.bbl, CASE o_orderstatus WHEN 'F' THEN 'DEED' ELSE 'MTGE' END AS doc_type, CAST(o_orderdate AS DATE) AS document_date, round(o_totalprice, 2) AS amount, 'S' || o_custkey AS seller, 'B1; B2; B3' AS buyer FROM d JOIN l ON l_orderkey = o_orderkey""")
def curated_sales(t: Tables) -> DataFrame:
    """Documents with the smallest of their parcels and up to three names a side."""
    kind = F.when(c("o_orderstatus") == "F", "DEED").when(c("o_orderstatus") == "O", "MTGE").otherwise("OTHER")
    master = t.orders.select(text(c("o_orderkey")).alias("document_id"), kind.alias("doc_type"), F.concat(text(c("o_orderdate").cast("date")), F.lit("T00:00:00")).alias("document_date"), F.lit("2024-01-05").alias("recorded_datetime"), F.format_number("o_totalprice", 2).alias("document_amt"))
    lots = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey"))
    legals = lots.select(text(c("l_orderkey")).alias("document_id"), text(1 + c("p_partkey") % 5).alias("borough"), text(c("p_partkey") % 90_000 + 1).alias("block"), text(c("p_size")).alias("lot"), F.lit("n/a").alias("unit"))
    person = F.explode(F.array(F.struct(F.lit("1").alias("k"), F.concat(F.lit("S"), text(c("o_custkey"))).alias("n")), *[F.struct(F.lit("2").alias("k"), F.lit(f"B{i}").alias("n")) for i in (4, 2, 3, 1)]))
    parties = t.orders.select(text(c("o_orderkey")).alias("document_id"), person.alias("p")).select("document_id", c("p.k").alias("party_type"), c("p.n").alias("name"))
    known = wh.buildings(_pluto(t))
    return wh.sales(master, legals, parties, known).select("document_id", "bbl", "doc_type", "document_date", "amount", "seller", "buyer")


@query(_BUILDINGS + f"""SELECT CAST('buildings' AS VARCHAR) AS name, count(*) AS n, count(DISTINCT bbl) AS keys FROM b UNION ALL SELECT 'violations', count(*), count(DISTINCT {_KEY}) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 4 > 0
UNION ALL SELECT 'permits', count(*), count(DISTINCT (1 + o_custkey % 5) * 1000000000 + (o_orderkey % 90000) * 10000 + o_custkey % 7000) FROM orders""")
def warehouse_report(t: Tables) -> DataFrame:
    """Rows and buildings of curated tables."""
    tables = {"buildings": curated_buildings(t), "violations": curated_violations(t), "permits": curated_permits(t)}
    parts = [df.agg(F.count("*").alias("n"), F.count_distinct("bbl").alias("keys")).select(F.lit(name).alias("name"), "n", "keys") for name, df in tables.items()]
    return parts[0].union(parts[1]).union(parts[2])
