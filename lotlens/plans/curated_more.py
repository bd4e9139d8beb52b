"""The other curated tables on the provided data, with the stand-ins of `curated`: a building is a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.plans import warehouse as wh
from lotlens.plans.curated import _BUILDINGS, _KEY, _bridge, _key, _pluto, text
from lotlens.plans.registry import Tables, query

c = F.col
_BBL = f"CAST({_KEY} AS BIGINT)"


def _day(column: str, form: str = "yyyy-MM-dd'T'00:00:00") -> Column:
    return F.date_format(c(column).cast("date"), form)


def _events(t: Tables) -> DataFrame:
    """Events with the part that has their user's number."""
    return t.events.join(t.part, c("user_id") == c("p_partkey"))


def _parts(key: Column) -> tuple[Column, Column, Column]:
    """Borough, block and lot of a ten-digit key as unpadded text."""
    return text(F.floor(key / 1_000_000_000)), text(F.floor(key / 10_000) % 100_000), text(key % 10_000)


@query(f"SELECT CAST(p_partkey AS BIGINT) AS bin, {_BBL} AS bbl FROM part WHERE p_partkey % 4 > 0")
def curated_bin_map(t: Tables) -> DataFrame:
    return wh.bin_map(_bridge(t))


@query(f"SELECT {_BBL} AS bbl, 'A' || event_id % 9 AS unit, event_type AS category, CAST(hour(ts) AS VARCHAR) AS subcategory, 'OPEN' AS status, CAST(ts AS DATE) AS received_date, CASE WHEN event_id % 2 = 0 THEN 'EMERGENCY' END AS type FROM events JOIN part ON p_partkey = user_id WHERE p_partkey % 4 > 0")
def curated_hpd_complaints(t: Tables) -> DataFrame:
    raw = t.events.select(text(c("user_id")).alias("bin"), F.concat(F.lit("A"), text(c("event_id") % 9)).alias("apartment"), c("event_type").alias("major_category"), text(F.hour("ts")).alias("minor_category"), F.lit("OPEN").alias("status"), _day("ts").alias("received_date"), F.when(c("event_id") % 2 == 0, "EMERGENCY").alias("type"))
    return wh.hpd_complaints(raw, wh.bin_map(_bridge(t)))


@query(_BUILDINGS + f"SELECT {_BBL} AS bbl, event_type AS complaint_type, CAST(event_id AS VARCHAR) AS descriptor, CAST(ts AS DATE) AS created_date, CASE WHEN event_id % 3 > 0 THEN CAST(ts AS DATE) END AS closed_date, 'S' AS status FROM events JOIN part ON p_partkey = user_id WHERE {_BBL} IN (SELECT bbl FROM b)")
def curated_service_requests(t: Tables) -> DataFrame:
    raw = _events(t).select(F.concat(text(_key()), F.lit(".0")).alias("bbl"), c("event_type").alias("complaint_type"), text(c("event_id")).alias("descriptor"), _day("ts").alias("created_date"), F.when(c("event_id") % 3 > 0, _day("ts", "M/d/yyyy")).otherwise("").alias("closed_date"), F.lit("S").alias("status"))
    return wh.service_requests(raw, wh.buildings(_pluto(t)))


@query(f"SELECT {_BBL} AS bbl, 'C' || event_id AS complaint_number, event_type AS category, 'U' || event_id % 7 AS unit, 'X1' AS code, CAST(ts AS DATE) AS disposition_date FROM events JOIN part ON p_partkey = user_id WHERE p_partkey % 4 > 0")
def curated_dob_complaints(t: Tables) -> DataFrame:
    """The feed's own key is not trusted: only the building number counts."""
    raw = t.events.select(F.lit("1").alias("bbl"), text(c("user_id")).alias("bin"), F.concat(F.lit("C"), text(c("event_id"))).alias("complaint_number"), c("event_type").alias("complaint_category"), F.concat(F.lit("U"), text(c("event_id") % 7)).alias("unit"), F.lit("X1").alias("disposition_code"), _day("ts", "MM/dd/yyyy").alias("disposition_date"))
    return wh.dob_complaints(raw, wh.bin_map(_bridge(t)))


@query(_BUILDINGS + f"SELECT {_BBL} AS bbl, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS case_id, l_returnflag AS case_type, CAST(l_shipdate AS DATE) AS open_date, l_linestatus AS status FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {_BBL} IN (SELECT bbl FROM b)")
def curated_litigation(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))
    raw = lines.select(text(_key()).alias("bbl"), text(c("l_orderkey") * 10 + c("l_linenumber")).alias("litigationid"), c("l_returnflag").alias("casetype"), _day("l_shipdate", "yyyyMMdd").alias("caseopendate"), c("l_linestatus").alias("casestatus"))
    return wh.litigation(raw, wh.buildings(_pluto(t)))


@query(f"SELECT {_BBL} AS bbl, CASE c_custkey % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'head officer' ELSE 'lessee' END AS role, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Ann ' || c_custkey END AS name, DATE '2024-01-05' AS registered FROM customer JOIN supplier ON s_suppkey = 1 + c_custkey % 50 JOIN part ON p_partkey = s_suppkey WHERE p_partkey % 4 > 0")
def curated_contacts(t: Tables) -> DataFrame:
    """Companies by their name, persons by theirs; roles by the table of roles, others in lower case."""
    registrations = t.supplier.select(text(c("s_suppkey")).alias("registrationid"), text(c("s_suppkey")).alias("bin"), F.lit("2024-01-05T00").alias("lastregistrationdate"))
    k = c("c_custkey")
    people = t.customer.select(text(1 + k % 50).alias("registrationid"), F.when(k % 3 == 0, "Agent").when(k % 3 == 1, "HeadOfficer").otherwise("Lessee").alias("contacttype"), F.when(k % 2 == 0, c("c_name")).otherwise(" ").alias("corporationname"), F.lit("Ann").alias("firstname"), text(k).alias("lastname"))
    return wh.contacts(registrations, people, wh.bin_map(_bridge(t)))


@query(_BUILDINGS + f""", r AS (SELECT p_partkey, {_BBL} AS k, p_partkey % 2 = 0 AS direct, p_size AS n FROM part),
 x AS (SELECT CASE WHEN direct AND k IN (SELECT bbl FROM b) THEN k WHEN p_partkey % 4 > 0 THEN k END AS bbl, n, p_partkey FROM r)
SELECT bbl, max(n) AS stab_units, bool_or(p_partkey % 5 = 0) AS has_421a, bool_or(false) AS has_j51 FROM (SELECT bbl, n, p_partkey FROM x UNION ALL SELECT bbl, n + 1, 1 FROM x) WHERE bbl IS NOT NULL GROUP BY 1""")
def curated_rent_stabilization(t: Tables) -> DataFrame:
    """By parcel where it is given and known, else by building number; two years of each building."""
    raw = t.part.select(F.when(c("p_partkey") % 2 == 0, text(_key())).alias("bbl"), text(c("p_partkey")).alias("bin"), F.explode(F.array(F.struct(c("p_size").alias("n"), (c("p_partkey") % 5 == 0).alias("a")), F.struct((c("p_size") + 1).alias("n"), F.lit(False).alias("a")))).alias("y"))
    raw = raw.select("bbl", "bin", c("y.n").alias("num_stabilized_units"), c("y.a").alias("has_421a"), F.lit(False).alias("has_j51"))
    return wh.rent_stabilization(raw, wh.buildings(_pluto(t)), wh.bin_map(_bridge(t)))


@query(_BUILDINGS + f""", r AS (SELECT p_partkey, p_size, {_BBL} AS k FROM part)
SELECT k AS bbl, 'J' || p_partkey AS job_number, DATE '2024-01-05' AS issue_date, 'Final' AS co_type, CAST(p_size AS INTEGER) AS existing_units, CAST(0 AS INTEGER) AS proposed_units, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 > 0 THEN 'bin' ELSE 'bbl' END AS method FROM r WHERE (p_partkey % 3 = 0 AND p_partkey % 4 > 0) OR k IN (SELECT bbl FROM b)""")
def curated_certificates(t: Tables) -> DataFrame:
    """By building number, else by parcel."""
    borough, block, lot = _parts(_key())
    raw = t.part.select(F.when(c("p_partkey") % 3 == 0, text(c("p_partkey"))).otherwise("x").alias("bin"), borough.alias("borough"), block.alias("block"), lot.alias("lot"), F.concat(F.lit("J"), text(c("p_partkey"))).alias("job_number"), F.lit("20240105").alias("co_issue_date"), F.lit("Final").alias("co_type"), text(c("p_size")).alias("existing_dwelling_units"), F.lit("").alias("proposed_dwelling_units"))
    return wh.certificates(raw, wh.buildings(_pluto(t)), wh.bin_map(_bridge(t)))


@query("""SELECT CAST((1 + l_partkey % 5) * 1000000000 + (1 + l_suppkey) * 10000 + l_linenumber AS BIGINT) AS bbl, CAST(l_linenumber AS VARCHAR) AS apartment, l_returnflag AS class, CAST(l_shipdate AS DATE) AS inspection_date, CAST(NULL AS DATE) AS approved_date, l_linestatus AS description, 'OPEN' AS currentstatus, l_returnflag = 'R' AS rent_impairing FROM lineitem WHERE l_suppkey % 6 > 0""")
def curated_hpd_violations(t: Tables) -> DataFrame:
    """Boroughs of a number that is none have no key and go."""
    boroid = F.when(c("l_suppkey") % 6 > 0, text(1 + c("l_partkey") % 5)).otherwise("7")
    raw = t.lineitem.select(boroid.alias("boroid"), text(1 + c("l_suppkey")).alias("block"), F.concat(F.lit("00"), text(c("l_linenumber"))).alias("lot"), text(c("l_linenumber")).alias("apartment"), c("l_returnflag").alias("class"), _day("l_shipdate").alias("inspectiondate"), F.lit("soon").alias("approveddate"), c("l_linestatus").alias("novdescription"), F.lit("OPEN").alias("currentstatus"), F.when(c("l_returnflag") == "R", "Y").otherwise("N").alias("rentimpairing"))
    return wh.hpd_violations(raw)


@query("""SELECT CASE WHEN o_custkey % 7 > 0 THEN CAST((1 + o_custkey % 5) * 1000000000 + (o_custkey % 90000) * 10000 + o_orderkey % 9000 AS BIGINT) END AS bbl, 'A' || o_orderkey AS address, '10001' AS zip_code, CAST(o_custkey % 40 AS INTEGER) AS residential_units, CAST(0 AS INTEGER) AS year_built, round(o_totalprice, 2) AS sale_price, CAST(o_orderdate AS DATE) AS sale_date FROM orders""")
def curated_rolling_sales(t: Tables) -> DataFrame:
    """Rows without a usable key stay."""
    raw = t.orders.select(text(1 + c("o_custkey") % 5).alias("borough"), F.when(c("o_custkey") % 7 > 0, text(c("o_custkey") % 90_000)).otherwise("").alias("block"), text(c("o_orderkey") % 9000).alias("lot"), F.concat(F.lit("A"), text(c("o_orderkey"))).alias("address"), F.lit("10001").alias("zip_code"), text(c("o_custkey") % 40).alias("residential_units"), F.lit(" - ").alias("year_built"), F.format_number("o_totalprice", 2).alias("sale_price"), _day("o_orderdate").alias("sale_date"))
    return wh.rolling_sales(raw)


@query("""SELECT CAST((1 + o_custkey % 5) * 1000000000 + (1 + o_custkey % 90000) * 10000 + 1 + o_orderkey % 9000 AS BIGINT) AS bbl, 'N' || o_orderkey AS job_id, o_orderpriority AS job_type, CAST(o_orderdate AS DATE) AS filing_date, round(o_totalprice, 2) AS estimated_cost FROM orders WHERE o_orderkey % 5 > 0""")
def curated_dob_now_jobs(t: Tables) -> DataFrame:
    """The key as text, else of its parts; a fifth has neither."""
    k = (1 + c("o_custkey") % 5) * F.lit(1_000_000_000).cast("long") + (1 + c("o_custkey") % 90_000) * 10_000 + 1 + c("o_orderkey") % 9000
    borough, block, lot = _parts(k)
    gone = c("o_orderkey") % 5 == 0
    raw = t.orders.select(F.when(gone, "0").when(c("o_orderkey") % 2 == 0, text(k)).alias("bbl"), F.when(gone, "").otherwise(borough).alias("borough"), block.alias("block"), F.concat(F.lit("0"), F.lpad(lot, 4, "0")).alias("lot"), F.concat(F.lit("N"), text(c("o_orderkey"))).alias("job_filing_number"), c("o_orderpriority").alias("job_type"), _day("o_orderdate").alias("filing_date"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("initial_cost"))
    return wh.dob_now_jobs(raw)


@query(f"SELECT {_BBL} AS bbl, p_brand AS vacate_type, p_type AS primary_vacate_reason, DATE '2024-01-05' AS effective_date, CAST(p_size AS INTEGER) AS units FROM part WHERE p_partkey % 3 > 0")
def curated_vacate_orders(t: Tables) -> DataFrame:
    raw = t.part.select(F.when(c("p_partkey") % 3 > 0, text(_key())).otherwise("n/a").alias("bbl"), c("p_brand").alias("vacate_type"), c("p_type").alias("primary_vacate_reason"), F.lit("01/05/2024").alias("vacate_effective_date"), F.concat(text(c("p_size")), F.lit(".0")).alias("number_of_vacated_units"))
    return wh.vacate_orders(raw)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS name, 'A-C' AS lines, CASE WHEN s_suppkey % 4 > 0 THEN 40 + s_suppkey / 64 END AS latitude, -73.5::DOUBLE AS longitude FROM supplier")
def curated_subway_stations(t: Tables) -> DataFrame:
    raw = t.supplier.select(text(c("s_suppkey")).alias("station_id"), c("s_name").alias("name"), F.lit("A-C").alias("lines"), F.when(c("s_suppkey") % 4 > 0, text(40 + c("s_suppkey") / 64)).otherwise("").alias("latitude"), F.lit("-73.5").alias("longitude"))
    return wh.subway_stations(raw)


@query(_BUILDINGS + """, s AS (SELECT DISTINCT c_custkey % 60 AS k FROM customer) SELECT k || '-main-street-new_york' AS slug, min(bbl) AS bbl, CASE WHEN min(bbl) IS NOT NULL THEN 'address' ELSE 'none' END AS method FROM s LEFT JOIN b ON address = k || ' MAIN STREET' GROUP BY k""")
def curated_slug_buildings(t: Tables) -> DataFrame:
    """Slugs of a sitemap, matched to parcels by address and borough; slugs of other cities go, unmatched ones stay."""
    k = text(c("c_custkey") % 60)
    lines = t.customer.select(F.explode(F.array(F.concat(k, F.lit("-main-street-new_york?page=2")), F.concat(k, F.lit("-main-street-boston")))).alias("value")).distinct()
    return wh.slug_buildings(lines, wh.buildings(_pluto(t)))


@query("""WITH f AS (SELECT o_custkey AS job, o_orderkey AS bbl, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS feed FROM orders)
SELECT CAST(job AS VARCHAR) AS job_id, bbl, ['new', 'undated', 'legacy'][feed + 1] AS feed FROM f QUALIFY row_number() OVER (PARTITION BY job ORDER BY feed, bbl) = 1""")
def curated_merged_permits(t: Tables) -> DataFrame:
    """Three feeds of permits; the first row of a job in the order of the feeds."""
    feed = lambda status, name: t.orders.filter(c("o_orderstatus") == status).select(text(c("o_custkey")).alias("job_id"), c("o_orderkey").alias("bbl"), F.lit(name).alias("feed"))
    return wh.merged_permits(feed("F", "new"), feed("P", "undated"), feed("O", "legacy"))
