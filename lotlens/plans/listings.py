"""Listings: keys and dates cleaned, addresses matched, events unified, duplicates across sources flagged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions import address, clean, keys, listing
from lotlens.operators import aggregates as agg
from lotlens.plans.registry import Tables, query


def dedup_listings(df: DataFrame, by: Sequence[str], priority: Sequence[str], tolerance: float = 0.10, id_col: str = "id", source: str = "source", price: str = "price") -> DataFrame:
    """Adds is_duplicate and canonical_id.

    In a group of several sources the row of the first source (smallest id at ties) is canonical, and every other
    row is its duplicate if either price is missing or they differ by at most the tolerance. A row is compared with
    the canonical one alone. Rows with a null in the key are not grouped and not shuffled. One shuffle serves all windows.
    """
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    alone = df.filter(~keyed).withColumn("is_duplicate", F.lit(False)).withColumn("canonical_id", F.lit(None).cast(df.schema[id_col].dataType))
    df = df.filter(keyed)
    order = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in priority]), F.col(source)), F.lit(0))
    rank = F.when(order == 0, len(priority) + 1).otherwise(order)
    w = Window.partitionBy(*by)
    first = F.first(F.struct(F.col(id_col).alias("id"), F.coalesce(price, F.lit(0.0)).alias("price"))).over(w.orderBy(rank, id_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = df.withColumn("_main", first).withColumn("_several", F.min(source).over(w) != F.max(source).over(w))
    mine = F.coalesce(price, F.lit(0.0))
    close = (F.col("_main.price") <= 0) | (mine <= 0) | (F.abs(F.col("_main.price") - mine) / F.col("_main.price") <= tolerance)
    duplicate = F.col("_several") & (F.col(id_col) != F.col("_main.id")) & close
    return out.withColumn("is_duplicate", F.coalesce(duplicate, F.lit(False))).withColumn("canonical_id", F.when(F.col("is_duplicate"), F.col("_main.id"))).drop("_main", "_several").unionByName(alone)


def match_listings(rows: DataFrame, reference: DataFrame, row_address: str, row_borough: str, ref_address: str, ref_borough: str, ref_key: str) -> DataFrame:
    """Adds the reference's key by normalised address and borough, the smallest key at ties, and the method."""
    ref = reference.groupBy(address.address_key(F.col(ref_address), F.col(ref_borough)).alias("_k")).agg(F.min(ref_key).alias(ref_key))
    out = rows.withColumn("_k", address.address_key(F.col(row_address), F.col(row_borough))).join(ref, "_k", "left").drop("_k")
    return out.withColumn("method", F.when(F.col(ref_key).isNotNull(), "address").otherwise("none"))


def unify(parts: Sequence[DataFrame], by: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """Listings of all feeds in one table with units normalised and duplicates flagged."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return dedup_listings(out.withColumn("unit", clean.normalize_unit(F.col("unit"))), by, priority)


def history_rows(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """Event rows of a nested history array kept as JSON text."""
    schema = "listingHistories array<struct<date:string,event:string,price:double>>"
    parsed = df.select(*keep, F.explode(F.from_json(json_col, schema)["listingHistories"]).alias("h"))
    return parsed.select(*keep, clean.normalize_date(F.col("h.date")).alias("event_date"), listing.canonical_event(F.col("h.event"))["event"].alias("event"), F.col("h.price").alias("price"))


@query("""SELECT o_orderkey, CAST(CAST(1 + o_custkey % 5 AS VARCHAR) || lpad(CAST(o_orderkey % 90000 AS VARCHAR), 5, '0') || right('0000' || CAST(o_custkey % 12000 AS VARCHAR), 4) AS BIGINT) AS key,
  lpad(CAST(o_orderkey % 90000 AS VARCHAR), 5, '0') AS block, CAST(o_custkey % 12000 % 10000 AS INTEGER) AS lot FROM orders""")
def make_keys(t: Tables) -> DataFrame:
    """Keys from a borough name, a block and a lot of up to five digits, and taken apart again."""
    names = F.array(*[F.lit(x) for x in ("Manhattan", "Bronx", "BROOKLYN", "queens", "Staten Island")])
    key = keys.make_key(F.element_at(names, (1 + F.col("o_custkey") % 5).cast("int")), F.col("o_orderkey") % 90_000, F.col("o_custkey") % 12_000)
    return t.orders.select("o_orderkey", key.alias("key")).select("o_orderkey", "key", F.substring(keys.block_of(F.col("key")), 2, 5).alias("block"), keys.lot_of(F.col("key")).alias("lot"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def normalize_dates(t: Tables) -> DataFrame:
    """Each date written in one of four formats comes back."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    return t.orders.select("o_orderkey", clean.normalize_date(text).alias("d"))


@query("SELECT o_orderkey, floor(o_totalprice) AS price, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE round(o_totalprice, 2) END AS amount FROM orders")
def parse_money(t: Tables) -> DataFrame:
    price = F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0), F.lit("\n↓ 2%"))
    dirty = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit("$ "), F.format_number("o_totalprice", 2)))
    return t.orders.select("o_orderkey", clean.display_price(price).alias("price"), F.round(clean.money(dirty, 0.0), 2).alias("amount"))


@query("""SELECT c_custkey, CAST(c_custkey AS VARCHAR) || ' E ' || CAST(c_nationkey + 4 AS VARCHAR) || 'TH ST' AS street, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey % 30 AS VARCHAR) || 'C' END AS unit, 'NY' AS state,
  CAST(10000 + c_custkey % 300 AS VARCHAR) AS zip, CASE c_custkey % 3 WHEN 0 THEN 'MN' WHEN 1 THEN 'BK' END AS borough FROM customer""")
def parse_addresses(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    unit = F.when(c % 4 == 0, "").otherwise(F.concat(F.lit(" "), (c % 30).cast("string"), F.lit("C")))
    city = F.when(c % 3 == 0, "New York").when(c % 3 == 1, "Brooklyn").otherwise("Yonkers")
    text = F.concat(c.cast("string"), F.lit(" E "), (F.col("c_nationkey") + 4).cast("string"), F.lit("TH ST"), unit, F.lit(", "), city, F.lit(", NY "), (10_000 + c % 300).cast("string"))
    p = address.parse_listing_address(text)
    return t.customer.select("c_custkey", p.alias("p")).select("c_custkey", "p.street", "p.unit", "p.state", "p.zip", "p.borough")


@query("""SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || '-OAK AVE' AS address, 'BK' AS borough, '5g' AS unit FROM supplier""")
def parse_slugs(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://homes.example/building/"), F.col("s_suppkey").cast("string"), F.lit("_oak-avenue-brooklyn/5g?x=1"))
    b = t.supplier.select("s_suppkey", address.parse_building_url(url).alias("b"))
    return b.select("s_suppkey", address.slug_address(F.col("b.slug")).alias("address"), address.slug_borough(F.col("b.slug")).alias("borough"), "b.unit")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'listed' WHEN 1 THEN 'sold' WHEN 2 THEN 'price_change' WHEN 3 THEN NULL WHEN 4 THEN 'price_point' ELSE 'delisted' END AS event,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Agent ' || o_custkey END AS broker FROM orders""")
def canonical_events(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.concat(F.lit("Listed by Agent "), F.col("o_custkey").cast("string"))).when(k == 1, " Listing sold ").when(k == 2, "Price decreased by 2%").when(k == 3, "Market Data and Facts").when(k == 4, "-").otherwise("No longer available")
    return t.orders.select("o_orderkey", listing.canonical_event(text).alias("e")).select("o_orderkey", "e.event", "e.broker")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'delisted' WHEN 1 THEN 'sold' WHEN 2 THEN 'closing' ELSE 'other' END AS event, CASE o_orderkey % 4 WHEN 0 THEN 'A' || o_custkey WHEN 1 THEN 'B' || o_custkey END AS broker FROM orders""")
def display_events(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("Delisted by A"), c)).when(k == 1, F.concat(F.lit("Sold by B"), c, F.lit(" Closing record"))).when(k == 2, "Recorded closing").otherwise("odd")
    return t.orders.select("o_orderkey", listing.display_event(text).alias("e")).select("o_orderkey", "e.event", "e.broker")


_SOURCES = ["corner", "estate", "street"]
_LISTED = """WITH l AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'corner' WHEN '2-HIGH' THEN 'estate' WHEN '3-MEDIUM' THEN 'street' ELSE 'other' END AS source, o_custkey AS key, CAST(o_orderkey % 3 AS VARCHAR) || 'A' AS unit,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 1000 + o_orderkey % 250 END::DOUBLE AS price FROM orders),
 g AS (SELECT *, first_value(id) OVER w AS main, coalesce(first_value(coalesce(price, 0)) OVER w, 0) AS main_price, min(source) OVER (PARTITION BY key, unit) <> max(source) OVER (PARTITION BY key, unit) AS several
   FROM l WINDOW w AS (PARTITION BY key, unit ORDER BY CASE source WHEN 'corner' THEN 1 WHEN 'estate' THEN 2 WHEN 'street' THEN 3 ELSE 4 END, id)),
 d AS (SELECT id, source, key, unit, price, several AND id <> main AND (main_price <= 0 OR coalesce(price, 0) <= 0 OR abs(main_price - price) / main_price <= 0.10) AS is_duplicate, main FROM g) """


def _unified(t: Tables) -> DataFrame:
    o = t.orders
    source = F.when(F.col("o_orderpriority") == "1-URGENT", "corner").when(F.col("o_orderpriority") == "2-HIGH", "estate").when(F.col("o_orderpriority") == "3-MEDIUM", "street").otherwise("other")
    unit = F.concat(F.lit("# "), (F.col("o_orderkey") % 3).cast("string"), F.lit(" a"))
    price = F.when(F.col("o_orderkey") % 11 != 0, (1000 + F.col("o_orderkey") % 250).cast("double"))
    rows = o.select(F.col("o_orderkey").alias("id"), source.alias("source"), F.col("o_custkey").alias("key"), unit.alias("unit"), price.alias("price"))
    return unify([rows], ["key", "unit"], _SOURCES)


@query(_LISTED + "SELECT id, source, key, unit, is_duplicate, CASE WHEN is_duplicate THEN main END AS canonical_id FROM d")
def unified_listings(t: Tables) -> DataFrame:
    return _unified(t).select("id", "source", "key", "unit", "is_duplicate", "canonical_id")


@query(_LISTED + "SELECT source, is_duplicate, count(*) AS n, count(DISTINCT key) AS keys FROM d GROUP BY 1, 2")
def unify_status(t: Tables) -> DataFrame:
    return _unified(t).groupBy("source", "is_duplicate").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query(_LISTED + "SELECT id, price FROM d WHERE source IN ('corner', 'estate') AND price BETWEEN 1050 AND 1200 AND NOT is_duplicate ORDER BY price DESC, id LIMIT 40")
def listing_search(t: Tables) -> DataFrame:
    from lotlens.operators.ranking import page, search

    found = search(_unified(t).filter(F.col("price").between(1050, 1200)), equal={"is_duplicate": False}, within={"source": ("corner", "estate")})
    return page(found, "price", ("price",), "id", limit=40).select("id", "price")


@query("""WITH c AS (SELECT c_custkey, upper(c_name) AS a, CASE c_nationkey % 2 WHEN 0 THEN 'MN' ELSE 'BK' END AS b FROM customer), r AS (SELECT min(s_suppkey) AS s_suppkey, CASE s_nationkey % 2 WHEN 0 THEN 'MN' ELSE 'BK' END AS b, s_suppkey % 50 AS k FROM supplier GROUP BY 2, 3)
SELECT c_custkey, s_suppkey, CASE WHEN s_suppkey IS NULL THEN 'none' ELSE 'address' END AS method FROM c LEFT JOIN r ON r.b = c.b AND r.k = c_custkey % 80""")
def match_addresses(t: Tables) -> DataFrame:
    """Written as street on one side and st on the other."""
    boro = lambda c: F.when(F.col(c) % 2 == 0, "MN").otherwise("BK")
    rows = t.customer.select("c_custkey", F.concat((F.col("c_custkey") % 80).cast("string"), F.lit(" Main Street")).alias("a"), boro("c_nationkey").alias("b"))
    ref = t.supplier.select("s_suppkey", F.concat((F.col("s_suppkey") % 50).cast("string"), F.lit(" MAIN ST ")).alias("ra"), boro("s_nationkey").alias("rb"))
    return match_listings(rows, ref, "a", "b", "ra", "rb", "s_suppkey").select("c_custkey", "s_suppkey", "method")


@query("""SELECT method, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM (SELECT CASE WHEN s_suppkey IS NULL THEN 'none' ELSE 'key' END AS method FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 150) GROUP BY 1""")
def match_rate(t: Tables) -> DataFrame:
    out = t.customer.withColumn("s_suppkey", F.col("c_custkey") % 150).join(t.supplier.select("s_suppkey", F.lit(True).alias("hit")), "s_suppkey", "left").groupBy(F.when(F.col("hit"), "key").otherwise("none").alias("method")).agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(out.agg(F.sum("n").alias("all")))).select("method", "n", agg.share(F.col("n"), F.col("all")).alias("pct"))


@query("""SELECT o_orderkey, 'listed' AS event, CAST(o_orderdate AS DATE) AS event_date, o_totalprice AS price FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'rented' ELSE 'sold' END, CAST(o_orderdate AS DATE) + 30, o_totalprice * 0.5 FROM orders WHERE o_orderstatus = 'F'""")
def listing_event_rows(t: Tables) -> DataFrame:
    d, filled = F.col("o_orderdate").cast("date"), F.col("o_orderstatus") == "F"
    kind = F.when(F.col("o_orderkey") % 2 == 0, "rental").otherwise("sale")
    events = listing.listing_events(d, F.col("o_totalprice"), F.when(filled, F.date_add(d, 30)), F.when(filled, F.col("o_totalprice") * 0.5), kind)
    return t.orders.select("o_orderkey", F.inline(events))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS event_date, 'sold' AS event, CAST(round(o_totalprice) AS DOUBLE) AS price FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), 'rented', 1.0 FROM orders WHERE o_orderstatus = 'P'""")
def nested_history(t: Tables) -> DataFrame:
    item = lambda event, price: F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit(event).alias("event"), price.alias("price"))
    doc = F.to_json(F.struct(F.array(item("SOLD", F.round("o_totalprice")), item("RENTED", F.lit(1.0))).alias("listingHistories")))
    return history_rows(t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", doc.alias("j")), "j", "o_orderkey").select("o_orderkey", "event_date", "event", "price")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',\"v\":\"' || event_type || '\"}' AS j FROM events")
def json_round_trip(t: Tables) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("v"))).alias("j"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1000 + p_size ELSE least(900 + p_size, 950 + p_size) END::DOUBLE AS price, 2 + CAST(p_size % 2 = 0 AS INTEGER) AS terms FROM part""")
def primary_prices(t: Tables) -> DataFrame:
    s = F.col("p_size")
    twelve = F.when(s % 2 == 0, F.create_map(F.lit("12"), (1000 + s).cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    rates = F.map_concat(F.create_map(F.lit("6"), (950 + s).cast("double"), F.lit("18"), (900 + s).cast("double")), twelve)
    terms = listing.lease_terms(rates)
    return t.part.select("p_partkey", listing.primary_price(terms).alias("price"), F.size(terms).alias("terms"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN true ELSE false END AS valid FROM part""")
def valid_listings(t: Tables) -> DataFrame:
    s = F.col("p_size")
    price = F.when(s % 3 == 0, "$2,408").when(s % 3 == 1, "$120").otherwise("2408")
    return t.part.select("p_partkey", listing.is_valid_listing(F.lit("12C"), F.lit("1 Bed / 1 Bath"), price, F.lit("Mar 3")).alias("valid"))


@query("""SELECT p_partkey, p_size % 4 AS beds, 1.5::DOUBLE AS baths, '0' || p_size || 'M' AS unit, 1000 + p_partkey AS price FROM part""")
def unit_labels(t: Tables) -> DataFrame:
    beds = F.col("p_size") % 4
    first = F.when(beds == 0, "Studio").otherwise(F.concat(beds.cast("string"), F.lit(" Bedroom")))
    text = F.concat_ws(" | ", first, F.lit("Bath 1.5"), F.concat(F.lit("Apt 0"), F.col("p_size").cast("string"), F.lit("M")), F.concat(F.lit("$"), F.format_number(1000 + F.col("p_partkey"), 0)))
    return t.part.select("p_partkey", listing.unit_label(text).alias("u")).select("p_partkey", "u.*")


@query("SELECT p_partkey, CASE WHEN p_size <= 25 THEN p_size END AS floor, p_size % 2 = 0 AS washer FROM part")
def amenities(t: Tables) -> DataFrame:
    s = F.col("p_size")
    floor = F.struct(F.when(s <= 25, F.concat(F.lit("FS"), F.lpad(s.cast("string"), 2, "0"))).otherwise("XX").alias("code"), F.lit("view").alias("description"))
    washer = F.struct(F.lit("A1").alias("code"), F.when(s % 2 == 0, "Washer & dryer in unit").otherwise("gym").alias("description"))
    a = F.array(washer, floor)
    return t.part.select("p_partkey", listing.floor_number(a).alias("floor"), listing.has_washer_dryer(a).alias("washer"))


@query("""SELECT CAST(CASE WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 150000 THEN 2 WHEN o_totalprice >= 50000 THEN 1 ELSE 0 END AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY 1""")
def price_buckets(t: Tables) -> DataFrame:
    return t.orders.groupBy(listing.price_bucket(F.col("o_totalprice"), (50_000, 150_000, 300_000)).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_size || ' Oak St' || CASE WHEN p_size % 2 = 0 THEN ' 3A' ELSE '' END || ', Bronx' AS full_address, CASE p_size % 3 WHEN 0 THEN 'Studio' WHEN 1 THEN '1 Bed' ELSE '2 Beds' END || CASE WHEN p_size % 2 = 0 THEN ' / 1 Bath' ELSE ' / 1.5 Baths' END AS rooms,
  CASE WHEN p_size % 5 > 0 THEN round(p_retailprice / (p_size % 5), 2) END AS price_per_area FROM part""")
def derived_fields(t: Tables) -> DataFrame:
    s = F.col("p_size")
    fields = listing.derived_fields(F.concat(s.cast("string"), F.lit(" Oak St")), F.when(s % 2 == 0, "3A").otherwise(""), F.lit("Bronx"), F.col("p_retailprice"), s % 5, s % 3, F.when(s % 2 == 0, 1.0).otherwise(1.5))
    return t.part.select("p_partkey", fields.alias("f")).select("p_partkey", "f.*")
