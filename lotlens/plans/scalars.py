"""Scalar functions on texts that are made of the provided data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions import address, clean, keys, listing
from lotlens.operators import aggregates as agg
from lotlens.plans.registry import Tables, query
from lotlens.plans.scoring import _BOARD, part_board, score_buildings

c = F.col


@query("SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN trunc(p_retailprice) WHEN 3 THEN p_size ELSE 0 END AS BIGINT) AS n, CAST(CASE p_partkey % 4 WHEN 0 THEN trunc(p_retailprice) WHEN 3 THEN p_size END AS BIGINT) AS strict FROM part")
def parse_whole_numbers(t: Tables) -> DataFrame:
    k = c("p_partkey") % 4
    raw = F.when(k == 0, c("p_retailprice").cast("string")).when(k == 1, "").when(k == 2, "7a").otherwise(c("p_size").cast("string"))
    return t.part.select("p_partkey", clean.parse_int(raw).alias("n"), clean.parse_int(raw, None).alias("strict"))


@query("SELECT c_custkey, CAST(1 + c_custkey % 5 AS VARCHAR) || right('00000' || CAST(c_custkey * 37 AS VARCHAR), 5) || right('0000' || CAST(c_nationkey AS VARCHAR), 4) AS key FROM customer")
def padded_keys(t: Tables) -> DataFrame:
    """Blocks of over five digits keep their last five."""
    return t.customer.select("c_custkey", keys.padded_key(1 + c("c_custkey") % 5, F.concat(F.lit(" "), (c("c_custkey") * 37).cast("string"), F.lit(" ")), c("c_nationkey")).alias("key"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 < 5 THEN CAST((CASE c_custkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 2 END)::BIGINT * 1000000000 + (c_custkey % 90000) * 10000 + c_nationkey AS BIGINT) END AS key FROM customer""")
def text_keys(t: Tables) -> DataFrame:
    """A borough's name before five digits of the block and four or five of the lot."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("BROOKLYN", " manhattan", "QUEENS", "STATEN ISLAND", "Bronx ", "NOWHERE")]), (1 + c("c_custkey") % 6).cast("int"))
    digits = F.concat(F.lpad((c("c_custkey") % 90_000).cast("string"), 5, "0"), F.lpad(c("c_nationkey").cast("string"), 5, "0"))
    short = F.concat(F.lpad((c("c_custkey") % 90_000).cast("string"), 5, "0"), F.lpad(c("c_nationkey").cast("string"), 4, "0"))
    return t.customer.select("c_custkey", keys.key_from_text(F.concat(name, F.when(c("c_custkey") % 2 == 0, digits).otherwise(short))).alias("key"))


@query("""WITH k AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '3000010001' WHEN 1 THEN '300001000100' WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN '0000000000' END AS key FROM customer)
SELECT c_custkey, coalesce(regexp_full_match(key, '[1-5][0-9]{9}'), false) AS usable, CASE WHEN length(key) >= 10 THEN substr(key, 1, 10) END AS normal FROM k""")
def usable_keys(t: Tables) -> DataFrame:
    k = c("c_custkey") % 5
    key = F.when(k == 0, "3000010001").when(k == 1, "300001000100").when(k == 2, c("c_custkey").cast("string")).when(k == 3, "0000000000")
    return t.customer.select("c_custkey", keys.is_usable(key).alias("usable"), keys.normalize_length(key).alias("normal"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice) AS DOUBLE) END AS asking, CASE o_orderkey % 3 WHEN 0 THEN 4.5 WHEN 1 THEN -(1 + o_custkey % 20) END::DOUBLE AS discount FROM orders""")
def listing_status(t: Tables) -> DataFrame:
    """Asking price and discount of a status line, where it has them."""
    asking = F.concat(F.lit("asking: $"), F.format_number(F.floor("o_totalprice"), 0))
    off = F.concat(F.lit("closed at -"), (1 + c("o_custkey") % 20).cast("string"), F.lit("% "))
    line = F.when(c("o_orderkey") % 3 == 0, "4.5% under").when(c("o_orderkey") % 3 == 1, F.concat(off, asking)).otherwise(asking)
    return t.orders.select("o_orderkey", clean.asking_price(line).alias("asking"), clean.discount_percent(line).alias("discount"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 > 0 THEN p_size % 3 END, 0) + 0.5 * coalesce(CASE WHEN p_size % 2 > 0 THEN 1 END, 0)::DOUBLE AS baths, CASE p_size % 6 WHEN 0 THEN 'condo' WHEN 1 THEN 'condop' WHEN 2 THEN 'coop' WHEN 3 THEN 'coop' WHEN 4 THEN 'rental' ELSE 'unknown' END AS ownership,
  CASE p_size % 3 WHEN 0 THEN CAST(1000000000 + p_partkey AS VARCHAR) WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE 'feed-' || p_partkey END || '-' || p_size || 'A' AS unit_id, CASE WHEN p_size % 4 > 0 THEN '1000' || p_size % 4 END AS zip FROM part""")
def unit_fields(t: Tables) -> DataFrame:
    """Bathrooms, ownership, the composed id and the zip of a unit's record."""
    n, key = c("p_size"), c("p_partkey")
    kind = F.when(n % 6 == 0, "Big CONDO unit").when(n % 6 == 1, "Condop").when(n % 6 == 2, "Co-Op").when(n % 6 == 3, "coop apartment").when(n % 6 == 4, "Rental unit")
    tail = F.concat(n.cast("string"), F.lit(" Oak St, New York, NY 1000"), (n % 4).cast("string"), F.when(n % 2 == 0, "-1234 ").otherwise(""))
    return t.part.select(
        "p_partkey",
        clean.bathrooms(F.when(n % 3 > 0, n % 3), F.when(n % 2 > 0, F.lit(1))).cast("double").alias("baths"),
        listing.ownership_type(kind).alias("ownership"),
        keys.unit_id(F.when(n % 3 == 0, 1_000_000_000 + key), F.when(n % 3 == 1, key), F.lit("feed"), key, F.concat(n.cast("string"), F.lit("A"))).alias("unit_id"),
        address.zip_of(F.when(n % 4 > 0, tail).otherwise("Oak St, New York")).alias("zip"),
    )


@query(_BOARD + """SELECT key, array_to_string(list_filter([CASE WHEN area >= 600 THEN 'size' END, CASE WHEN cr < 10 OR rr = 0 THEN 'care' END, CASE WHEN nr < 1 THEN 'quiet' END, CASE WHEN year BETWEEN 1880 AND 1945 OR year >= 2015 THEN 'age' END,
  CASE WHEN units BETWEEN 6 AND 30 OR floors >= 6 THEN 'form' END, CASE WHEN stable THEN 'value' END], lambda r: r IS NOT NULL), ',') AS reasons FROM s""")
def building_reasons(t: Tables) -> DataFrame:
    """The components of a building's quality that gave points."""
    return score_buildings(part_board(t)).select("key", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT regexp_replace(regexp_replace(url, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS format, count(*) AS n, min(url) AS sample FROM pages GROUP BY 1 ORDER BY n DESC, format LIMIT 12""")
def profile_formats(t: Tables) -> DataFrame:
    """The most frequent formats of a source's text column, with a sample."""
    return agg.value_formats(t.pages, "url", 12)


@query("""SELECT 'l_returnflag' AS field, * FROM (SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 3) UNION ALL SELECT 'l_linenumber', * FROM (SELECT CAST(l_linenumber AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 3)""")
def profile_top_values(t: Tables) -> DataFrame:
    """The most frequent values of a source's columns."""
    top = lambda f: agg.top_values(t.lineitem.select(c(f).cast("string").alias("value")), "value", 3).select(F.lit(f).alias("field"), "value", "n")
    return top("l_returnflag").union(top("l_linenumber"))
