"""Reports and look-ups: dossiers, gems, alerts, warehouse assembly and the optional extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.operators import aggregates as agg
from lotlens.operators import joins, ranking, windows
from lotlens.operators.upsert import new_only
from lotlens.plans.registry import Tables, query


#: Documents whose keys are broadcast.
FEW = 100_000


def assemble_documents(master: DataFrame, legals: DataFrame, parties: DataFrame, doc: str, types: tuple[str, ...], type_col: str, k: int = 3) -> DataFrame:
    """Documents of the target types with one parcel each (the smallest) and up to k names per side.

    Legals and parties of few documents are reduced to these before they are aggregated; of many, the joins drop the rest.
    """
    kept = master.filter(F.col(type_col).isin(*types))
    lots, named = joins.narrowed(kept.select(doc), doc, FEW, legals, parties)
    parcel = lots.groupBy(doc).agg(F.min("parcel").alias("parcel"))
    side = lambda s, name: agg.first_k_text(named.filter(F.col("side") == s), [doc], "name", [], k, name=name)
    return joins.star(kept.join(parcel, doc), doc, side(1, "sellers"), side(2, "buyers")).fillna({"sellers": "", "buyers": ""})


@query("""WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P')),
 p AS (SELECT l_orderkey, s_name, 1 + l_linenumber % 2 AS side, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY s_name) AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT m.*, (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS parcel, coalesce((SELECT string_agg(s_name, '; ' ORDER BY s_name) FROM p WHERE l_orderkey = o_orderkey AND side = 1 AND k <= 3), '') AS sellers,
 coalesce((SELECT string_agg(s_name, '; ' ORDER BY s_name) FROM p WHERE l_orderkey = o_orderkey AND side = 2 AND k <= 3), '') AS buyers FROM m WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def assembled_documents(t: Tables) -> DataFrame:
    master = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), "o_totalprice", "o_orderstatus")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", (1 + F.col("l_linenumber") % 2).alias("side"))
    legals = lines.select("o_orderkey", F.col("l_partkey").alias("parcel"))
    parties = lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("o_orderkey", "side", F.col("s_name").alias("name"))
    return assemble_documents(master, legals, parties, "o_orderkey", ("F", "P"), "o_orderstatus").drop("o_orderstatus")


@query("""SELECT o_orderkey, c_name, s_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, min(s_name) AS s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity = 50 GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_totalprice > 250000 AND (c_name LIKE '%7' OR c_mktsegment LIKE 'BUILD%')""")
def signal_documents(t: Tables) -> DataFrame:
    party = t.lineitem.filter("l_quantity = 50").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("s_name").alias("s_name"))
    docs = t.orders.filter("o_totalprice > 250000").join(t.customer.filter("c_name like '%7' or c_mktsegment like 'BUILD%'"), F.col("o_custkey") == F.col("c_custkey"))
    return docs.join(party, "o_orderkey", "left").select("o_orderkey", "c_name", "s_name")


@query("""WITH r AS (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') AS complaints, count(*) FILTER (WHERE l_discount > 0.08) AS noise FROM lineitem GROUP BY 1)
SELECT p_partkey, p_retailprice, p_size, coalesce(complaints, 0) AS complaints, round(coalesce(complaints, 0) / p_size, 1) AS per_unit, coalesce(noise, 0) AS noise FROM part LEFT JOIN r ON l_partkey = p_partkey
WHERE p_size >= 6 AND p_retailprice >= 900 AND coalesce(complaints, 0) / p_size < 5 ORDER BY p_retailprice DESC, per_unit, p_partkey LIMIT 40""")
def hidden_gems(t: Tables) -> DataFrame:
    r = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("complaints"), F.count_if(F.col("l_discount") > 0.08).alias("noise"))
    g = joins.left_default(t.part.filter("p_size >= 6 and p_retailprice >= 900"), r, "p_partkey", {"complaints": 0, "noise": 0}).filter(F.col("complaints") / F.col("p_size") < 5)
    g = g.withColumn("per_unit", F.round(F.col("complaints") / F.col("p_size"), 1))
    return ranking.top(g, [F.desc("p_retailprice"), F.asc("per_unit"), F.asc("p_partkey")], 40).select("p_partkey", "p_retailprice", "p_size", "complaints", "per_unit", "noise")


def dossier(t: Tables, keys: DataFrame, n: int) -> DataFrame:
    """Long form of the newest n records of every table of the asked customers: key, kind, record, day."""
    o = joins.semi(t.orders, keys.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    e = joins.semi(t.events, keys.select(F.col("c_custkey").alias("user_id")), "user_id")
    rows = o.select(F.col("o_custkey").alias("key"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("record"), F.col("o_orderdate").cast("date").alias("day"))
    rows = rows.union(e.select("user_id", "event_type", "event_id", F.col("ts").cast("date")))
    return windows.first_n(rows, ["key", "kind"], [F.desc("day"), F.col("record")], n)


@query("""WITH k AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), r AS (SELECT o_custkey AS key, 'order' AS kind, o_orderkey AS record, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_custkey IN (SELECT c_custkey FROM k)
 UNION ALL SELECT user_id, event_type, event_id, CAST(ts AS DATE) FROM events WHERE user_id IN (SELECT c_custkey FROM k))
SELECT key, kind, record, day FROM (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY day DESC, record) AS rn FROM r) WHERE rn <= 3""")
def building_dossier(t: Tables) -> DataFrame:
    return dossier(t, t.customer.filter("c_nationkey = 3").select("c_custkey"), 3)


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name ILIKE '%customer#%11%' ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def address_search(t: Tables) -> DataFrame:
    return ranking.top(t.customer.filter(F.col("c_name").ilike("%customer#%11%")), [F.desc("c_acctbal"), F.col("c_custkey")], 10).select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')) || '-new_york' AS slug FROM part WHERE p_size BETWEEN 20 AND 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') ORDER BY p_size DESC, p_partkey LIMIT 25""")
def target_buildings(t: Tables) -> DataFrame:
    from lotlens.functions.address import address_to_slug

    found = t.part.filter(F.col("p_size").between(20, 30) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"))
    return ranking.top(found, [F.desc("p_size"), F.col("p_partkey")], 25).select("p_partkey", address_to_slug(F.col("p_name")).alias("slug"))


def watchlist_alerts(watch: DataFrame, events: DataFrame, key: str, alerted: DataFrame, since: str, n: int = 3) -> DataFrame:
    """key, kind, event_id of the newest n recent events per watched key and kind that no earlier alert had."""
    recent = joins.semi(events.filter(F.col("day") >= F.lit(since).cast("date")), watch, key)
    return new_only(windows.first_n(recent, [key, "kind"], [F.desc("day"), F.desc("event_id")], n), alerted, [key, "kind", "event_id"])


@query("""WITH r AS (SELECT user_id, event_type AS kind, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) DESC, event_id DESC) AS k FROM events
 WHERE CAST(ts AS DATE) >= DATE '2024-01-24' AND event_type IN ('error', 'signup') AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT user_id, kind, event_id FROM r WHERE k <= 3 AND event_id % 5 <> 0""")
def alerts(t: Tables) -> DataFrame:
    e = t.events.filter(F.col("event_type").isin("error", "signup")).select("user_id", F.col("event_type").alias("kind"), "event_id", F.col("ts").cast("date").alias("day"))
    watch = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return watchlist_alerts(watch, e, "user_id", e.filter("event_id % 5 = 0"), "2024-01-24").select("user_id", "kind", "event_id")


@query("""SELECT event_id, user_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'error' AND event_id % 2 = 1 ORDER BY ts DESC, event_id LIMIT 30""")
def alert_feed(t: Tables) -> DataFrame:
    unread = t.events.filter("event_type = 'error' and event_id % 2 = 1").join(t.customer, F.col("user_id") == F.col("c_custkey"))
    return ranking.top(unread, [F.desc("ts"), F.col("event_id")], 30).select("event_id", "user_id", "c_name")


@query("""SELECT o_orderkey, c_name, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def price_history_export(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", "c_name", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")


@query("""WITH n AS (SELECT o_custkey, count(*) AS owned, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1) SELECT o_custkey, owned, value, CAST(ntile(5) OVER (ORDER BY value DESC, o_custkey) AS INTEGER) AS grade FROM n""")
def owner_portfolio(t: Tables) -> DataFrame:
    """Owners graded in exact fifths by what they hold."""
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("owned"), F.round(F.sum("o_totalprice"), 2).alias("value"))
    return windows.global_tiles(n, "value", "o_custkey", 5, "grade")


@query("""SELECT o_custkey, o_orderkey, CAST(d - prev AS INTEGER) AS days FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE d - prev <= 60""")
def flips(t: Tables) -> DataFrame:
    """Sales within 60 days of the one before."""
    o = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderdate")
    prev = F.lag("d").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.withColumn("days", F.date_diff("d", prev)).filter("days <= 60").select("o_custkey", "o_orderkey", "days")


@query("""SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS density FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def complaint_density(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6))


@query("""WITH m AS (SELECT p_brand, quantile_disc(p_retailprice, 0.5) AS median FROM part GROUP BY 1) SELECT p_partkey, median, round(p_retailprice / median, 6) AS ratio FROM part JOIN m USING (p_brand)""")
def area_median(t: Tables) -> DataFrame:
    m = t.part.groupBy("p_brand").agg(F.percentile_approx("p_retailprice", 0.5, 1_000_000).alias("median"))
    return t.part.join(m, "p_brand").select("p_partkey", "median", F.round(F.col("p_retailprice") / F.col("median"), 6).alias("ratio"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' AND o_orderstatus = 'O') WHERE k <= 2""")
def building_listings(t: Tables) -> DataFrame:
    """The dearest open listings of each asked building."""
    keys = t.customer.filter("c_mktsegment = 'AUTOMOBILE'").select(F.col("c_custkey").alias("o_custkey"))
    found = joins.semi(t.orders.filter("o_orderstatus = 'O'"), keys, "o_custkey")
    return windows.first_n(found.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), ["c_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2)


@query("""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT item_id, lower(text) AS q FROM benchmark) SELECT doc_id, item_id FROM d JOIN p ON contains(t, q)""")
def phrase_matches(t: Tables) -> DataFrame:
    """Documents that contain a phrase as it is; the phrases are measured before they are broadcast."""
    phrases = t.benchmark.select("item_id", F.col("text").alias("phrase"))
    return joins.phrase_join(t.documents.select("doc_id", "text"), "text", phrases, "phrase").select("doc_id", "item_id")


@query("""SELECT p_partkey, CASE WHEN p_retailprice <= e[1] THEN 0 WHEN p_retailprice <= e[2] THEN 1 WHEN p_retailprice <= e[3] THEN 2 ELSE 3 END AS part FROM part, (SELECT quantile_disc(p_retailprice, [0.25, 0.5, 0.75]) AS e FROM part)""")
def split_over_full(t: Tables) -> DataFrame:
    """A price range cut at its quartiles, as an over-full bucket is."""
    edges = t.part.agg(F.percentile_approx("p_retailprice", [0.25, 0.5, 0.75], 1_000_000).alias("e"))
    return t.part.crossJoin(F.broadcast(edges)).select("p_partkey", F.size(F.filter("e", lambda x: x < F.col("p_retailprice"))).alias("part"))


def change_trend(permits: DataFrame, purchases: DataFrame, stabilized: DataFrame, area: str, year: str) -> DataFrame:
    """area, year, permits, purchases, stabilized, lost and pressure of every area and year that any of the three has.

    lost: stabilised units less than in the area's last year with any figure, 0 if there are more. pressure: the sum of
    permits, purchases and lost. The three are tagged and counted in one aggregation.
    """
    tagged = [df.select(area, year, F.lit(k).alias("_k")) for k, df in enumerate((permits, purchases, stabilized))]
    of = lambda k: F.count_if(F.col("_k") == k)
    n = tagged[0].union(tagged[1]).union(tagged[2]).groupBy(area, year).agg(of(0).alias("permits"), of(1).alias("purchases"), of(2).alias("stabilized"))
    before = F.lag("stabilized").over(Window.partitionBy(area).orderBy(year))
    lost = n.withColumn("lost", F.greatest(F.lit(0), F.coalesce(before - F.col("stabilized"), F.lit(0))))
    return lost.withColumn("pressure", F.col("permits") + F.col("purchases") + F.col("lost"))


@query("""WITH o AS (SELECT c_mktsegment AS area, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS s, o_orderpriority AS p FROM orders JOIN customer ON c_custkey = o_custkey),
 n AS (SELECT area, year, count(*) FILTER (WHERE s = 'O') AS permits, count(*) FILTER (WHERE p = '1-URGENT') AS purchases, count(*) FILTER (WHERE s = 'F') AS stabilized FROM o WHERE s IN ('O', 'F') OR p = '1-URGENT' GROUP BY 1, 2),
 l AS (SELECT *, greatest(0, coalesce(lag(stabilized) OVER (PARTITION BY area ORDER BY year) - stabilized, 0)) AS lost FROM n)
SELECT area, year, permits, purchases, stabilized, lost, permits + purchases + lost AS pressure FROM l""")
def area_trend(t: Tables) -> DataFrame:
    """Permits, corporate purchases and the loss of stabilised units of each area, year by year."""
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("area"), F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority")
    return change_trend(o.filter("o_orderstatus = 'O'"), o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderstatus = 'F'"), "area", "year")
