"""Filters, joins, aggregates, windows, rankings and set operations on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions import clean
from lotlens.operators import aggregates as agg
from lotlens.operators import joins, ranking, windows
from lotlens.plans.registry import Tables, query

day = lambda c: F.col(c).cast("date")


@query("SELECT c_custkey AS customer, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def rename_project(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


@query("SELECT p_partkey, CASE WHEN p_size <> 0 AND p_retailprice <> 0 THEN round_even(p_retailprice / p_size, 0) ELSE 0.0 END AS per_size FROM part")
def per_unit_ratio(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", clean.per_unit(F.col("p_retailprice"), F.col("p_size")).alias("per_size"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE lower(o_orderstatus) END AS label,
  CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS strict_label FROM orders""")
def map_codes(t: Tables) -> DataFrame:
    labels = {"F": "filled", "O": "open"}
    c = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", clean.map_values(c, labels, "lower").alias("label"), clean.map_values(c, labels, "null").alias("strict_label"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000 AND s_nationkey IN (1, 3, 5, 7, 9, 11)")
def filter_between_in_list(t: Tables) -> DataFrame:
    return ranking.search(t.supplier.filter(F.col("s_acctbal").between(0, 5000)), within={"s_nationkey": (1, 3, 5, 7, 9, 11)}).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT count(*) AS n, CAST(sum(l) AS BIGINT) AS chars FROM (SELECT length(text) AS l FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%token%' OR text ILIKE '%trash%')")
def any_ilike(t: Tables) -> DataFrame:
    return t.documents.filter(clean.any_ilike(F.col("text"), ("license", "token", "trash"))).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 6")
def since_cutoff(t: Tables) -> DataFrame:
    return t.events.filter(clean.since(day("ts"), F.lit("2024-01-30").cast("date"), months=2, month_days=3)).select("event_id", "event_type")


@query("""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders),
  m AS (SELECT CASE WHEN max(d) < DATE '2030-01-01' THEN DATE '2000-01-01' ELSE DATE '2030-01-01' END AS since FROM o)
SELECT o_orderkey, d FROM o, m WHERE d >= since""")
def adaptive_cutoff(t: Tables) -> DataFrame:
    return agg.adaptive_since(t.orders.withColumn("d", day("o_orderdate")), "d", "2030-01-01", "2000-01-01").select("o_orderkey", "d")


@query("SELECT p_partkey, p_type FROM part WHERE upper(trim(p_type)) NOT IN ('ECONOMY', 'PROMO') AND length(trim(p_type)) BETWEEN 1 AND 8")
def drop_junk(t: Tables) -> DataFrame:
    return t.part.filter(clean.is_unit(F.col("p_type"), ("ECONOMY", "PROMO"), 8)).select("p_partkey", "p_type")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_inner(t: Tables) -> DataFrame:
    return t.orders.filter("o_totalprice > 200000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_bridge(t: Tables) -> DataFrame:
    lookup = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return joins.bridge(t.supplier, lookup, "s_nationkey", "n_regionkey").select("s_suppkey", "n_regionkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_semi(t: Tables) -> DataFrame:
    return joins.semi(t.customer, t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(t: Tables) -> DataFrame:
    return joins.anti(t.customer, t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def join_left_default(t: Tables) -> DataFrame:
    n = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return joins.left_default(t.customer, n, "c_custkey", {"n": 0}).select("c_custkey", "n")


@query("""SELECT c_custkey, n_name, coalesce(r_name, 'none') AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""")
def join_left_constant(t: Tables) -> DataFrame:
    n = t.nation.join(t.region.filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("""SELECT DISTINCT e.event_id, c.c_custkey FROM events e JOIN customer c ON e.user_id = c.c_custkey OR e.user_id = c.c_nationkey WHERE e.event_type = 'error'""")
def join_or_match(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", F.col("c_custkey").alias("k1"), F.col("c_nationkey").cast("long").alias("k2"))
    return joins.or_match(t.events.filter("event_type = 'error'"), c, [("user_id", "k1"), ("user_id", "k2")], "event_id", "c_custkey")


@query("""WITH keyed AS (SELECT o_orderkey, o_custkey % 40 AS k1, o_custkey % 3000 AS k2 FROM orders),
  a AS (SELECT s_suppkey AS k1, min(s_nationkey) AS target FROM supplier WHERE s_suppkey < 20 GROUP BY 1),
  b AS (SELECT c_custkey AS k2, min(c_nationkey) AS target FROM customer GROUP BY 1)
SELECT o_orderkey, coalesce(a.target, b.target) AS target, CASE WHEN a.target IS NOT NULL THEN 'first' WHEN b.target IS NOT NULL THEN 'second' ELSE 'none' END AS method
FROM keyed LEFT JOIN a USING (k1) LEFT JOIN b USING (k2)""")
def join_resolve_tiers(t: Tables) -> DataFrame:
    keyed = t.orders.select("o_orderkey", (F.col("o_custkey") % 40).alias("k1"), (F.col("o_custkey") % 3000).alias("k2"))
    a = t.supplier.filter("s_suppkey < 20").select(F.col("s_suppkey").alias("k1"), F.col("s_nationkey").alias("target"))
    b = t.customer.select(F.col("c_custkey").alias("k2"), F.col("c_nationkey").alias("target"))
    return joins.resolve_tiers(keyed, [("first", ["k1"], a), ("second", ["k2"], b)], "target").select("o_orderkey", "target", "method")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, u.n AS number FROM (SELECT c_custkey, greatest(0, 12 - coalesce(o.n, 0)) AS gap FROM customer LEFT JOIN o ON o_custkey = c_custkey) g, unnest(range(1, g.gap + 1)) AS u(n)""")
def expand_gap(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    gap = joins.left_default(t.customer, n, "c_custkey", {"n": 0})
    return joins.expand_gap(gap, 12 - F.col("n"), "number").select("c_custkey", F.col("number").cast("long").alias("number"))


@query("""SELECT o_orderkey, c_name, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS lines,
  (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS first_ship
FROM orders o LEFT JOIN customer ON c_custkey = o_custkey""")
def scalar_subqueries(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.min(day("l_shipdate")).alias("first_ship"))
    out = joins.left_default(t.orders, lines, "o_orderkey", {"lines": 0})
    return out.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name", "lines", "first_ship")


@query("""WITH d AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'))) AS word FROM documents)
SELECT doc_id, r_regionkey FROM d JOIN (SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'idiot' WHEN 1 THEN 'trash' WHEN 2 THEN 'license' WHEN 3 THEN 'gnu' ELSE 'token' END AS word FROM region) USING (word)""")
def contains_join(t: Tables) -> DataFrame:
    words = F.element_at(F.array(*[F.lit(w) for w in ("idiot", "trash", "license", "gnu", "token")]), F.col("r_regionkey") + 1)
    return joins.contains_join(t.documents, "text", t.region.select("r_regionkey", words.alias("word")), "word").select("doc_id", "r_regionkey")


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '1999-01-01') AS recent FROM orders GROUP BY 1")
def count_by_and_since(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(day("o_orderdate") >= F.lit("1999-01-01").cast("date")).alias("recent"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount >= 0.05) AS discounted, round(100.0 * count(*) FILTER (WHERE l_discount >= 0.05) / count(*), 4) AS pct FROM lineitem GROUP BY 1")
def conditional_share(t: Tables) -> DataFrame:
    hit = F.count_if(F.col("l_discount") >= 0.05)
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), hit.alias("discounted"), agg.share(hit, F.count("*")).alias("pct"))


@query("SELECT user_id, event_type, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1, 2")
def first_event(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min(day("ts")).alias("first_day"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 5")
def having_at_least(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 5")


@query("SELECT l_suppkey, max(l_quantity) AS most, bool_or(l_returnflag = 'R') AS any_returned, max(l_extendedprice) AS dearest FROM lineitem GROUP BY 1")
def multi_max(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.max("l_quantity").alias("most"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.max("l_extendedprice").alias("dearest"))


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent,
  max(CAST(o_orderdate AS DATE)) AS last_day, arg_max(o_totalprice, o_orderdate + to_microseconds(o_orderkey)) AS last_price, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1""")
def document_profile(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"),
        F.max(day("o_orderdate")).alias("last_day"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_price"), F.count_distinct("o_orderpriority").alias("priorities"),
    )


@query("""WITH r AS (SELECT l_orderkey, s_name, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, s_name) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT l_orderkey, left(string_agg(s_name, '; ' ORDER BY l_linenumber, s_name), 200) AS parties FROM r WHERE k <= 3 GROUP BY 1""")
def top_k_concat(t: Tables) -> DataFrame:
    named = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return agg.first_k_text(named, ["l_orderkey"], "s_name", ["l_linenumber"], name="parties")


@query("""SELECT s_nationkey, string_agg(x, ', ' ORDER BY x) AS people FROM (SELECT DISTINCT s_nationkey, 'supplier: ' || s_name AS x FROM supplier) GROUP BY 1""")
def labelled_concat(t: Tables) -> DataFrame:
    return t.supplier.withColumn("role", F.lit("supplier")).groupBy("s_nationkey").agg(agg.labelled_text("role", "s_name").alias("people"))


@query("""SELECT event_type, round(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)), 2) AS total FROM events GROUP BY 1""")
def safe_sum(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(agg.safe_sum(F.get_json_object("props", "$.k")), 2).alias("total"))


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT (o_custkey, o_orderstatus)) AS pairs FROM orders")
def count_distinct(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_custkey", "o_orderstatus").alias("pairs"))


@query("SELECT o_custkey, count(DISTINCT upper(trim(o_orderpriority))) >= 2 AS changed FROM orders GROUP BY 1")
def changed_owner(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(agg.changed_value(F.col("o_orderpriority")).alias("changed"))


@query("""SELECT CASE WHEN p_size <= 5 THEN 'to 5' WHEN p_size <= 20 THEN 'to 20' WHEN p_size <= 40 THEN 'to 40' ELSE 'over' END AS bucket, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sum_p_size FROM part GROUP BY 1""")
def size_histogram(t: Tables) -> DataFrame:
    return agg.histogram(t.part, agg.bucket(F.col("p_size"), [(5, "to 5"), (20, "to 20"), (40, "to 40")], "over"), "p_size")


@query("""SELECT CASE WHEN c_custkey % 10000 <= 999 THEN 'plain' WHEN c_custkey % 10000 <= 6999 THEN 'condo' ELSE 'other' END AS bucket, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1""")
def lot_range_profile(t: Tables) -> DataFrame:
    return t.customer.groupBy(agg.bucket(F.col("c_custkey") % 10_000, [(999, "plain"), (6999, "condo")], "other").alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def by_year_and_status(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def top_categories(t: Tables) -> DataFrame:
    return agg.top_values(t.part, "p_brand", 10)


@query("SELECT round(100.0 * (SELECT count(DISTINCT o_custkey) FROM orders) / (SELECT count(*) FROM customer), 4) AS pct")
def coverage_ratio(t: Tables) -> DataFrame:
    found, total = t.orders.agg(F.count_distinct("o_custkey").alias("a")), t.customer.agg(F.count("*").alias("b"))
    return found.crossJoin(total).select(agg.share(F.col("a"), F.col("b")).alias("pct"))


@query("""SELECT 'orders' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'filled', CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'customers', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders""")
def metric_report(t: Tables) -> DataFrame:
    return agg.metric_report(t.orders, orders=F.count("*"), filled=F.count_if(F.col("o_orderstatus") == "F"), customers=F.count_distinct("o_custkey"))


@query("SELECT o_orderstatus, min(o_totalprice) AS least, round(avg(o_totalprice), 2) AS mean, max(o_totalprice) AS most FROM orders GROUP BY 1")
def price_summary(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("least"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.max("o_totalprice").alias("most"))


@query("""SELECT o_custkey, CASE WHEN o_totalprice <= 50000 THEN 'small' WHEN o_totalprice <= 150000 THEN 'middle' WHEN o_totalprice <= 300000 THEN 'large' ELSE 'huge' END AS cost, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY 1, 2""")
def first_event_by_bucket(t: Tables) -> DataFrame:
    cost = agg.bucket(F.col("o_totalprice"), [(50_000, "small"), (150_000, "middle"), (300_000, "large")], "huge")
    return t.orders.groupBy("o_custkey", cost.alias("cost")).agg(F.min(day("o_orderdate")).alias("first_day"))


@query("""SELECT CASE WHEN text ILIKE '%license%' THEN 'license' WHEN text ILIKE '%token%' THEN 'token' WHEN text LIKE '%@%' THEN 'mail' ELSE 'plain' END AS label, count(*) AS n FROM documents GROUP BY 1""")
def priority_labels(t: Tables) -> DataFrame:
    c = F.col("text")
    label = F.when(c.ilike("%license%"), "license").when(c.ilike("%token%"), "token").when(c.like("%@%"), "mail").otherwise("plain")
    return t.documents.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, count(l_suppkey) AS n_keyed, count(DISTINCT l_suppkey) AS n_keys, round(100.0 * count(l_suppkey) / count(*), 4) AS pct_keyed, min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date FROM lineitem")
def profile_source(t: Tables) -> DataFrame:
    return agg.profile(t.lineitem.withColumn("d", day("l_shipdate")), "l_suppkey", "d")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2")
def two_level_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN r < 0.5 THEN 100 WHEN r < 1 THEN 95 WHEN r < 2 THEN 80 WHEN r < 5 THEN 60 WHEN r < 10 THEN 40 ELSE 20 END AS health
FROM (SELECT c_custkey, coalesce(n, 0) / (1.0 + c_nationkey % 7) AS r FROM customer LEFT JOIN n ON o_custkey = c_custkey)""")
def health_score(t: Tables) -> DataFrame:
    from lotlens.functions.scores import banded

    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rate = F.coalesce("n", F.lit(0)) / (1.0 + F.col("c_nationkey") % 7)
    bands = ((0.5, 100), (1, 95), (2, 80), (5, 60), (10, 40))
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", banded(rate, bands, 20, under=True).alias("health"))


@query("SELECT * EXCLUDE (k) FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k = 1")
def best_per_group(t: Tables) -> DataFrame:
    return windows.best_per_group(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")])


@query("SELECT * EXCLUDE (k) FROM (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return windows.latest(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], F.col("ts"), "event_id").drop("ts")


@query("""SELECT o_custkey, o_orderkey, o_orderpriority, previous FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders) WHERE previous <> o_orderpriority""")
def value_changes(t: Tables) -> DataFrame:
    return windows.changes(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderpriority").drop("o_orderdate")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM orders)
SELECT o_custkey, o_orderkey FROM r JOIN customer ON c_custkey = o_custkey WHERE back > c_nationkey % 4""")
def drop_last_n(t: Tables) -> DataFrame:
    n = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 4).alias("drop_n"))
    return windows.drop_last_n(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.desc("o_orderkey")], n, "drop_n")


@query("""SELECT * EXCLUDE (part, k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, amount) AS k FROM (
  SELECT o_custkey AS id, o_totalprice AS amount, 0 AS part FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, o_totalprice, 1 FROM orders UNION ALL SELECT c_custkey, c_acctbal, 2 FROM customer)) WHERE k = 1""")
def first_across_feeds(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    feeds = [o.filter("o_orderstatus = 'P'").drop("o_orderstatus"), o.drop("o_orderstatus"), t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))]
    return windows.first_by_source(feeds, ["id"], ["amount"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def newest_per_building(t: Tables) -> DataFrame:
    return ranking.newest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey", 3).drop("o_orderdate")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 100 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 10")
def search_page(t: Tables) -> DataFrame:
    found = ranking.search(t.customer, equal={"c_mktsegment": "BUILDING", "c_nationkey": None}, at_least={"c_acctbal": 100})
    return ranking.page(found, "c_acctbal", ("c_acctbal", "c_name"), "c_custkey", limit=20, offset=10).select("c_custkey", "c_acctbal")


@query("SELECT count(*) AS total FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 100")
def search_total(t: Tables) -> DataFrame:
    return ranking.search(t.customer, equal={"c_mktsegment": "BUILDING"}, at_least={"c_acctbal": 100}).agg(F.count("*").alias("total"))


@query("SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_size, p_partkey LIMIT 50")
def top_multi_key(t: Tables) -> DataFrame:
    return ranking.top(t.part.select("p_partkey", "p_retailprice", "p_size"), [F.desc("p_retailprice"), F.asc("p_size"), F.asc("p_partkey")], 50)


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 50 ORDER BY n DESC, l_suppkey LIMIT 8")
def largest_groups(t: Tables) -> DataFrame:
    return ranking.largest_groups(t.lineitem, "l_suppkey", 8, 50)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS place FROM customer UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier")
def union_all(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("place")), allowMissingColumns=True)


@query("SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def intersect_keys(t: Tables) -> DataFrame:
    users = lambda kind: t.events.filter(F.col("event_type") == kind).select("user_id")
    return users("signup").intersect(users("error"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_keys(t: Tables) -> DataFrame:
    keys = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return joins.anti(keys("F"), keys("P"), "k").distinct()


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_rows(t: Tables) -> DataFrame:
    return t.documents.select("lang", "source").distinct()
