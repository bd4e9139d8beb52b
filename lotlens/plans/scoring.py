"""Building scores: quality, availability and ranked lists.

Stand-ins: a building is a part, its units and floors come from its size, its events from its order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions import scores
from lotlens.operators import joins
from lotlens.operators.ranking import top
from lotlens.operators.windows import first_n
from lotlens.plans.registry import Tables, query


def score_buildings(board: DataFrame, *keep: str) -> DataFrame:
    """key, quality, availability, signal_count, convergence, turnover and the signals of a board of one row per key.

    The board has: key, area, units, year, floors, stabilized, complaints, recent, noise, permits, permit_cost,
    alteration, cases, tenant_action, distress, evictions, unpaid, agreements, satisfactions, owner_changed, traded.
    `keep` names columns of the board that stay.
    """
    c = F.col
    signals = scores.availability_signals(*[c(x) for x in ("permits", "permit_cost", "alteration", "cases", "tenant_action", "distress", "units", "evictions", "unpaid", "agreements", "satisfactions", "owner_changed")])
    facts = {"area": c("area"), "units": c("units"), "complaints": c("complaints"), "recent": c("recent"), "noise": c("noise"), "year": c("year"), "floors": c("floors"), "stabilized": c("stabilized")}
    out = board.withColumn("signals", signals)
    out = out.select("key", scores.quality_score(**facts).alias("quality"), scores.availability_score(c("signals")).alias("availability"), F.size("signals").alias("signal_count"), scores.convergence(F.size("signals")).alias("convergence"), scores.turnover_percent(F.coalesce(c("traded"), F.lit(0)), c("units")).alias("turnover"), "signals", scores.quality_reasons(**facts).alias("reasons"), *keep)
    return out.withColumn("combined", c("quality") + c("availability"))


#: Lines that one task aggregates, pairs of which it takes the distinct ones, and tasks up to which Spark writes a shuffle
#: without holding its rows (the default of `spark.shuffle.sort.bypassMergeThreshold`).
LINES, PAIRS, UNHELD = 2_000_000, 1_000_000, 200


def part_board(t: Tables) -> DataFrame:
    """The aggregates of a building come from one pass over its lines and two for distinct counts, instead of eleven.

    A split may name about as many buildings as it has lines, so lines are dealt by building before they are hashed, as marks
    and the few prices that count. Beyond `UNHELD` tasks a split's rows are held to be dealt: lines, which are folded as
    they come, are dealt to no more; pairs are once a task would take twice its number.
    """
    day, price, permit, fined = F.col("l_shipdate").cast("date"), F.col("l_extendedprice"), F.col("l_discount") > 0.08, F.col("l_tax") >= 0.08
    total, least = Tables(t.spark, t.sf_dir).lineitem.count(), t.spark.sparkContext.defaultParallelism
    n_lines, n_pairs = min(-(-total // LINES), UNHELD), -(-total // PAIRS)
    if n_pairs <= 2 * UNHELD:
        n_pairs = min(n_pairs, UNHELD)
    marks = t.lineitem.select(
        F.col("l_partkey").alias("key"), (F.col("l_returnflag") == "R").alias("complaint"), ((F.col("l_returnflag") == "R") & (day >= F.lit("2000-01-01").cast("date"))).alias("recent"),
        (F.col("l_linestatus") == "F").alias("noise"), permit.alias("permit"), F.when(permit, price).alias("cost"), (permit & (F.col("l_tax") > 0.06)).alias("alteration"),
        (F.col("l_quantity") == 49).alias("case"), ((F.col("l_quantity") == 49) & (F.col("l_returnflag") == "A")).alias("tenant"), (F.col("l_quantity") < 10).alias("distress"),
        (F.col("l_quantity") == 50).alias("eviction"), F.when(fined, price).otherwise(0.0).alias("fine"), (F.col("l_quantity") == 1).alias("agreement"), (F.col("l_quantity") == 2).alias("satisfaction"),
    )
    lines = marks.repartition(max(least, n_lines), "key").groupBy("key").agg(
        F.count_if("complaint").alias("complaints"), F.count_if("recent").alias("recent"), F.count_if("noise").alias("noise"), F.count_if("permit").alias("permits"), F.max("cost").alias("permit_cost"),
        F.bool_or("alteration").alias("alteration"), F.count_if("case").alias("cases"), F.bool_or("tenant").alias("tenant_action"), F.count_if("distress").alias("distress"),
        F.count_if("eviction").alias("evictions"), F.sum("fine").alias("unpaid"), F.count_if("agreement").alias("agreements"), F.count_if("satisfaction").alias("satisfactions"),
    )
    base = t.part.select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("area"), F.col("p_size").alias("units"), (1870 + F.col("p_size") * 3).alias("year"), (F.col("p_size") % 12).alias("floors"), (F.col("p_size") % 5 == 0).alias("stabilized"))
    # distinct counts beside the others would multiply every row; two narrow aggregations each don't. Pairs seldom repeat, so
    # they too are dealt before they are hashed
    n_distinct = lambda c: t.lineitem.select(F.col("l_partkey").alias("key"), c).repartition(max(least, n_pairs), "key", c).distinct().groupBy("key").agg(F.count(c).alias("_n"))
    owners = n_distinct("l_suppkey").select("key", (F.col("_n") >= 33).alias("owner_changed"))
    return joins.star(base, "key", lines, owners, n_distinct("l_orderkey").withColumnRenamed("_n", "traded"))


#: Buildings of an area whose keys are broadcast.
FEW = 100_000


def area_board(t: Tables, area: DataFrame) -> DataFrame:
    """The board of some buildings; the lines of few of them are picked before they are aggregated."""
    (lines,) = joins.narrowed(area.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", FEW, t.lineitem)

    class Area(Tables):
        part, lineitem = area, lines

    return part_board(Area(t.spark, t.sf_dir))


_BOARD = """WITH l AS (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') AS complaints, count(*) FILTER (WHERE l_returnflag = 'R' AND CAST(l_shipdate AS DATE) >= DATE '2000-01-01') AS recent, count(*) FILTER (WHERE l_linestatus = 'F') AS noise,
  count(*) FILTER (WHERE l_discount > 0.08) AS permits, coalesce(max(l_extendedprice) FILTER (WHERE l_discount > 0.08), 0) AS cost, bool_or(l_discount > 0.08 AND l_tax > 0.06) AS alteration, count(*) FILTER (WHERE l_quantity = 49) AS cases,
  bool_or(l_quantity = 49 AND l_returnflag = 'A') AS tenant, count(*) FILTER (WHERE l_quantity < 10) AS distress, count(*) FILTER (WHERE l_quantity = 50) AS evictions, count(*) FILTER (WHERE l_tax >= 0.08) AS unpaid,
  count(*) FILTER (WHERE l_quantity = 1) AS agreements, count(*) FILTER (WHERE l_quantity = 2) AS satisfactions, count(DISTINCT l_suppkey) >= 33 AS changed, count(DISTINCT l_orderkey) AS traded FROM lineitem GROUP BY 1),
 b AS (SELECT p_partkey AS key, p_retailprice AS area, p_size AS units, 1870 + p_size * 3 AS year, p_size % 12 AS floors, p_size % 5 = 0 AS stable, l.*, coalesce(complaints, 0) / p_size AS cr, coalesce(recent, 0) / p_size AS rr, coalesce(noise, 0) / p_size AS nr
   FROM part LEFT JOIN l ON l_partkey = p_partkey),
 s AS (SELECT *, CAST(least(100, CASE WHEN area >= 2000 THEN 25 WHEN area >= 1500 THEN 22 WHEN area >= 1200 THEN 18 WHEN area >= 1000 THEN 15 WHEN area >= 800 THEN 10 WHEN area >= 600 THEN 5 ELSE 0 END
   + CASE WHEN cr = 0 THEN 25 WHEN cr < 1 THEN 22 WHEN cr < 3 THEN 18 WHEN cr < 5 THEN 12 WHEN cr < 10 THEN 5 ELSE 0 END + CASE WHEN rr = 0 THEN 5 ELSE 0 END + CASE WHEN nr = 0 THEN 15 WHEN nr < 0.5 THEN 10 WHEN nr < 1 THEN 5 ELSE 0 END
   + CASE WHEN year BETWEEN 1880 AND 1945 THEN 8 WHEN year >= 2015 THEN 6 ELSE 0 END + CASE WHEN units BETWEEN 6 AND 30 THEN 4 ELSE 0 END + CASE WHEN floors >= 6 THEN 3 ELSE 0 END
   + CASE WHEN stable THEN 10 + CASE WHEN area >= 1000 THEN 5 ELSE 0 END ELSE 0 END) AS INTEGER) AS quality,
   list_filter([CASE WHEN permits > 0 THEN CASE WHEN cost >= 200000 THEN 17.7 WHEN cost >= 50000 THEN 10.2 WHEN cost > 0 AND cost < 10000 THEN 10.5 WHEN alteration THEN 16.4 ELSE 8.0 END END,
    CASE WHEN cases > 0 THEN CASE WHEN tenant THEN 8.3 ELSE 6.4 END END, CASE WHEN distress >= 5 AND distress / units >= 0.1 THEN 7.9 WHEN distress >= 3 AND distress / units >= 0.05 THEN 7.6 END,
    CASE WHEN evictions > 0 THEN 6.3 END, CASE WHEN unpaid > 0 THEN 5.0 END, CASE WHEN agreements > 0 THEN 4.1 END, CASE WHEN satisfactions > 0 THEN 3.0 END, CASE WHEN changed THEN 3.3 END]::DOUBLE[], lambda x: x IS NOT NULL) AS w FROM b),
 x AS (SELECT key, quality, CAST(least(100, round_even(coalesce(list_sum(list_reverse_sort(w)[1:3]), 0.0) * CASE WHEN len(w) >= 3 THEN 1.5 WHEN len(w) = 2 THEN 1.2 ELSE 1.0 END / 50 * 100, 0)) AS INTEGER) AS availability, CAST(len(w) AS INTEGER) AS signal_count,
   CASE WHEN len(w) >= 3 THEN 'strong' WHEN len(w) = 2 THEN 'moderate' WHEN len(w) = 1 THEN 'single' ELSE 'none' END AS convergence, coalesce(round_even(100.0 * coalesce(traded, 0) / units, 1), 0.0) AS turnover, year, stable FROM s) """


@query(_BOARD + "SELECT key, quality, availability, signal_count, convergence, turnover, quality + availability AS combined FROM x")
def building_scores(t: Tables) -> DataFrame:
    return score_buildings(part_board(t)).drop("signals", "reasons")


@query(_BOARD + "SELECT key, quality, availability, quality + availability AS combined FROM x ORDER BY combined DESC, key LIMIT 50")
def top_buildings(t: Tables) -> DataFrame:
    return top(score_buildings(part_board(t)), [F.desc("combined"), F.col("key")], 50).select("key", "quality", "availability", "combined")


@query(_BOARD + "SELECT key, quality, signal_count FROM x WHERE quality >= 60 AND signal_count >= 2 ORDER BY quality + availability DESC, key LIMIT 30")
def diamonds(t: Tables) -> DataFrame:
    return top(score_buildings(part_board(t)).filter("quality >= 60 and signal_count >= 2"), [F.desc("combined"), F.col("key")], 30).select("key", "quality", "signal_count")


@query(_BOARD + "SELECT key, availability FROM x WHERE signal_count >= 3 ORDER BY availability DESC, key LIMIT 30")
def hottest(t: Tables) -> DataFrame:
    return top(score_buildings(part_board(t)).filter("signal_count >= 3"), [F.desc("availability"), F.col("key")], 30).select("key", "availability")


@query(_BOARD + """SELECT * FROM (SELECT 'quality' AS list, key, quality FROM x ORDER BY quality DESC, key LIMIT 20) UNION ALL SELECT * FROM (SELECT 'prewar', key, quality FROM x WHERE year BETWEEN 1880 AND 1945 ORDER BY quality DESC, key LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'stabilized', key, quality FROM x WHERE stable ORDER BY quality DESC, key LIMIT 20)""")
def named_rankings(t: Tables) -> DataFrame:
    """The board is evaluated once: each building goes to the lists it belongs to, and each list is cut in every task."""
    lists = F.array_compact(F.array(F.lit("quality"), F.when(F.col("year").between(1880, 1945), "prewar"), F.when(F.col("stabilized"), "stabilized")))
    scored = score_buildings(part_board(t), "year", "stabilized").select("key", "quality", F.explode(lists).alias("list"))
    return first_n(scored, ["list"], [F.desc("quality"), F.col("key")], 20).select("list", "key", "quality")


@query(_BOARD + "SELECT count(*) AS buildings, count(*) FILTER (WHERE quality >= 60) AS good, count(*) FILTER (WHERE signal_count >= 3) AS strong, count(*) FILTER (WHERE signal_count = 0) AS quiet FROM x")
def score_summary(t: Tables) -> DataFrame:
    s = score_buildings(part_board(t))
    return s.agg(F.count("*").alias("buildings"), F.count_if(F.col("quality") >= 60).alias("good"), F.count_if(F.col("signal_count") >= 3).alias("strong"), F.count_if(F.col("signal_count") == 0).alias("quiet"))


@query(_BOARD + "SELECT key, quality, availability FROM x JOIN part ON p_partkey = key WHERE p_brand IN ('Brand#11', 'Brand#22')")
def score_area(t: Tables) -> DataFrame:
    """Scores of one area only."""
    return score_buildings(area_board(t, t.part.filter(F.col("p_brand").isin("Brand#11", "Brand#22")))).select("key", "quality", "availability")
