"""Signal validation: how often an outcome follows a signal within a window, against a baseline.

Stand-ins: the key is an event's user, a signal is one event type, the outcome another; windows are days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.operators import aggregates as agg
from lotlens.operators import joins
from lotlens.plans.registry import Tables, query

SIGNALS = ("click", "error", "signup", "view")
DAYS = (1, 3, 7)
START = "2024-01-10"


def _dated(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type", F.col("ts").cast("date").alias("d"))


def baseline(keys: DataFrame, outcomes: DataFrame, key: str, date: str, start: str, days: tuple[int, ...]) -> DataFrame:
    """One row: the share of all keys with an outcome in the half-open window of each length from a start."""
    first = F.lit(start).cast("date")
    per_key = outcomes.groupBy(key).agg(*[F.bool_or((F.col(date) >= first) & (F.col(date) < F.date_add(first, d))).alias(f"w{d}") for d in days])
    hit = keys.join(per_key, key, "left")
    return hit.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(f"w{d}", F.lit(False))).alias(f"hits_{d}") for d in days])


def lift_table(first_dates: DataFrame, outcomes: DataFrame, base: DataFrame, key: str, signal: str, days: tuple[int, ...]) -> DataFrame:
    """signal, days, hits, total, rate, baseline, lift for each signal and window."""
    flagged = joins.event_within(first_dates, outcomes, key, "first_day", "d", days)
    hits = flagged.groupBy(signal).agg(F.count("*").alias("total"), *[F.count_if(f"within_{d}").alias(f"h{d}") for d in days])
    long = hits.select(signal, "total", F.explode(F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"h{d}").alias("hits")) for d in days])).alias("w")).select(signal, "w.days", "w.hits", "total")
    rates = base.select(F.explode(F.array(*[F.struct(F.lit(d).alias("days"), (F.col(f"hits_{d}") / F.col("total")).alias("base")) for d in days])).alias("b")).select("b.*")
    out = long.join(F.broadcast(rates), "days")  # a row for each window
    rate = F.col("hits") / F.col("total")
    return out.select(signal, "days", "hits", "total", F.round(rate, 6).alias("rate"), F.round("base", 6).alias("baseline"), agg.lift(rate, F.col("base")).alias("lift"))


@query(f"""WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d FROM events), o AS (SELECT DISTINCT user_id, d FROM e WHERE event_type = 'purchase'),
  f AS (SELECT user_id, event_type, min(d) AS d0 FROM e WHERE event_type <> 'purchase' AND d >= DATE '{START}' GROUP BY 1, 2), w(days) AS (VALUES (1), (3), (7)),
  h AS (SELECT f.event_type, w.days, count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM o WHERE o.user_id = f.user_id AND o.d BETWEEN f.d0 AND f.d0 + w.days)) AS hits FROM f, w GROUP BY 1, 2),
  b AS (SELECT w.days, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM o WHERE o.user_id = u.user_id AND o.d >= DATE '{START}' AND o.d < DATE '{START}' + w.days)) / count(*) AS base FROM (SELECT DISTINCT user_id FROM e) u, w GROUP BY 1)
SELECT event_type, CAST(h.days AS INTEGER) AS days, hits, total, round(hits / total, 6) AS rate, round(base, 6) AS baseline, CASE WHEN base > 0 THEN round(hits / total / base, 4) END AS lift FROM h JOIN b USING (days)""")
def signal_lift(t: Tables) -> DataFrame:
    """First signal per user and type, then a purchase within 1, 3 and 7 days, against the baseline of all users."""
    e = _dated(t)
    outcomes = e.filter("event_type = 'purchase'")
    first = e.filter(f"event_type <> 'purchase' and d >= '{START}'").groupBy("user_id", "event_type").agg(F.min("d").alias("first_day"))
    return lift_table(first, outcomes, baseline(e.select("user_id").distinct(), outcomes, "user_id", "d", START, DAYS), "user_id", "event_type", DAYS)


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS d FROM events)
SELECT s.event_id, EXISTS (SELECT 1 FROM e o WHERE o.event_type = 'purchase' AND o.user_id = s.user_id AND o.d BETWEEN s.d AND s.d + 1) AS within_1,
  EXISTS (SELECT 1 FROM e o WHERE o.event_type = 'purchase' AND o.user_id = s.user_id AND o.d BETWEEN s.d AND s.d + 3) AS within_3 FROM e s WHERE s.event_type = 'error'""")
def event_within(t: Tables) -> DataFrame:
    e = t.events.withColumn("d", F.col("ts").cast("date"))
    outcomes = e.filter("event_type = 'purchase'").select("user_id", F.col("d").alias("o"))
    return joins.event_within(e.filter("event_type = 'error'"), outcomes, "user_id", "d", "o", (1, 3)).select("event_id", "within_1", "within_3")


def _matrix(t: Tables) -> DataFrame:
    """Users with a flag for each event type that they have three times or more in one day: one scan, two partial aggregates."""
    per_day = t.events.groupBy("user_id", "event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 480)).alias("hit"))
    flags = [F.bool_or((F.col("event_type") == s) & (F.col("n") >= 3)).alias(s) for s in SIGNALS]
    out = per_day.groupBy("user_id").agg(*flags, F.coalesce(F.bool_or("hit"), F.lit(False)).alias("outcome"))
    return out.withColumn("n_signals", sum((F.col(s).cast("int") for s in SIGNALS), F.lit(0))).select("user_id", *SIGNALS, "n_signals", "outcome")


_MATRIX = """WITH busy AS (SELECT DISTINCT user_id, event_type FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS d FROM events GROUP BY ALL HAVING count(*) >= 3)),
 m AS (SELECT u.user_id, coalesce(bool_or(event_type = 'click'), false) AS click, coalesce(bool_or(event_type = 'error'), false) AS error, coalesce(bool_or(event_type = 'signup'), false) AS signup,
   coalesce(bool_or(event_type = 'view'), false) AS "view", count(*) FILTER (WHERE event_type IN ('click', 'error', 'signup', 'view')) AS n_signals,
   u.user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 480) AS outcome
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN busy USING (user_id) GROUP BY 1) """


@query(_MATRIX + 'SELECT user_id, click, error, signup, "view", CAST(n_signals AS INTEGER) AS n_signals, outcome FROM m')
def signal_matrix(t: Tables) -> DataFrame:
    return _matrix(t)


@query(_MATRIX + "SELECT CAST(n_signals AS INTEGER) AS n_signals, count(*) AS users, count(*) FILTER (WHERE outcome) AS hits, round(100.0 * count(*) FILTER (WHERE outcome) / count(*), 4) AS pct FROM m GROUP BY 1")
def signal_count_distribution(t: Tables) -> DataFrame:
    hits = F.count_if("outcome")
    return _matrix(t).groupBy("n_signals").agg(F.count("*").alias("users"), hits.alias("hits"), agg.share(hits, F.count("*")).alias("pct"))


@query(_MATRIX + """SELECT a || '+' || b AS combo, count(*) AS users, count(*) FILTER (WHERE outcome) AS hits FROM (
  SELECT outcome, unnest([CASE WHEN click AND error THEN {'a': 'click', 'b': 'error'} END, CASE WHEN click AND signup THEN {'a': 'click', 'b': 'signup'} END, CASE WHEN click AND "view" THEN {'a': 'click', 'b': 'view'} END,
   CASE WHEN error AND signup THEN {'a': 'error', 'b': 'signup'} END, CASE WHEN error AND "view" THEN {'a': 'error', 'b': 'view'} END, CASE WHEN signup AND "view" THEN {'a': 'signup', 'b': 'view'} END], recursive := true) FROM m)
WHERE a IS NOT NULL GROUP BY 1""")
def signal_pairs(t: Tables) -> DataFrame:
    """Two-way combinations from one matrix: no join for each pair."""
    pairs = [(a, b) for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1 :]]
    combo = F.explode(F.array_compact(F.array(*[F.when(F.col(a) & F.col(b), F.lit(f"{a}+{b}")) for a, b in pairs])))
    return _matrix(t).select("outcome", combo.alias("combo")).groupBy("combo").agg(F.count("*").alias("users"), F.count_if("outcome").alias("hits"))


@query(_MATRIX + """SELECT 'click+error+signup' AS combo, count(*) AS users, count(*) FILTER (WHERE outcome) AS hits FROM m WHERE click AND error AND signup
UNION ALL SELECT 'error+signup+view', count(*), count(*) FILTER (WHERE outcome) FROM m WHERE error AND signup AND "view" """)
def signal_triples(t: Tables) -> DataFrame:
    m = _matrix(t)
    triples = [("click", "error", "signup"), ("error", "signup", "view")]
    row = m.agg(*[f(F.col(a) & F.col(b) & F.col(c) & o).alias(f"{k}_{i}") for i, (a, b, c) in enumerate(triples) for k, f, o in (("u", F.count_if, F.lit(True)), ("h", F.count_if, F.col("outcome")))])
    return row.select(F.explode(F.array(*[F.struct(F.lit("+".join(x)).alias("combo"), F.col(f"u_{i}").alias("users"), F.col(f"h_{i}").alias("hits")) for i, x in enumerate(triples)])).alias("r")).select("r.*")


@query(_MATRIX + "SELECT CASE WHEN click THEN 'click' WHEN error THEN 'error' WHEN signup THEN 'signup' ELSE 'view' END AS signal, count(*) AS users, count(*) FILTER (WHERE outcome) AS hits FROM m WHERE n_signals = 1 GROUP BY 1")
def exclusive_signals(t: Tables) -> DataFrame:
    only = F.coalesce(*[F.when(F.col(s), F.lit(s)) for s in SIGNALS])
    return _matrix(t).filter("n_signals = 1").groupBy(only.alias("signal")).agg(F.count("*").alias("users"), F.count_if("outcome").alias("hits"))
