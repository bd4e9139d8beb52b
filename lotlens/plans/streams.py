"""Streams over the provided data: what is written to a shared folder is replayed, and the sink is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.plans.files import scratch
from lotlens.plans.registry import Tables, query
from lotlens.streaming.alerts import _newest_before, alert_stream, newest_state, snapshot_stream, windowed_counts
from lotlens.streaming.watch import watched_alerts


def _finished(stream) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


@query("SELECT DISTINCT user_id, event_type, event_id FROM events WHERE user_id % 7 = 0 AND event_type <> 'view'")
def alert_replay(t: Tables) -> DataFrame:
    """Events pulled twice: each event of a watched user raises one alert."""
    path = scratch(t.spark)
    pulled = t.events.filter("event_type <> 'view'").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    pulled.union(pulled).write.parquet(f"{path}/in")
    events = t.spark.readStream.schema(pulled.schema).parquet(f"{path}/in")
    watched = pulled.filter("user_id % 7 = 0").select("user_id").distinct()
    alerts = alert_stream(events, watched, "user_id", "ts").select("user_id", "event_type", "event_id")
    _finished(alerts.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start())
    return t.spark.read.schema(alerts.schema).parquet(f"{path}/out")


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_replay(t: Tables) -> DataFrame:
    """Events of each day by type: the last state of every window."""
    path = scratch(t.spark)
    t.events.select("event_type", "ts").write.parquet(f"{path}/in")
    events = t.spark.readStream.schema("event_type string, ts timestamp").parquet(f"{path}/in")

    def whole(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/v{number:08d}")

    counts = windowed_counts(events, "ts", "1 day").select(F.col("window.start").cast("date").alias("day"), "event_type", "n")
    _finished(counts.writeStream.outputMode("complete").foreachBatch(whole).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start())
    return t.spark.read.schema(counts.schema).parquet(_newest_before(t.spark, f"{path}/out", 1 << 62))


@query("""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 3 > 0), b AS (SELECT o_orderkey AS id, 2 * o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0)
SELECT CAST(id AS VARCHAR) AS source_id, coalesce(b.price, a.price) AS price, CASE WHEN b.price IS NULL THEN 'inactive' ELSE 'active' END AS status, CASE WHEN a.price IS NULL THEN DATE '2024-01-02' ELSE DATE '2024-01-01' END AS first_seen, CASE WHEN b.price IS NULL THEN DATE '2024-01-01' ELSE DATE '2024-01-02' END AS last_seen FROM a FULL JOIN b USING (id)""")
def snapshot_replay(t: Tables) -> DataFrame:
    """Two pulls of a feed folded into its state: what the second no longer shows is inactive."""
    path = scratch(t.spark)
    schema = "source_id string, price double, pulled_at timestamp"
    pull = lambda keep, price, day: t.orders.filter(keep).select(F.col("o_orderkey").cast("string").alias("source_id"), price.alias("price"), F.lit(day).cast("timestamp").alias("pulled_at"))
    for rows in (pull("o_orderkey % 3 > 0", F.col("o_totalprice"), "2024-01-01"), pull("o_orderkey % 2 = 0", 2 * F.col("o_totalprice"), "2024-01-02")):
        rows.write.mode("append").parquet(f"{path}/in")
        _finished(snapshot_stream(t.spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/state", "feed", f"{path}/check"))
    state = newest_state(t.spark, f"{path}/state", "feed")
    return state.select("source_id", "price", "status", F.col("first_seen").cast("date").alias("first_seen"), F.col("last_seen").cast("date").alias("last_seen"))


#: Batches of the month, each a pull of six days.
BATCH_DAYS = 6

_BATCHES = f"""WITH e AS (SELECT user_id AS key, event_type AS kind, event_id, date_trunc('second', CAST(ts AS TIMESTAMP)) AS moment, CAST((day(CAST(ts AS TIMESTAMP)) - 1) // {BATCH_DAYS} AS INTEGER) AS b FROM events WHERE event_type IN ('error', 'signup')),
 r AS (SELECT key, kind, event_id, moment, b FROM e WHERE event_id % 5 > 0 OR b = 4
  UNION ALL SELECT key, kind, event_id, moment, b + 1 FROM e WHERE event_id % 5 = 0 AND b < 4
  UNION ALL SELECT key, kind, event_id, moment, b FROM e WHERE event_id % 3 = 0 AND (event_id % 5 > 0 OR b = 4)
  UNION ALL SELECT key, kind, event_id, moment + INTERVAL 9 DAY, b + 2 FROM e WHERE event_id % 4 = 0 AND b < 3),
 m AS (SELECT b, max(max(moment)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT b, moment FROM r UNION ALL SELECT 0, TIMESTAMP '2024-01-01') GROUP BY b),
 w AS (SELECT r.*, b IN (0) OR moment > top - INTERVAL 2 DAY AS timely FROM r JOIN m USING (b)) """


def _batches(t: Tables) -> list[DataFrame]:
    """Five pulls of events and changes of the watchlist: some events come a pull late, twice, or again after nine days."""
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    e = t.events.filter(F.col("event_type").isin("error", "signup")).select(F.col("user_id").cast("bigint").alias("key"), F.lit("event").alias("op"), F.col("event_type").alias("kind"), F.col("event_id").cast("bigint").alias("event_id"), at.alias("at"))
    e = e.withColumn("b", F.floor((F.day("at") - 1) / BATCH_DAYS).cast("int"))
    again = e.filter("event_id % 4 = 0 and b < 3").withColumn("at", F.col("at") + F.expr("interval 9 days")).withColumn("b", F.col("b") + 2)
    rows = e.withColumn("b", F.when((F.col("event_id") % 5 == 0) & (F.col("b") < 4), F.col("b") + 1).otherwise(F.col("b")))
    rows = rows.union(e.filter("event_id % 3 = 0 and (event_id % 5 > 0 or b = 4)")).union(again)
    keys = t.events.select(F.col("user_id").cast("bigint").alias("key")).distinct()
    change = lambda where, op, at, b: keys.filter(where).select("key", F.lit(op).alias("op"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("event_id"), F.lit(at).cast("timestamp").alias("at"), F.lit(b).alias("b"))
    rows = rows.union(change("key % 2 = 0", "watch", "2024-01-01", 0)).union(change("key % 6 = 0", "unwatch", "2024-01-10", 1)).union(change("key % 5 = 0 and key % 2 = 1", "watch", "2024-01-16", 2))
    return [rows.filter(F.col("b") == b).drop("b") for b in range(5)]


@query(_BATCHES + """, d AS (SELECT DISTINCT key, kind, event_id, moment, b FROM w WHERE timely AND ((key % 2 = 0 AND (key % 6 <> 0 OR moment < TIMESTAMP '2024-01-10')) OR (key % 5 = 0 AND key % 2 = 1 AND moment >= TIMESTAMP '2024-01-16')))
 SELECT key, kind, event_id, CAST(moment AS DATE) AS day FROM (SELECT *, lag(moment) OVER (PARTITION BY key, kind, event_id ORDER BY moment) AS before FROM (SELECT DISTINCT key, kind, event_id, moment FROM d)) WHERE before IS NULL OR moment > before + INTERVAL 8 DAY""")
def watchlist_replay(t: Tables) -> DataFrame:
    """Five batches with late, repeated and expired events, the query started anew for each from its checkpoint."""
    path = scratch(t.spark)
    schema = "key bigint, op string, kind string, event_id bigint, at timestamp"
    for batch in _batches(t):
        batch.write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(schema).parquet(f"{path}/in")
        alerts = watched_alerts(stream, silence="8 days", delay="2 days")
        _finished(alerts.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start())
    return t.spark.read.schema("key bigint, kind string, event_id bigint, at timestamp").parquet(f"{path}/out").select("key", "kind", "event_id", F.col("at").cast("date").alias("day"))


@query(_BATCHES + """, f AS (SELECT max(moment) - INTERVAL 2 DAY AS done FROM r) SELECT CAST(moment AS DATE) AS day, kind AS event_type, count(*) AS n FROM w WHERE b = 0 OR CAST(moment AS DATE) + 1 > (SELECT top - INTERVAL 2 DAY FROM m WHERE m.b = w.b) GROUP BY 1, 2 HAVING CAST(moment AS DATE) + 1 <= (SELECT done FROM f)""")
def late_window_replay(t: Tables) -> DataFrame:
    """Daily counts in append mode over the same batches: rows of windows that were closed are dropped, open windows wait."""
    path = scratch(t.spark)
    for batch in _batches(t):
        batch.write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema("key bigint, op string, kind string, event_id bigint, at timestamp").parquet(f"{path}/in")
        counts = windowed_counts(stream.filter("op = 'event'").withColumnRenamed("kind", "event_type"), "at", "1 day", delay="2 days").select(F.col("window.start").cast("date").alias("day"), "event_type", "n")
        _finished(counts.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start())
    return t.spark.read.schema(counts.schema).parquet(f"{path}/out")
