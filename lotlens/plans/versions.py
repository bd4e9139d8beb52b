"""Versioned tables, halved ranges and the lattice of signals on the provided data."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.operators import lattice, ranges
from lotlens.operators import upsert as up
from lotlens.plans.files import scratch
from lotlens.plans.registry import Tables, query
from lotlens.sources.versioned import VersionedTable

SCHEMA = "source string, id bigint, price double, status string"


def _orders(t: Tables) -> DataFrame:
    source = F.element_at(F.array(*[F.lit(s) for s in "abc"]), (F.col("o_custkey") % 3 + 1).cast("int"))
    return t.orders.select(source.alias("source"), F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def _history(t: Tables) -> tuple[VersionedTable, list[dict[str, int]]]:
    """A first load, an upsert of two buckets of a source, a reset of another source, a write that fails, one more upsert."""
    table = VersionedTable(t.spark, scratch(t.spark), SCHEMA, ["source", "id"], part=F.ascii("source"), bucket=F.col("id") % 8)
    rows, order = _orders(t), [F.desc("price"), F.col("status")]
    done = [table.upsert(rows.filter("id % 3 > 0"), order)]
    done.append(table.upsert(rows.filter("source = 'a' and id % 8 < 2").select("source", "id", (F.col("price") * 2).alias("price"), F.lit("new").alias("status")), order, keep=["status"]))
    done.append(table.reset_source(ord("b"), "b"))
    torn = F.when(F.col("id") % 16 == 5, F.raise_error(F.lit("torn")).cast("double")).otherwise(0.0)
    try:
        table.upsert(rows.filter("source = 'c'").withColumn("price", torn), order)
    except (PySparkException, Py4JJavaError):
        pass  # the rows are not committed
    done.append(table.upsert(rows.filter("source = 'c' and id % 8 = 5").withColumn("price", F.col("price") + 1), order))
    return table, done


_VERSIONS = """WITH o AS (SELECT ['a', 'b', 'c'][CAST(o_custkey % 3 + 1 AS INTEGER)] AS source, CAST(o_orderkey AS BIGINT) AS id, o_totalprice AS price, o_orderstatus AS status FROM orders),
 f AS (SELECT source, id, CASE WHEN source = 'a' AND id % 8 < 2 THEN price * 2 WHEN source = 'c' AND id % 8 = 5 THEN price + 1 ELSE price END AS price,
   CASE WHEN id % 3 = 0 AND source = 'a' THEN 'new' ELSE status END AS status FROM o WHERE source <> 'b' AND (id % 3 > 0 OR (source = 'a' AND id % 8 < 2) OR (source = 'c' AND id % 8 = 5))) """


@query(_VERSIONS + "SELECT * FROM f")
def versioned_rows(t: Tables) -> DataFrame:
    """What a reader sees after all of it."""
    return _history(t)[0].read()


@query(_VERSIONS + """SELECT CAST(ascii(source) AS BIGINT) AS part, CAST(id % 8 AS INTEGER) AS bucket, count(*) AS rows, CAST(CASE WHEN source = 'a' AND id % 8 < 2 THEN 2 WHEN source = 'c' AND id % 8 = 5 THEN 4 ELSE 1 END AS INTEGER) AS since, true AS same_files FROM f GROUP BY ALL""")
def versioned_parts(t: Tables) -> DataFrame:
    """Which version wrote each part: untouched ones keep their files of the first."""
    table, _ = _history(t)
    first = table.parts(1).select("part", "bucket", F.col("at").alias("_first"))
    parts = table.parts().join(first, ["part", "bucket"], "left")
    return parts.select("part", "bucket", "rows", "since", ((F.col("at") == F.col("_first")) == (F.col("since") == 1)).alias("same_files"))


@query(_VERSIONS + """, a AS (SELECT *, source = 'a' AND id % 8 < 2 AS two, source = 'c' AND id % 8 = 5 AS four FROM o)
 SELECT CAST(1 AS INTEGER) AS version, count(*) FILTER (WHERE id % 3 > 0) AS rows, count(*) FILTER (WHERE id % 3 > 0) AS new, CAST(0 AS BIGINT) AS updated FROM a
 UNION ALL SELECT 2, count(*) FILTER (WHERE two), count(*) FILTER (WHERE two AND id % 3 = 0), count(*) FILTER (WHERE two AND id % 3 > 0) FROM a
 UNION ALL SELECT 3, 0, 0, 0 UNION ALL SELECT 4, count(*) FILTER (WHERE four), count(*) FILTER (WHERE four AND id % 3 = 0), count(*) FILTER (WHERE four AND id % 3 > 0) FROM a""")
def versioned_counts(t: Tables) -> DataFrame:
    """Rows written, new and updated ones of each version, as its writing plan observed them."""
    _, done = _history(t)
    return t.spark.createDataFrame([tuple(d[c] for c in ("version", "rows", "new", "updated")) for d in done], "version int, rows bigint, new bigint, updated bigint")


@query("""WITH s AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderkey % 2 = 0 AS mine, CAST(o_orderdate AS DATE) AS seen FROM orders WHERE o_orderkey % 5 < 4),
 p AS (SELECT o_orderkey AS id, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 < 5)
SELECT (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM s)) AS new, (SELECT count(*) FROM p WHERE id IN (SELECT id FROM s)) AS updated, count(*) FILTER (WHERE status = 'inactive') AS inactive, count(*) AS rows, sum(CASE WHEN first_day = DATE '2024-02-01' THEN 1 ELSE 0 END)::BIGINT AS first_seen_now
 FROM (SELECT CASE WHEN p.id IS NOT NULL THEN 'active' WHEN mine THEN 'inactive' ELSE 'active' END AS status, coalesce(seen, DATE '2024-02-01') AS first_day FROM s FULL JOIN p ON s.id = p.id)""")
def tracked_pull(t: Tables) -> DataFrame:
    """A pull of one source into a versioned table of listings, with its counts of new and updated rows."""
    schema = "source string, source_id string, price double, status string, first_seen timestamp, last_seen timestamp"
    table = VersionedTable(t.spark, scratch(t.spark), schema, ["source", "source_id"], part=F.ascii("source"))
    day = F.col("o_orderdate").cast("timestamp")
    state = t.orders.filter("o_orderkey % 5 < 4").select(F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("source"), F.col("o_orderkey").cast("string").alias("source_id"), F.col("o_totalprice").alias("price"), F.lit("active").alias("status"), day.alias("first_seen"), day.alias("last_seen"))
    table.upsert(state, [F.col("price")])
    pull = t.orders.filter("o_orderkey % 2 = 0 and o_orderkey % 7 < 5").select(F.col("o_orderkey").cast("string").alias("source_id"), (F.col("o_totalprice") + 1).alias("price"))
    done = table.track(pull, ord("a"), "a", "2024-02-01 00:00:00")
    today = F.count_if(F.col("first_seen").cast("date") == F.lit("2024-02-01").cast("date"))
    return table.read().agg(F.lit(done["new"]).cast("bigint").alias("new"), F.lit(done["updated"]).cast("bigint").alias("updated"), F.count_if(F.col("status") == "inactive").alias("inactive"), F.count("*").alias("rows"), today.alias("first_seen_now"))


@query("SELECT 'orders' AS phase, (SELECT count(*) FROM orders) AS processed, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS inserted, 'ok' AS notes")
def observed_run_log(t: Tables) -> DataFrame:
    """The audit row of a written table, from the pass that writes it."""
    path = scratch(t.spark)
    return up.observed_run(lambda rows: rows.write.parquet(path), t.orders, F.col("o_orderstatus") == "P", "orders", "2024-02-01 00:00:00", "ok").drop("run_at")


RANGES = [(None, 50_000), (50_000, 100_000), (100_000, 200_000), (200_000, None)]
CAP, LEAST_WIDTH, OPEN_WIDTH = 300, 50, 50_000


@query(f"""WITH RECURSIVE h AS (SELECT v, count(*) AS c FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 55555 WHEN o_orderkey % 10 = 1 THEN 4 * floor(o_totalprice) ELSE floor(o_totalprice) END AS v FROM orders) GROUP BY 1),
 g(lo, hi) AS (VALUES (CAST(NULL AS BIGINT), CAST(50000 AS BIGINT)), (50000, 100000), (100000, 200000), (200000, NULL)),
 r(lo, hi, l, u, n) AS (SELECT lo, hi, coalesce(lo, 0), coalesce(hi, lo * 3, {OPEN_WIDTH}), (SELECT coalesce(sum(c), 0) FROM h WHERE (lo IS NULL OR v >= lo) AND (hi IS NULL OR v < hi)) FROM g
  UNION ALL SELECT k.lo, k.hi, coalesce(k.lo, 0), coalesce(k.hi, k.lo * 3), (SELECT coalesce(sum(c), 0) FROM h WHERE (k.lo IS NULL OR v >= k.lo) AND (k.hi IS NULL OR v < k.hi))
   FROM (SELECT CASE WHEN s = 0 THEN lo ELSE (l + u) // 2 END AS lo, CASE WHEN s = 0 THEN (l + u) // 2 ELSE hi END AS hi FROM r, (SELECT unnest([0, 1]) AS s) WHERE n >= {CAP} AND u - l >= {LEAST_WIDTH}) k)
SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CAST(n AS BIGINT) AS n, n < {CAP} AS complete FROM r WHERE n < {CAP} OR u - l < {LEAST_WIDTH}""")
def halved_ranges(t: Tables) -> DataFrame:
    """Prices with open ends and one value that more rows share than are given out at once."""
    k, price = F.col("o_orderkey") % 10, F.floor("o_totalprice")
    rows = t.orders.select(F.when(k == 0, 55_555).when(k == 1, 4 * price).otherwise(price).cast("bigint").alias("v"))
    return ranges.halved_ranges(rows, "v", RANGES, CAP, LEAST_WIDTH, OPEN_WIDTH)


_TYPES = ("click", "error", "signup", "view")
#: Ten signals: large and small values of four kinds of events, large ones at night and late in the month.
SIGNALS = {f"{t}_{side}": f"event_type = '{t}' AND value {limit}" for t in _TYPES for side, limit in (("high", "> 490"), ("low", "< 8"))} | {"night": "hour(ts) = 3 AND value > 400", "late": "day(ts) >= 29 AND value > 450"}


def _flags() -> dict[str, Column]:
    return {name: F.expr(rule) for name, rule in SIGNALS.items()}


_MASKS = "WITH m AS (SELECT user_id, " + " + ".join(f"CASE WHEN bool_or({rule}) THEN {1 << i} ELSE 0 END" for i, rule in enumerate(SIGNALS.values())) + " AS mask, bool_or(event_type = 'purchase' AND value > 480) AS outcome FROM events GROUP BY 1), k AS (SELECT mask, count(*) AS keys, count(*) FILTER (WHERE outcome) AS hits FROM m GROUP BY 1) "


@query(_MASKS + """, s AS (SELECT unnest(range(1024)) AS s), t AS (SELECT sum(keys) AS n, sum(hits) AS h FROM k)
SELECT array_to_string(list_filter([""" + ", ".join(f"CASE WHEN s & {1 << i} > 0 THEN '{name}' END" for i, name in enumerate(SIGNALS)) + """], lambda x: x IS NOT NULL), '+') AS combo, CAST(bit_count(s) AS INTEGER) AS n_signals, CAST(sum(keys) AS BIGINT) AS keys, CAST(sum(hits) AS BIGINT) AS hits,
 CAST(coalesce(sum(keys) FILTER (WHERE mask = s), 0) AS BIGINT) AS keys_exact, CAST(coalesce(sum(hits) FILTER (WHERE mask = s), 0) AS BIGINT) AS hits_exact, round(sum(hits) / sum(keys), 6) AS rate, round((sum(hits) / sum(keys)) / (any_value(h) / any_value(n)), 4) AS lift
 FROM s JOIN k ON mask & s = s, t GROUP BY s""")
def signal_lattice(t: Tables) -> DataFrame:
    """All combinations of ten signals of a user: with at least and with exactly these, their outcomes and lifts."""
    masks = lattice.key_masks(t.events, "user_id", _flags(), F.expr("event_type = 'purchase' AND value > 480"))
    return lattice.signal_lattice(lattice.mask_table(masks), list(SIGNALS))


@query(_MASKS + "SELECT CAST(l AS INTEGER) AS least, CAST(sum(keys) AS BIGINT) AS keys, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits) / sum(keys), 6) AS rate FROM k JOIN (SELECT unnest([1, 2, 3, 5]) AS l) ON bit_count(mask) >= l GROUP BY l")
def stacked_signals(t: Tables) -> DataFrame:
    masks = lattice.key_masks(t.events, "user_id", _flags(), F.expr("event_type = 'purchase' AND value > 480"))
    return lattice.stacked_rates(lattice.mask_table(masks), (1, 2, 3, 5))
