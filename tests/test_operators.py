"""Operators on hand-made rows that the provided tables don't hold."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from lotlens.operators import aggregates, joins, upsert, windows
from lotlens.operators.text_units import BASIC, mine_units
from lotlens.plans import serving
from lotlens.plans.listings import dedup_listings
from lotlens.plans.texts import queue_links
from lotlens.plans.units import with_placeholders


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrases_are_found_alike_broadcast_and_by_grams(spark):
    rng = random.Random(7)
    signs = "ab c"
    texts = ["a dogsled runs", "a dogsled runs", "", None, "A CATEGORY"] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    phrases = ["a dogs", "a dogs", "a cat", "", None, "é", "runs"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    t = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    p = spark.createDataFrame(list(enumerate(phrases)), "j long, phrase string")
    near, far = joins.phrase_join(t, "text", p, "phrase"), joins.phrase_join(t, "text", p, "phrase", max_bytes=0)
    want = sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(phrases) if x is not None and y is not None and y.lower() in x.lower())
    assert sorted((r.i, r.j) for r in near.collect()) == sorted((r.i, r.j) for r in far.collect()) == want and near.columns == far.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert not {"CartesianProduct", "NestedLoop"} & {w for w in ("CartesianProduct", "NestedLoop") if w in plan(joins.phrase_join(t, "text", p, "phrase", max_bytes=0))}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_keys_have_one_outcome(spark):
    target = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "id long, price double, status string")
    updates = spark.createDataFrame([(1, 5.0, "x"), (1, 7.0, "y"), (3, 9.0, "z"), (3, 9.0, "w")], "id long, price double, status string")
    got = upsert.upsert(target, updates, ["id"], [F.desc("price"), F.col("status")], keep=["status"])
    assert rows(got) == [(1, 7.0, "a"), (2, 2.0, "b"), (3, 9.0, "w")]
    detail = spark.createDataFrame([(1, "p"), (1, "q"), (2, "")], "id long, status string")
    assert rows(upsert.patch_non_null(target, detail, ["id"], ["status"])) == [(1, 1.0, "q"), (2, 2.0, "b")]
    assert rows(upsert.backfill_if_empty(target.withColumn("status", F.lit("")), detail, ["id"], "status")) == [(1, 1.0, "p"), (2, 2.0, "")]
    bridge = joins.bridge(target, spark.createDataFrame([(1, 30), (1, 20), (2, None)], "id long, into long"), "id", "into")
    assert rows(bridge.select("id", "into")) == [(1, 20)]
    state = spark.createDataFrame([], "source string, source_id string, price double, status string, first_seen timestamp, last_seen timestamp")
    pull = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "source_id string, price double")
    assert [(r.source_id, r.price) for r in upsert.track_snapshot(state, pull, "s", "2024-01-01").collect()] == [("a", 3.0)]
    history = spark.createDataFrame([], "source string, source_id string, snapshot_date date, price double")
    assert [(r.source_id, r.price) for r in upsert.append_daily_price(history, pull, "s", "2024-01-01").collect()] == [("a", 3.0)]
    units = mine_units("s", spark.createDataFrame([(1, "unit 4B z", "k2"), (1, "apt 4b", "k1")], "id long, text string, key string"), "id", "text", BASIC, "key")
    assert [tuple(r) for r in units.collect()] == [("s", "1", "k1", "4B", "apt 4b")]


def test_placeholders_fill_gaps_of_any_size_from_the_count_on(spark):
    units = spark.createDataFrame([("a", f"{i}A") for i in range(3)], "key string, unit string")
    expected = spark.createDataFrame([("a", 900), ("b", 2), ("c", 0), ("d", 120_000)], "key string, n long")
    got = with_placeholders(units, expected, "key", "unit", "n").filter("is_placeholder")
    names = {k: sorted(r.unit for r in got.filter(F.col("key") == k).collect()) for k in ("a", "b", "c")}
    assert names["a"][0] == "UNIT_00004" and names["a"][-1] == "UNIT_00900" and len(names["a"]) == 897
    assert names["b"] == ["UNIT_00001", "UNIT_00002"] and names["c"] == []
    assert got.filter("key = 'd'").agg(F.count("*"), F.count_distinct("unit"), F.max("unit")).first() == (120_000, 120_000, "UNIT_99999")


def test_ranks_are_exact_with_ties_nulls_and_many_cells(spark):
    rng = random.Random(3)
    values = [rng.choice([1.0, 1.0, 1.0, 2.0, None, rng.random() * 9]) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    want = {i: k for k, i in enumerate(sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0), i)))}
    for cell_rows in (50, 700, 1_000_000):
        got = windows.global_rank(df, "v", "id", cell_rows=cell_rows)
        assert {r.id: r["rank"] for r in got.collect()} == want
    assert windows.global_rank(df.filter("false"), "v", "id").count() == 0
    cells = windows.global_rank(df.withColumn("v", F.lit(5.0)), "v", "id", cell_rows=50)
    assert cells.agg(F.count_distinct("rank"), F.max("rank")).first() == (4000, 3999)


def test_outcomes_within_windows_against_all_pairs(spark):
    rng = random.Random(5)
    day = lambda n: f"2024-01-{1 + n:02d}"
    signals = [(i, rng.choice("abc") if i % 9 else None, day(rng.randrange(25)) if i % 11 else None) for i in range(120)]
    outcomes = [(rng.choice("abcd"), day(rng.randrange(25))) for _ in range(25)] + [(None, day(3)), ("a", None)]
    s = spark.createDataFrame(signals, "i long, k string, d string").withColumn("d", F.col("d").cast("date"))
    o = spark.createDataFrame(outcomes, "k string, o string").withColumn("o", F.col("o").cast("date"))
    got = {r.i: (r.within_2, r.within_9) for r in joins.event_within(s, o, "k", "d", "o", (2, 9)).collect()}
    near = lambda k, d, n: any(k == x and d <= y and int(y[-2:]) - int(d[-2:]) <= n for x, y in outcomes if x and y)
    assert got == {i: (near(k, d, 2), near(k, d, 9)) if k and d else (False, False) for i, k, d in signals}


def test_listings_without_a_key_are_not_grouped(spark):
    df = spark.createDataFrame([(1, "k", "a", 10.0), (2, "k", "b", 10.5), (3, None, "a", 1.0), (4, None, "b", 1.0)], "id long, key string, source string, price double")
    got = {r.id: (r.is_duplicate, r.canonical_id) for r in dedup_listings(df, ["key"], ["a", "b"]).collect()}
    assert got == {1: (False, None), 2: (True, 1), 3: (False, None), 4: (False, None)}
    assert dedup_listings(df, ["key"], ["a", "b"]).columns == [*df.columns, "is_duplicate", "canonical_id"]


def test_found_links_are_queued_once(spark):
    found = spark.createDataFrame([Row(url="http://x.org/a", l=["/b?q=1", "/b/", "http://y.org/"]), Row(url="http://x.org/0", l=["/b", "/a"])])
    known = spark.createDataFrame([("http://x.org/a",)], "canonical string")
    assert rows(queue_links(found, "l", "url", known)) == [("https://x.org/b", "http://x.org/0"), ("https://y.org", "http://x.org/a")]


def test_first_names_are_neither_collected_nor_sorted_again(spark):
    """The rows stand in order for the cut to k; missing names, equal names, short groups and long texts keep their outcome."""
    rows = [(1, 2, "b"), (1, 1, "c"), (1, 1, "a"), (1, 3, "z"), (1, None, "n"), (2, 1, None), (3, 1, "x"), (3, 1, "x"), (None, 1, "k"), (4, 1, "y" * 150), (4, 2, "y" * 150)]
    got = aggregates.first_k_text(spark.createDataFrame(rows, "g int, o int, v string"), ["g"], "v", ["o"], name="t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {r.g: r.t for r in got.collect()} == {1: "n; a; c", 3: "x; x", None: "k", 4: "y" * 150 + "; " + "y" * 48}
    assert {r.g: r.v for r in aggregates.first_k_text(spark.createDataFrame(rows, "g int, o int, v string"), ["g"], "v", [], k=1, name="v").collect()} == {1: "a", 3: "x", None: "k", 4: "y" * 150}
    assert "Aggregate" not in plan and plan.count("Sort [") == 2  # before and after the one exchange


def test_tables_of_many_documents_are_not_shuffled_to_be_reduced(spark, monkeypatch):
    """Without broadcasts of Spark's own, as beyond its threshold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        master = spark.createDataFrame([(d, "DEED" if d % 3 else "MAP") for d in range(9)], "d int, kind string")
        legals = spark.createDataFrame([(d, d * 10 + i) for d in range(8) for i in (2, 1)], "d int, parcel int")
        parties = spark.createDataFrame([(d, 1 + i % 2, f"n{i}") for d in range(8) for i in range(9 if d == 4 else 1)], "d int, side int, name string")
        want = {(d, "DEED", d * 10 + 1, "n0; n2; n4" if d == 4 else "n0", "n1; n3; n5" if d == 4 else "") for d in (1, 2, 4, 5, 7)}
        for few, picked in ((100_000, 3), (0, 0)):
            monkeypatch.setattr(serving, "FEW", few, raising=False)
            got = serving.assemble_documents(master, legals, parties, "d", ("DEED",), "kind")
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert set(map(tuple, got.collect())) == want and plan.count("LeftSemi") == picked
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
