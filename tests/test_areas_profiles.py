import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from lotlens.operators import areas, profiles
from lotlens.plans import catalog, scoring


def test_texts_become_zips(spark):
    asked = ["Gramercy", "village", "UES", "10003", "10001, 10002,", "near the east village please", "a lower east side flat", "", None, "nowhere", " soho ", "uws"]
    got = areas.resolve_areas(spark.createDataFrame([(a,) for a in asked], "a string"), "a", areas.area_names(spark)).collect()
    by = {a: (sorted(r.zip for r in got if r.a == a), {r.how for r in got if r.a == a}) for a in asked if a}
    zips = lambda *names: sorted({z for n in names for z in areas.AREA_ZIPS[n].split()})
    assert by["Gramercy"] == (zips("gramercy"), {"name"}) and by[" soho "] == (zips("soho"), {"name"})
    assert by["village"] == (zips("east village", "west village", "greenwich village", "the village"), {"part"})  # each zip once
    assert by["10003"] == (["10003"], {"zip"}) and by["10001, 10002,"] == (["10001", "10002"], {"list"})
    assert by["near the east village please"] == (zips("east village"), {"within"}) and by["a lower east side flat"] == (zips("lower east side"), {"within"})
    assert by["nowhere"] == ([], set()) and not [r for r in got if not r.a]


def test_one_building_by_key_or_by_fragment(spark):
    rows = spark.createDataFrame([(1000010001, "1 MAIN ST", 5), (1000010002, "11 Main Street", 9), (1000010003, "2 ELM", 0), (1000010004, "main", 0)], "bbl long, address string, units int")
    find = lambda asked, **k: [r.bbl for r in areas.look_up(rows, asked, "bbl", "address", "units", **k).collect()]
    assert find(" 1000010003 ") == [1000010003] and find("main") == [1000010002, 1000010001] and find("MAIN", limit=1) == [1000010002] and find("99") == []


def test_merged_states_are_those_of_the_whole(spark):
    rows = [Row(s=k % 3, d=k % 5, n=float(k * 37 % 1000) if k % 4 else None, t=f"v{k % 60}" if k % 9 else None, e=None) for k in range(3000)]
    df = spark.createDataFrame(rows, "s int, d int, n double, t string, e string").withColumn("n", F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(F.col("n")))
    states = profiles.column_states(df, ["s", "d"], ["n", "t", "e"])
    merged = {r.column: r for r in profiles.merged_profile(states).collect()}
    values = sorted(r.n for r in rows if r.n)
    assert (merged["n"].rows, merged["n"].filled, merged["n"].least, merged["n"].most) == (3000, len(values), str(values[0]), str(values[-1]))
    assert abs(merged["n"].n_distinct - len(set(values))) <= 0.03 * len(set(values)) and abs(values.index(merged["n"].quantiles[0]) / len(values) - 0.5) < 0.04
    assert (merged["t"].filled, merged["t"].n_distinct, merged["t"].least, merged["t"].quantiles) == (sum(r.t is not None for r in rows), 60, "v0", [None, None])
    assert (merged["e"].filled, merged["e"].n_distinct, merged["e"].least) == (0, 0, None)
    by_source = profiles.merged_profile(states, ["s"]).filter("column = 't'").collect()
    assert sum(r.filled for r in by_source) == merged["t"].filled
    top = profiles.merged_values(profiles.value_states(df, ["s", "d"], ["t"]), n=3).orderBy(F.desc("n"), "value").collect()
    exact = df.filter("t is not null").groupBy("t").count().orderBy(F.desc("count"), "t").limit(3).collect()
    assert [(r.value, r.n) for r in top] == [(r.t, r["count"]) for r in exact]
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("Exchange ") == 1
    assert profiles.merged_profile(profiles.column_states(df.filter("false"), ["s"], ["n"])).count() == 0


def test_top_values_of_merged_states_are_exact(spark):
    """A value that is rare in each state and frequent over all of them; long values are told apart."""
    rows = [(d, f"{d}-{k}") for d in range(4) for k in range(300) for _ in range(2)] + [(d, "zz") for d in range(4)] + [(0, "x" * 300 + e) for e in "ab" for _ in range(3)]
    top = profiles.merged_values(profiles.value_states(spark.createDataFrame(rows, "d int, t string"), ["d"], ["t"]), n=3).collect()
    assert {(r.value, r.n) for r in top} == {("zz", 4), ("x" * 300 + "a", 3), ("x" * 300 + "b", 3)}


def test_lines_of_many_buildings_are_not_shuffled_to_be_picked(spark, monkeypatch):
    """Without broadcasts of Spark's own, as beyond its threshold: few keys are broadcast, many pick nothing; the rows are the same."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("score_area", "score_one"):
            monkeypatch.setattr(scoring, "FEW", 100_000)
            few = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
            monkeypatch.setattr(scoring, "FEW", 0)
            monkeypatch.setattr(scoring, "PAIRS", 1000)
            many = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
            joined = [line for line in plan(few).splitlines() if "LeftSemi" in line]
            assert len(joined) == 2 and all("BroadcastHashJoin [l_partkey" in line for line in joined)
            assert "LeftSemi" not in plan(many)
            # pairs are dealt to as many tasks as there are thousands of the 60,000 lines, before anything is hashed
            assert plan(many).count(", 60), REPARTITION_BY_NUM") == 1  # what is traded is not asked for
            assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_dealt_by_building_before_they_are_hashed(spark, monkeypatch, tmp_path):
    """No aggregate stands below the exchange that deals lines, of which there are no more tasks than hold nothing; the rows are those of the SQL's."""
    source = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{source}/lineitem.parquet").limit(2000)
    odd = lines.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "l_partkey" else F.lit(1).cast(f.dataType).alias(f.name) for f in lines.schema])
    keyless = lines.limit(3).withColumn("l_partkey", F.lit(None).cast("long"))
    hot = lines.limit(300).withColumn("l_partkey", F.lit(2).cast("long"))
    lines.union(odd).union(keyless).union(hot).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{source}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    whole = sorted(map(tuple, catalog.QUERIES["building_scores"](spark, str(tmp_path)).collect()))
    monkeypatch.setattr(scoring, "LINES", 10)
    monkeypatch.setattr(scoring, "PAIRS", 10)
    monkeypatch.setattr(scoring, "UNHELD", 7)
    dealt = catalog.QUERIES["building_scores"](spark, str(tmp_path))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    deals = [k for k, line in enumerate(plan.splitlines()) if "REPARTITION_BY_NUM" in line]
    texts = plan.splitlines()
    assert sum(", 7), REPARTITION_BY_NUM" in texts[k] for k in deals) == 1  # lines
    assert sum(", 231), REPARTITION_BY_NUM" in texts[k] for k in deals) == 2  # pairs of suppliers and of orders: 2304 lines
    for k in deals:  # what follows a deal in the tree, up to the scan, is not an aggregate
        below = texts[k + 1 : next(m for m in range(k, len(texts)) if "Scan" in texts[m]) + 1]
        assert not any("Aggregate" in line for line in below)
    assert sorted(map(tuple, dealt.collect())) == whole
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(catalog.ORACLES["building_scores"]).fetchall()) == whole
