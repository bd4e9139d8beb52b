import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from lotlens.operators import pages
from lotlens.plans import warehouse as wh
from lotlens.sources import io
from lotlens.streaming.alerts import alert_stream, newest_state, snapshot_stream, windowed_counts


def test_readers(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "batch_00001.json").write_text(json.dumps([{"document_id": "1"}, {"document_id": "2"}]))
    (tmp_path / "a" / "b" / "batch_00002.json").write_text(json.dumps([{"document_id": "3"}]))
    (tmp_path / "a" / "other.json").write_text("[]")
    assert {r.document_id for r in io.scan_json_batches(spark, str(tmp_path / "a"), "document_id string").collect()} == {"1", "2", "3"}
    (tmp_path / "l.txt").write_text("one\n\n  two \n")
    assert [r.value for r in io.scan_lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two"]
    (tmp_path / "i1").write_text(json.dumps([["original", "timestamp"], ["u1", "20240101000000"], ["u2", "20240102000000"]]))
    (tmp_path / "i2").write_text('{"timestamp":"1","original":"u"}\n')
    (tmp_path / "i3").write_text("key 20240101000000 http://u text/html\n")
    got = [[tuple(r) for r in io.scan_archive_index(spark, str(tmp_path / f), layout).orderBy("original").collect()] for f, layout in (("i1", "arrays"), ("i2", "objects"), ("i3", "fields"))]
    assert got == [[("20240101000000", "u1"), ("20240102000000", "u2")], [("1", "u")], [("20240101000000", "http://u")]]
    df = spark.createDataFrame([Row(a=1, b='x "q"', c=None)], "a int, b string, c string")
    io.write_csv(df, str(tmp_path / "csv"))
    assert io.scan_csv(spark, str(tmp_path / "csv"), "a int, b string, c string").first().b == 'x "q"'
    io.write_json(df, str(tmp_path / "json"))
    assert spark.read.schema("a int").json(str(tmp_path / "json")).first().a == 1
    io.write_table(df, str(tmp_path / "t"), ["a"])
    assert io.scan_table(spark, str(tmp_path / "t"), ["b"], "a = 1").count() == 1
    assert io.scan_dynamic(df, ["a", "b", "zz"], ["b", "zz"]).first().asDict() == {"a": "1", "b": 'x "q"', "zz": "", "raw_text": 'x "q"'}


def test_flatten_listing(spark):
    doc = json.dumps({"id": "7", "price": {"list": 5.0}, "agents": [{"name": "Ann"}]})
    df = spark.createDataFrame([(doc,), ("{}",)], "j string")
    schema = "id string, price struct<list:double>, agents array<struct<name:string>>"
    got = io.flatten_listing(df, "j", schema, {"id": "id", "price": "price.list", "agent": "agents[0].name"}).collect()
    assert [tuple(r) for r in got] == [("7", 5.0, "Ann"), (None, None, None)]


def test_page_facts_and_embedded_record(spark):
    html = '<title>740 Park Avenue in Lenox Hill : Sales</title><meta name="description" content="It is a co-op building built in 1930. It has 19 stories and 31 units."><meta name="ICBM" content="40.5; -73.9"><script>self.__next_f.push([1,"{\\"amenities\\":[\\"Gym\\",\\"Roof\\"],\\"inventory\\":{\\"forSale\\":2,\\"forRent\\":1}}"])</script>'
    r = spark.createDataFrame([(html,)], "h string").select(pages.page_facts(F.col("h")).alias("f"), pages.building_record(F.col("h")).alias("b")).first()
    assert tuple(r.f) == ("740 Park Avenue in Lenox Hill : Sales", "740 Park Avenue", "Lenox Hill", "Co-op", 1930, 19, 31, 40.5, -73.9)
    assert r.b.amenities == ["Gym", "Roof"] and r.b.inventory.forSale == 2 and r.b.owner is None


def test_alert_stream_drops_repeats_and_strangers(spark, tmp_path):
    rows = [(1, "error", 10, "2024-01-01 00:00:00"), (1, "error", 10, "2024-01-02 00:00:00"), (2, "error", 11, "2024-01-01 00:00:00"), (1, "view", 10, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id int, event_type string, event_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    watch = spark.createDataFrame([(1,)], "user_id int")
    q = alert_stream(stream, watch, "user_id", "ts").writeStream.format("memory").queryName("alerted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.event_id) for r in spark.table("alerted").collect()) == [("error", 10), ("view", 10)]
    q = windowed_counts(stream, "ts", "1 day").writeStream.format("memory").outputMode("complete").queryName("counted").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("counted").collect()) == 4


def test_snapshot_stream_folds_pulls(spark, tmp_path):
    schema = "source_id string, price double, pulled_at timestamp"
    state = str(tmp_path / "state")
    for i, pull in enumerate([[("a", 1.0), ("b", 2.0)], [("b", 3.0), ("c", 4.0)]]):
        spark.createDataFrame(pull, "source_id string, price double").withColumn("pulled_at", F.to_timestamp(F.lit(f"2024-01-0{i + 1} 00:00:00"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = snapshot_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), state, "feed", str(tmp_path / "check"))
        q.awaitTermination(120)
    got = {r.source_id: (r.price, r.status, str(r.first_seen)[:10], str(r.last_seen)[:10]) for r in newest_state(spark, state, "feed").collect()}
    assert got == {"a": (1.0, "inactive", "2024-01-01", "2024-01-01"), "b": (3.0, "active", "2024-01-01", "2024-01-02"), "c": (4.0, "active", "2024-01-02", "2024-01-02")}


def raw(spark, *rows):
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def test_curated_tables(spark):
    base = {"borough": "MN", "address": "1 Main Street", "zipcode": "10001", "bldgclass": "D4", "yearbuilt": "1930", "numfloors": "6", "unitstotal": "11", "ownername": "X", "assesstot": "1000", "resarea": "8005", "latitude": "40.1", "longitude": "x"}
    pluto = raw(spark, base | {"bbl": "1000010010.00000000", "unitsres": "10"}, base | {"bbl": "1000010020", "unitsres": "0"}, base | {"bbl": "1000017501", "unitsres": "40", "address": "2 Oak Ave"})
    b = wh.buildings(pluto)
    first = {r.bbl: r for r in b.collect()}
    assert set(first) == {1000010010, 1000017501} and first[1000010010].avg_unit_sqft == 800 and first[1000010010].longitude is None
    lookup = wh.bin_map(raw(spark, {"bin": "1001", "bbl": "1000010010"}, {"bin": "x", "bbl": "1000010010"}, {"bin": "1002", "bbl": "0"}))
    assert [tuple(r) for r in lookup.collect()] == [(1001, 1000010010)]
    v = wh.violations(raw(spark, {"bin": "1001", "severity": "1", "violation_type": "t", "issue_date": "20240105", "ecb_violation_status": "s", "penality_imposed": "$1,200", "balance_due": ""}, {"bin": "9"}), lookup).collect()
    assert len(v) == 1 and str(v[0].issue_date) == "2024-01-05" and v[0].penalty == 1200.0 and v[0].balance_due is None
    sales = wh.sales(
        raw(spark, {"document_id": "d1", "doc_type": "DEED", "document_amt": "500", "document_date": "2024-01-05T00", "recorded_datetime": "2024-01-06"}, {"document_id": "d2", "doc_type": "OTHER"}),
        raw(spark, {"document_id": "d1", "borough": "1", "block": "1", "lot": "1203", "unit": "4A"}, {"document_id": "d1", "borough": "1", "block": "1", "lot": "10", "unit": "n/a"}),
        raw(spark, *[{"document_id": "d1", "party_type": "1", "name": n} for n in ("D", "B", "A", "C")], {"document_id": "d1", "party_type": "2", "name": "Z"}), b,
    ).collect()
    assert len(sales) == 1 and (sales[0].bbl, sales[0].seller, sales[0].buyer, sales[0].unit) == (1000010010, "A; B; C", "Z", None)
    e = wh.evictions(raw(spark, {"eviction_address": "1 MAIN ST", "eviction_zip": "10001", "eviction_apartment": "2", "executed_date": "1/5/2024"}, {"eviction_address": "2 oak avenue", "eviction_zip": "1"}, {"eviction_address": "9 Elm"}), b).collect()
    assert {(r.bbl, r.method) for r in e} == {(1000010010, "address and zip"), (1000017501, "address")}
    co = wh.certificates(raw(spark, {"bin": "1001", "borough": "1", "block": "9", "lot": "9"}, {"bin": "x", "borough": "1", "block": "1", "lot": "7501"}, {"bin": None, "borough": "1", "block": "1", "lot": "1500"}, {"borough": "1", "block": "7", "lot": "1"}).select("*", *[F.lit("").alias(x) for x in ("job_number", "co_issue_date", "co_type", "existing_dwelling_units", "proposed_dwelling_units")]), b, lookup).collect()
    assert sorted((r.method, r.bbl) for r in co) == [("bbl", 1000017501), ("bin", 1000010010), ("block", 1000017501)]
    people = wh.contacts(raw(spark, {"registrationid": "r", "bin": "1001", "lastregistrationdate": "2024-01-05"}), raw(spark, {"registrationid": "r", "contacttype": "Agent", "corporationname": "", "firstname": "A", "lastname": "B"}), lookup).collect()
    assert (people[0].role, people[0].name) == ("agent", "A B")
    p = wh.permits(raw(spark, {"borough": "MANHATTAN", "block": "1", "lot": "00010", "job_type": "A1", "latest_action_date": "01/05/2024", "initial_cost": "$1,234.00"}).select("*", *[F.lit("").alias(x) for x in ("job_description", "job_status_description", "existing_dwelling_units", "proposed_dwelling_units")])).collect()
    assert (p[0].bbl, p[0].estimated_cost, str(p[0].action_date)) == (1000010010, 1234.0, "2024-01-05")
    s = wh.slug_buildings(raw(spark, {"value": "1-main-street-new_york?x"}, {"value": "nope"}), b).collect()
    assert [(r.slug, r.bbl) for r in s] == [("1-main-street-new_york", 1000010010)]


def test_equal_lots_of_a_key_have_one_winner(spark):
    """Rows that agree in units and address: the same one wins in whatever order they arrive."""
    lot = lambda owner, tax: Row(bbl="1000010001", borough="MN", address="1 Main", zipcode="10001", bldgclass="A", yearbuilt="1930", numfloors="2", unitsres="7", unitstotal="8", ownername=owner, assesstot=tax, resarea="700", latitude="40.5", longitude="")
    lots = [lot("Cy", "5"), lot("Al", "9"), lot("Bo", "1"), lot("Al", "3")]
    won = [wh.buildings(spark.createDataFrame(x).coalesce(1)).first() for x in (lots, lots[::-1], lots[2:] + lots[:2])]
    assert {(r.owner_name, r.assessed_total) for r in won} == {("Al", 3.0)}
