import json
import re
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from lotlens.functions import address
from lotlens.operators import embedded, joins, pages
from lotlens.operators.embedded import balanced_values
from lotlens.sources import io


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "h string").select(column(F.col("h")).alias("x")).first().x


def test_values_end_where_their_brackets_do():
    found = lambda text, opening='"a":', **k: balanced_values(text, re.compile(opening), **k)
    assert found('x "a":{"b":["}",{"c":"\\"]"}]} "a":[1,[2]] "a":"t\\"u" "a":7') == ['{"b":["}",{"c":"\\"]"}]}', "[1,[2]]", '"t\\"u"']
    assert found('"a":[1,[2] "a":{"b":1}') == ['{"b":1}']  # the first never closes
    assert found('"a":{"b":1] "a":[2]') == ["[2]"]  # the wrong bracket
    assert found('"a":"open "a":[') == ['"open "']
    assert found('"a":[{"a":[1]}]') == ['[{"a":[1]}]'] and found('"a":[{"a":[1]}]', inner=True) == ['[{"a":[1]}]', "[1]"]
    assert found(None) == found("") == []


def test_scanning_is_linear_in_unclosed_values():
    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        assert balanced_values('"a":[' * n, re.compile('"a":')) == []
        assert len(balanced_values('"a":[' * n + "]" * n, re.compile('"a":'), inner=True)[-1]) == 2
        took.append(time.process_time() - start) if n == 20_000 else None
        if n == 80_000:
            break
    deep = "[" * 50_000 + "]" * 50_000
    assert balanced_values(f'"a":{deep}', re.compile('"a":')) == [deep]


def test_layer_with_lists_of_objects_and_falsy_fields(spark):
    page = '<script>dataLayer = [{"a":1}]; dataLayer.push({"x":[{"price":1}]}); dataLayer.push({"property":{"price":0,"listingPrice":"1,200","beds":null,"lat":"n/a"},"numBedrooms":2,"all":[{"q":["}"]}]})</script>'
    got = one(spark, page, embedded.layer_record)
    assert (got.price, got.beds, got.latitude, got.status) == (1200.0, 2.0, None, None)
    assert json.loads(got.raw)["all"] == [{"q": ["}"]}]
    assert one(spark, "<p>", embedded.layer_record).raw is None and one(spark, None, embedded.layer_record).price is None
    assert one(spark, page, lambda h: pages.data_layer(h, ("nothing",))) is None


def test_history_with_a_list_inside_an_event(spark):
    page = '{"priceHistory":[{"date":"1/5/2024","price":"$5","event":"sold","tags":["a",["b"]]}],"price_history":[{"date":"soon"}]}'
    assert [(r.event_date, r.event_type, r.price) for r in one(spark, page, embedded.past_listings)] == [("2024-01-05", "sold", 5.0), ("soon", None, None)]
    assert [tuple(r) for r in one(spark, page, pages.price_history)] == [("1/5/2024"[:0] or "2024-01-05", 5.0, "sold"), ("soon", None, None)]
    props = '"PastListingsExperience" : {"a":[],"listings":[{"price":1}],"history":[{"price":2}]}'
    assert [r.price for r in one(spark, props, embedded.past_listings)] == [1.0, 2.0]
    assert [r.price for r in one(spark, '[[{"a":1}],[ {"event":"x","price":3}]]', embedded.past_listings)] == [3.0]
    assert one(spark, '"pastListings":[', embedded.past_listings) == [] and one(spark, None, embedded.past_listings) == []


def test_building_record_of_a_real_layout(spark):
    text = '{"amenities":{"list":["gym"]},"unitFeatures":[{"name":"Oven"}],"d":{"owner":"UNAVAILABLE OWNER","developer":"Dev"},"policies":[{"a":1},{"petPolicy":[1]}],"description":"<p>Long enough to be told.</p>\\n","x":1}'
    got = one(spark, text, embedded.listing_record)
    assert (got.amenities, got.unit_features, got.owner, got.developer, got.pet_policy, got.description) == (["gym"], ["Oven"], None, "Dev", '{"petPolicy":[1]}', "Long enough to be told.")
    empty = one(spark, "", embedded.listing_record)
    assert empty.amenities is None and empty.sale_inventory is None or empty.sale_inventory == []


def test_script_chunks_are_unescaped_once(spark):
    page = 'self.__next_f.push([1,"{\\"a\\":\\"x\\\\\\"y\\"}"])self.__next_f.push([1,"\\u003cb\\u003e"])self.__next_f.push([1,"bad \\q \\"z"])'
    assert one(spark, page, pages.embedded_text) == '{"a":"x\\"y"}<b>bad \\q "z'


def test_each_index_file_has_its_own_header(spark, tmp_path):
    for name, rows in (("a", [["timestamp", "original"], ["1", "u1"]]), ("b", [["original", "timestamp"], ["u2", "2"], ["short"]]), ("c", [["x", "y"], ["3", "u3"]]), ("d", [["timestamp", "original"]])):
        (tmp_path / name).write_text(json.dumps(rows))
    assert sorted(tuple(r) for r in io.scan_archive_index(spark, str(tmp_path), "arrays").collect()) == [("1", "u1"), ("2", "u2"), ("3", "u3")]


def test_http_and_https_are_one_link(spark):
    rows = spark.createDataFrame([("http://a.com/x/?q",), ("https://a.com/x#y",), ("/http://z/",), (None,)], "u string")
    assert [r.x for r in rows.select(address.canonical_url(F.col("u")).alias("x")).collect()] == ["https://a.com/x", "https://a.com/x", "/http://z", None]


def test_a_table_inside_a_cell_keeps_the_outer_row(spark):
    page = "<table><tr><td>1/5/2024<td>Sold <table><tr><td>in</td><td>z</td></tr></table> today</td><td>$5</td></tr></table><table><tr><td>open"
    got = pages.table_cells(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h").collect()
    assert sorted((r.row, list(r.cells)) for r in got) == [(0, ["1/5/2024", "Sold in z today", "$5"]), (0, ["in", "z"])]


def test_interval_match_of_one_busy_key(spark):
    """Each day is added to the frame once: forty thousand days of one key."""
    days = spark.range(40_000).select(F.lit(1).alias("k"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    start = time.time()
    got = joins.event_within(days, days.select("k", F.col("d").alias("o")).filter("day(o) = 1"), "k", "d", "o", (1, 31)).agg(F.count_if("within_1"), F.count_if("within_31")).first()
    assert got[0] > 2000 and got[1] >= 39_900 and time.time() - start < 30


def test_joins_on_texts_carry_them_once(spark):
    texts = spark.createDataFrame([Row(i=1, t="Big red Barn"), Row(i=2, t="redder"), Row(i=1, t="Big red Barn"), Row(i=3, t=None)])
    words = spark.createDataFrame([("red", 1), ("barn", 2), ("red", 3)], "w string, n int")
    assert sorted((r.i, r.w, r.n) for r in joins.contains_join(texts, "t", words, "w").collect()) == [(1, "barn", 2)] * 2 + [(1, "red", 1)] * 2 + [(1, "red", 3)] * 2
    plan = joins.phrase_join(texts, "t", words, "w", max_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    explode = next(line for line in plan.split("\n") if "Generate explode" in line)
    assert "t#" not in explode.split("[", 2)[-1].split("]")[-1]


def test_variant_fields_of_torn_records(spark):
    rows = spark.createDataFrame([('{"a":{"b":[1,{"c":"x"}]},"n":"7"}',), ('{"a"',), (None,)], "j string")
    got = io.flatten_variant(rows, "j", {"c": ("$.a.b[1].c", "string"), "n": ("$.n", "int"), "z": ("$.z", "string")})
    assert [tuple(r) for r in got.collect()] == [("x", 7, None), (None, None, None), (None, None, None)]
