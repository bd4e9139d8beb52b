"""Pages are read with each part of them parsed once a row, and dealt over all cores."""

import pytest
from pyspark.sql import functions as F

from lotlens.functions.clean import parse_display_date
from lotlens.operators import embedded, pages
from lotlens.plans import catalog


def times(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count(what)


@pytest.mark.parametrize("name", ["data_layers", "building_records", "listing_histories", "table_history", "embedded_records"])
def test_pages_of_a_small_table_are_dealt_over_all_cores(spark, name):
    assert "Repartition" in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_a_value_named_often_is_computed_once(spark):
    page = spark.createDataFrame([("x",)], "html string").repartition(2)
    layer = page.select(embedded.layer_record(F.col("html")).alias("r")).select("r.price", "r.beds", "r.status")
    assert 1 <= times(layer, "from_json") + times(layer, "jsontostructs") <= 2
    assert times(page.select(pages.building_record(F.col("html")).alias("r")).select("r.owner", "r.amenities"), "__next_f") == 1
    assert times(page.select(parse_display_date(F.col("html")).alias("d")), "regexp_extract") == 1
    history = page.select(embedded.past_listings(F.col("html")).alias("h"))
    assert times(history, "$.closingdate") == 1 and times(history, "$.pastlistings") == 1
