import json

from pyspark.sql.datasource import EqualTo, GreaterThan
from pyspark.sql.types import StructType

from lotlens.sources import paged

ADAPTER = "lotlens.sources.paged:JsonFolder"


def pages(tmp_path, *batches):
    for n, rows in enumerate(batches):
        (tmp_path / f"p{n}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")


def test_filters_and_columns_reach_the_pages(spark, tmp_path):
    pages(tmp_path, [{"a": 1, "b": "x", "c": [1]}, {"a": 2, "b": "y"}], [{"a": 3, "b": "x"}], [])
    reader = paged.PagedReader({"adapter": ADAPTER, "path": str(tmp_path)}, StructType().add("a", "long").add("z", "string"))
    left = list(reader.pushFilters([EqualTo(("b",), "x"), GreaterThan(("a",), 1), EqualTo(("b",), "q"), EqualTo(("s", "t"), 1), EqualTo(("a",), 1.5)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "EqualTo", "EqualTo", "EqualTo"] and reader.equal == {"b": "x"}
    parts = reader.partitions()
    # each page is read by itself, and again with the same rows
    assert [list(reader.read(p)) for p in parts] == [list(reader.read(p)) for p in parts] == [[(1, None)], [(3, None)], []]
    paged.register(spark)
    df = spark.read.format("pages").option("adapter", ADAPTER).option("path", str(tmp_path)).schema("a long, b string").load()
    assert df.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in df.filter("b = 'x' and a > 1").collect()] == [(3, "x")] and df.filter("b is null").count() == 0
    assert spark.read.format("pages").option("adapter", ADAPTER).option("path", str(tmp_path)).option("columns", "a long").load().count() == 3


def test_a_resumed_stream_reads_new_pages_only(tmp_path):
    pages(tmp_path, [{"a": 1}], [{"a": 2}])
    stream = paged.PagedStream({"adapter": ADAPTER, "path": str(tmp_path)}, StructType().add("a", "long"))
    end = stream.latestOffset()
    assert stream.initialOffset() == {"pages": 0} and end == {"pages": 2}
    pages(tmp_path, [{"a": 1}], [{"a": 2}], [{"a": 3}])
    assert [r for p in stream.partitions(end, stream.latestOffset()) for r in stream.read(p)] == [(3,)]
