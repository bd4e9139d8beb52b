import pytest
from pyspark.sql import functions as F

from lotlens.plans.build import Table, build_tables


def test_finished_tables_are_not_made_again(spark, tmp_path):
    sources = {n: str(tmp_path / n) for n in ("a", "b")}
    for n, p in sources.items():
        spark.range(5).withColumn("n", F.lit(n)).write.parquet(p)
    broken = []

    def torn(frames):
        if not broken:
            broken.append(1)
            raise RuntimeError("broken off")
        return frames["x"].union(frames["b"])

    tables = {
        "y": Table(("x", "b"), torn),
        "x": Table(("a",), lambda f: f["a"].filter("id > 1")),
        "z": Table(("b",), lambda f: f["b"]),
        "sum": Table(("y", "z"), lambda f: f["y"].agg(F.count("*").alias("n")).union(f["z"].agg(F.count("*")))),
    }
    with pytest.raises(RuntimeError):
        build_tables(spark, str(tmp_path / "out"), sources, tables)
    made = lambda: {n: (b.made, b.rows) for n, b in build_tables(spark, str(tmp_path / "out"), sources, tables).items()}
    assert made() == {"x": (False, None), "y": (True, 8), "z": (True, 5), "sum": (True, 2)}  # x was finished before the break
    assert made() == {n: (False, None) for n in tables}
    spark.range(3).withColumn("n", F.lit("a")).write.mode("append").parquet(sources["a"])
    after = build_tables(spark, str(tmp_path / "out"), sources, tables)
    assert {n: b.made for n, b in after.items()} == {"x": True, "y": True, "z": False, "sum": True}
    assert sorted(r.n for r in spark.read.parquet(after["sum"].folder).collect()) == [5, 9]
    marked = tables | {"z": Table(("b",), lambda f: f["b"].limit(1), mark="2")}
    assert {n for n, b in build_tables(spark, str(tmp_path / "out"), sources, marked).items() if b.made} == {"z", "sum"}
    with pytest.raises(ValueError):
        build_tables(spark, str(tmp_path / "out"), sources, {"p": Table(("q",), None), "q": Table(("p",), None)})
