import os
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lotlens.operators import lattice
from lotlens.operators import upsert as up
from lotlens.operators.ranges import halved_ranges
from lotlens.sources import io
from lotlens.sources.versioned import VersionedTable

SCHEMA = "source string, id bigint, v double"
ORDER = [F.desc("v")]


def new_table(spark, tmp_path):
    part = F.coalesce(F.ascii("source"), F.lit(-1))
    return VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["source", "id"], part=part, bucket=F.col("id") % 4)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(table, version=None):
    return {(r.part, r.bucket): r.at for r in table.parts(version).collect()}


def on_disk(tmp_path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "t" / "data") for f in names if f.endswith(".parquet")}


def test_versions_are_whole_and_untouched_parts_keep_their_files(spark, tmp_path):
    t = new_table(spark, tmp_path)
    assert t.versions() == [] and rows_of(t.read()) == []
    base = [(s, i, float(i)) for s in "ab" for i in range(8)] + [("001", 1, 0.0)]
    assert t.upsert(frame(spark, *base), ORDER) == {"version": 1, "rows": 17, "new": 17, "updated": 0}
    before, kept = files(t), on_disk(tmp_path)
    assert t.upsert(frame(spark, ("a", 1, 50.0), ("a", 1, 9.0), ("a", 9, 1.0), ("c", 2, 2.0)), ORDER) == {"version": 2, "rows": 4, "new": 2, "updated": 1}
    after = files(t)
    assert {k for k in after if after[k] != before.get(k)} == {(97, 1), (99, 2)}
    assert {k: v for k, v in on_disk(tmp_path).items() if k in kept} == kept  # nothing was written anew
    want = [r for r in base if r[:2] != ("a", 1)] + [("a", 1, 50.0), ("a", 9, 1.0), ("c", 2, 2.0)]
    assert rows_of(t.read()) == sorted(want, key=repr) and rows_of(t.read(1)) == sorted(base, key=repr)
    assert t.reset_source(ord("b"), "b")["rows"] == 0
    assert rows_of(t.read()) == sorted((r for r in want if r[0] != "b"), key=repr) and not {k for k in files(t) if k[0] == 98}


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    t = new_table(spark, tmp_path)
    t.upsert(frame(spark, ("a", 1, 1.0), ("a", 2, 2.0)), ORDER)
    torn = frame(spark, ("a", 1, 5.0)).withColumn("v", F.when(F.col("id") == 1, F.raise_error(F.lit("torn")).cast("double")))
    with pytest.raises(Exception, match="torn"):
        t.upsert(torn, ORDER)
    assert t.versions() == [1] and rows_of(t.read()) == [("a", 1, 1.0), ("a", 2, 2.0)]
    os.makedirs(tmp_path / "t" / "versions" / "2")  # a version that was begun and never finished counts for nothing
    assert t.versions() == [1] and rows_of(t.read()) == [("a", 1, 1.0), ("a", 2, 2.0)]
    with pytest.raises(Exception, match="(?i)exists"):  # and stands in the way of a writer that does not know it
        t.upsert(frame(spark, ("a", 3, 3.0)), ORDER)
    os.rmdir(tmp_path / "t" / "versions" / "2")
    assert t.upsert(frame(spark, ("a", 3, 3.0)), ORDER)["version"] == 2


def test_inserts_backfill_nulls_and_nothing_to_do(spark, tmp_path):
    t = new_table(spark, tmp_path)
    assert t.upsert(frame(spark), ORDER) == {"version": 0, "rows": 0, "new": 0, "updated": 0}
    t.upsert(frame(spark, ("a", 1, 1.0), ("b", 2, None)), ORDER)
    assert t.insert_first_wins(frame(spark, ("a", 1, 9.0), ("a", 5, 5.0)), ORDER)["new"] == 1
    assert t.insert_last_wins(frame(spark, ("a", 5, 6.0)), ORDER)["updated"] == 1
    assert rows_of(t.read()) == [("a", 1, 1.0), ("a", 5, 6.0), ("b", 2, None)]
    s = VersionedTable(spark, str(tmp_path / "s"), "id bigint, area string", ["id"])
    s.upsert(spark.createDataFrame([(1, ""), (2, "kept"), (3, None)], "id bigint, area string"), [F.col("area")])
    assert s.backfill_if_empty(spark.createDataFrame([(1, "one"), (2, "two")], "id bigint, area string"), ["id"], "area")["updated"] == 1
    assert rows_of(s.read()) == [(1, "one"), (2, "kept"), (3, None)]


def test_a_tracked_pull_counts_new_and_updated(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "l"), "source string, source_id string, price double, status string, first_seen timestamp, last_seen timestamp", ["source", "source_id"], part=F.ascii("source"))
    pull = lambda *rows: spark.createDataFrame(list(rows), "source_id string, price double")
    assert t.track(pull(("1", 5.0), ("2", 6.0)), 97, "a", "2024-01-01 00:00:00")["new"] == 2
    assert t.track(pull(("9", 5.0)), 98, "b", "2024-01-01 00:00:00")["new"] == 1
    done = t.track(pull(("1", 7.0), ("3", 1.0)), 97, "a", "2024-01-02 00:00:00")
    assert (done["new"], done["updated"]) == (1, 1)
    got = {(r.source, r.source_id): (r.price, r.status, r.first_seen.day, r.last_seen.day) for r in t.read().collect()}
    assert got == {("a", "1"): (7.0, "active", 1, 2), ("a", "2"): (6.0, "inactive", 1, 1), ("a", "3"): (1.0, "active", 2, 2), ("b", "9"): (5.0, "active", 1, 1)}


def test_counts_come_from_the_writing_plan(spark, tmp_path):
    rows = spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    log = up.observed_run(lambda df: df.write.parquet(str(tmp_path / "o")), rows, F.col("odd"), "p", "2024-01-01 00:00:00")
    assert tuple(log.select("processed", "inserted").first()) == (100, 50) and spark.read.parquet(str(tmp_path / "o")).count() == 100
    assert io.write_table(rows, str(tmp_path / "w"), ["odd"]) == 100 and io.write_table(rows.filter("id < 0"), str(tmp_path / "e")) == 0


def brute_ranges(values, ranges, cap, least, open_width):
    out, todo = [], list(ranges)
    while todo:
        lo, hi = todo.pop()
        n = sum(1 for v in values if v is not None and (lo is None or v >= lo) and (hi is None or v < hi))
        low = lo or 0
        high = hi if hi is not None else (low * 3 if low > 0 else open_width)
        if n >= cap and high - low >= max(2, least):
            mid = (low + high) // 2
            todo += [(lo, mid), (mid, hi)]
        else:
            out.append((lo, hi, n, n < cap))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_ranges_are_halved_until_they_fit(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([int(rng.lognormvariate(8, 1.5)), 777, None, rng.randint(-50, 90_000)]) for _ in range(700)] + [777] * 60
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for ranges, cap, least in (([(None, 1500), (1500, 8000), (8000, None)], 20, 50), ([(None, None)], 30, 1), ([(0, 100)], 5, 10_000)):
        got = sorted((tuple(r) for r in halved_ranges(df, "v", ranges, cap, least, 50_000).collect()), key=repr)
        assert got == brute_ranges(values, ranges, cap, least, 50_000)
    assert [tuple(r) for r in halved_ranges(df.filter("false"), "v", [(1, None)], 5, 1, 10).collect()] == [(1, None, 0, True)]


def test_lattice_of_all_subsets(spark):
    rng = random.Random(1)
    names = [f"s{k}" for k in range(10)]
    rows = [(key, rng.choice([*names, None]), rng.random() < 0.1) for key in range(60) for _ in range(rng.randint(1, 14))]
    df = spark.createDataFrame(rows, "key int, s string, hit boolean")
    table = lattice.mask_table(lattice.key_masks(df, "key", {n: F.col("s") == n for n in names}, F.col("hit")))
    sets = {k: ({s for key, s, _ in rows if key == k and s}, any(h for key, _, h in rows if key == k)) for k in range(60)}
    total = sum(h for _, h in sets.values()) / 60
    want = {}
    for size in range(11):
        for combo in combinations(names, size):
            c = set(combo)
            at, exact = [h for s, h in sets.values() if c <= s], [h for s, h in sets.values() if c == s]
            if at:
                want["+".join(combo)] = (size, len(at), sum(at), len(exact), sum(exact), round(sum(at) / len(at), 6), round(sum(at) / len(at) / total, 4))
    assert {r.combo: tuple(r)[1:] for r in lattice.signal_lattice(table, names).collect()} == want
    assert {r.least: r["keys"] for r in lattice.stacked_rates(table, (0, 3)).collect()} == {0: 60, 3: sum(len(s) >= 3 for s, _ in sets.values())}
    with pytest.raises(ValueError):
        lattice.key_masks(df, "key", {}, F.col("hit"))
