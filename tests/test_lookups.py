import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import gram_index
from lotlens.operators.bucketed import BucketedStar, Kind, write_bucketed
from lotlens.operators.gram_index import GramIndex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def names():
    rng = random.Random(8)
    words = ["Main", "ELM", "Ünter", "st", "5%", "a_b", "Park Ave", "'Q'", "12", "日本", "aaa"]
    return [(k, None if k == 5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))), k % 7) for k in range(200)] + [(3, "Main again", 1)]


@pytest.fixture(scope="module")
def index(spark, names, tmp_path_factory):
    df = spark.createDataFrame(names, "id long, address string, units int")
    return GramIndex.build(df, "id", "address", str(tmp_path_factory.mktemp("i") / "x"), ["units"], folders=16)


def test_fragments_of_one_to_twenty_signs(spark, names, index):
    texts = {t.lower() for _, t, _ in names if t}
    rng = random.Random(2)
    fragments = ["a", "%", "_", "ünter ", "日", "aa", "AAA A", "'q'", "zz", "main main main main main"]
    for n in range(1, 21):
        t = rng.choice([t for t in texts if len(t) >= n])
        at = rng.randrange(len(t) - n + 1)
        fragments.append(t[at : at + n].upper())
    want = {f: sorted((i, u) for i, t, u in names if t and f.lower() in t.lower()) for f in fragments}
    for f in fragments[:10] + fragments[10::4]:
        assert sorted((r.id, r.units) for r in index.search(f).collect()) == want[f], f
    asked = spark.createDataFrame([(f,) for f in [*fragments, "", None]], "f string")
    got = index.search_many(asked, "f").collect()
    assert {f: sorted((r.id, r.units) for r in got if r.f == f) for f in fragments} == want and {r.f for r in got} <= set(fragments)


def test_a_search_reads_one_folder_and_shuffles_nothing(index):
    found = index.search("park av")
    p = plan(found)
    assert "Exchange " not in p and "Python" not in p and "EqualTo(gram," in p
    assert len(found.collect()) > 0 and len({f.split("folder=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    with pytest.raises(ValueError):
        index.search("")


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    s = BucketedStar(spark, str(tmp_path_factory.mktemp("b")), "k", 8)
    s.add("base", spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")))
    rows = spark.range(600).select((F.col("id") % 40).alias("k"), "id", F.when(F.col("id") % 9 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 900).cast("int"))).alias("day"), (F.col("id") % 13).alias("c"))
    return s.add("rows", rows, ["day"])


def test_a_star_of_buckets_needs_no_exchange(spark, star):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = star.star("base", {"rows": {"n": F.count("*"), "last": F.max("day")}})
        assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
        got = {r.k: r.n for r in out.collect()}
        assert got == {k: 15 if k < 40 else None for k in range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_one_key_is_read_from_one_bucket(star):
    kind = Kind(F.col("day"), [F.col("id")], {"id": F.col("id")}, 4, F.col("c"))
    kinds = {"odd": ("rows", F.col("id") % 2 == 1, kind), "all": ("rows", F.lit(True), Kind(F.col("day"), [F.col("id")], {"id": F.col("id")}))}
    one = star.records(kinds, key=7)
    assert "SelectedBucketsCount: 1 out of 8" in plan(one)
    rows = [(i, (i * 7 % 900) if i % 9 else None) for i in range(600) if i % 40 == 7]
    rows.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.pos, r.record) for r in one.filter("kind = 'all'").orderBy("pos").collect()] == [(n, f'{{"id":{i}}}') for n, (i, _) in enumerate(rows, 1)]
    assert one.filter("kind = 'odd'").count() == 4  # all of key 7 are odd, four are shown
    stats = {(r.measure, r.value): r.n for r in star.statistics({"all": ("rows", F.lit(True), kind)}, key=7, top=2).collect()}
    assert stats["total", None] == 15 and sum(n for (m, _), n in stats.items() if m == "year") == sum(d is not None for _, d in rows) and sum(m == "category" for m, _ in stats) == 2


def test_buckets_are_one_file_each(spark, tmp_path):
    t = write_bucketed(spark.range(1000).withColumnRenamed("id", "k"), str(tmp_path / "t"), "k", buckets=4)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 4 and t.count() == 1000


def test_rows_of_one_text_share_their_postings_and_pairs_are_dealt(spark, tmp_path):
    df = spark.createDataFrame([(k, f"{'Large' if k % 3 else 'small'} ring {k % 2}", k % 7) for k in range(600)], "id long, address string, units int")
    index = GramIndex.build(df, "id", "address", str(tmp_path / "x"), ["units"], folders=4)
    assert spark.read.parquet(f"{index.path}/postings").filter("gram = 'rin'").count() <= 4 * df.rdd.getNumPartitions()
    assert sum(r.n for r in index._read("counts", "n bigint").filter("gram = 'rin'").collect()) == 600
    assert index.search("LARGE").columns == ["id", "text", "units"] and index.search("large").count() == 400
    asked = spark.createDataFrame([(k, ["ring", "SMALL", "zz", "", None][k % 5]) for k in range(50)] + [(0, "ring")], "who int, f string")
    got = index.pairs(asked, "f")
    assert sorted((r.who, r.id) for r in got.collect()) == sorted((w, i) for w, f in [(r.who, r.f) for r in asked.collect()] if f for i in range(600) if f == "ring" or (f == "SMALL" and i % 3 == 0))
    spread = got.rdd.glom().map(len).filter(lambda n: n > 0).collect()
    assert len(spread) >= 4 and got.columns == ["who", "f", "id"]  # two fragments, and more tasks that make pairs


def test_pairs_are_made_of_one_asker_and_one_block_at_a_time(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, f"ring {k % 3}") for k in range(900)], "id long, address string")
    index = GramIndex.build(df, "id", "address", str(tmp_path / "x"), folders=4)
    asked = spark.createDataFrame([(k, "RING" if k % 2 else "1") for k in range(300)] + [(300, None), (301, ""), (302, "zz")], "who int, f string")
    monkeypatch.setattr(gram_index, "MEET", 20, raising=False)
    got = index.pairs(asked, "f")
    above = plan(got).split("SortMergeJoin")[0]
    assert above.count("Generate") == 1 and "inline" not in plan(got).split("FileScan")[0]  # askers are rows as they meet
    assert got.count() == 150 * 900 + 150 * 300 and got.distinct().count() == got.count() and got.filter("who >= 300").count() == 0
    assert plan(got).count(str(4 * 45)) > 0  # 900 rows hold a gram: 45 deals of 20
