import re

import pytest
from pyspark.sql import Row

import corpus_pipeline
from lotlens.llm.pii import base_spans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage on the small tables, written and read again."""
    out, read = tmp_path_factory.mktemp("steps"), f"{SF}/documents.parquet"
    done = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(read)
        stage(spark, docs, SF).write.parquet(read := f"{out}/{i}")
        done.append((name, docs.collect(), spark.read.parquet(read).collect()))
    return done


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t.lower())


def test_columns_and_names(steps, spark):
    assert len(steps) == 5
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(out[0].asDict().keys() == set(columns) for _, _, out in steps[:-1])


def test_quality_drops_the_bad_and_keeps_the_good(steps, spark):
    _, given, out = steps[0]
    kept = {r.doc_id for r in out}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)
    assert {(r.doc_id, r.text) for r in out} <= {(r.doc_id, r.text) for r in given}


def test_dedup_keeps_the_smallest_of_each_group(steps):
    _, given, out = steps[1]
    sets = {}
    for r in given:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    by_shingle, root = {}, {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in sorted(sets):
        near = {x for g in sets[d] for x in by_shingle.get(g, ())}
        for x in near:
            if 100 * len(sets[d] & sets[x]) >= 80 * len(sets[d] | sets[x]):
                a, b = sorted((find(d), find(x)))
                root[b] = a
        for g in sets[d]:
            by_shingle.setdefault(g, []).append(d)
    assert {r.doc_id for r in out} == {find(d) for d in sets}


def test_contaminated_documents_go(steps, spark):
    _, given, out = steps[2]
    low = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) + " "
    items = [low(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in given if not any(i in low(r.text) for i in items)}
    assert {r.doc_id for r in out} == clean and len(clean) < len(given)


def test_personal_data_is_gone(steps):
    _, given, out = steps[3]
    assert {r.doc_id for r in out} == {r.doc_id for r in given}
    assert any(base_spans(r.text) for r in given) and not any(base_spans(r.text) for r in out)
    assert all(r.n_chars == len(r.text) for r in out)


def test_packing_holds_every_document(steps):
    _, given, out = steps[4]
    assert {r.doc_id for r in out} == {r.doc_id for r in given}
    filled = {}
    for r in out:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024 and len(filled) <= 1.02 * sum(filled.values()) / 1024 + 1


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    rows = [Row(doc_id=1, text=None), Row(doc_id=2, text=""), Row(doc_id=None, text="a b c d e f"), Row(doc_id=None, text=None), Row(doc_id=3, text="a b c d e f"), Row(doc_id=3, text="a b c d e f"), Row(doc_id=4, text="mail a@b.co " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "cast(null as string) as source", "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4, None} and sum(r.doc_id is None for r in out) == 1 and sum(r.doc_id == 3 for r in out) == 1
    (tmp_path / "empty").mkdir()
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").filter("false").write.parquet(f"{tmp_path}/empty/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def good_text(spark, n, seed):
    """Texts of the small tables that the labels call good and that hold no item of the benchmark."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels.filter("quality = 1"), "doc_id").filter("n_chars > 400").select("doc_id", "text").orderBy("doc_id").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return [r.text for r in rows if not any(i in r.text for i in items)][seed : seed + n]


def test_rows_are_judged_one_by_one_whatever_their_ids(spark):
    """Rows without an id and different rows with one id go or stay by their own texts, in every filtering stage."""
    a, b, c, d = good_text(spark, 4, 11)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    bad = "$$$ ### buy now $$$ " * 60
    rows = [(None, a), (None, bad), (5, b), (5, bad), (5, c), (None, item), (5, d + " " + item), (None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'es' as lang", "cast(null as string) as source", "cast(length(text) as long) as n_chars")
    clean = sorted(map(tuple, corpus_pipeline.decontaminate(spark, docs, SF).select("doc_id", "text").collect()), key=str)
    assert clean == sorted([r for r in rows if not (r[1] or "").endswith(item)], key=str)
    copies = docs.union(docs).union(docs.selectExpr("9 as doc_id", "text", "lang", "source", "n_chars").filter("text is not null"))
    left = sorted(map(tuple, corpus_pipeline.dedup(spark, copies, SF).select("doc_id", "text").collect()), key=str)
    # the least id of each text; rows without a text are near to nothing
    assert left == sorted([(9, a), (5, bad), (5, b), (5, c), (9, item), (5, d + " " + item), (None, None), (None, None), (7, None), (7, None)], key=str)


def test_quality_judges_texts_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    nameless = corpus_pipeline.quality(spark, docs.union(docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")), SF)
    assert sum(r.doc_id is not None for r in nameless.collect()) == pytest.approx(len(kept), rel=0.02) and nameless.filter("doc_id is null").count() == pytest.approx(len(kept), rel=0.02)
