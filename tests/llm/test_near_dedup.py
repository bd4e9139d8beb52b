import random
import re
from itertools import combinations

import pytest
from pyspark.sql import Row

from lotlens.llm import near_dedup
from lotlens.llm.components import connected_components
from lotlens.llm.near_dedup import near_duplicates, sketch_cut


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    line = " ".join(word() for _ in range(9))
    texts = [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f", "x " * 4000]
    for g in range(25):
        base = [word() for _ in range(rng.randint(30, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(60):
        texts.append(line + " " + " ".join(word() for _ in range(rng.randint(1, 60))))
    hot = [word() for _ in range(90)]
    for _ in range(90):
        copy = list(hot)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(90)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(hot)] * 40
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(1000 + d, texts[i]) for d, i in enumerate(order)]


@pytest.mark.parametrize(("percent", "node"), [(85, 400), (80, 12)])
def test_against_all_pairs(spark, monkeypatch, percent, node):
    """With 12 members a node or cluster, the large groups branch, are chunked and meet leaders."""
    monkeypatch.setattr(near_dedup, "NODE", node)
    monkeypatch.setattr(near_dedup, "CLUSTER", node)
    rows = corpus()
    df = spark.createDataFrame([Row(doc_id=d, text=t) for d, t in rows]).selectExpr("*", "1 as cls", "2 as grp", "3 as size", "4 as row_key", "5 as label")
    got = near_duplicates(df, percent=percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, "q r s"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((near_duplicates(df).select("doc_id", "component_id", "kept").collect()), key=str)
    assert len(got) == 6 and [tuple(r) for r in got if r.doc_id == 1] == [(1, 1, True)] * 2
    assert (None, 1, False) in [tuple(r) for r in got] and (7, 7, True) in [tuple(r) for r in got]
    assert near_duplicates(df.filter("false")).count() == 0


def test_rows_with_one_id_are_one_document(spark):
    a, c = " ".join(f"a{k}" for k in range(60)), " ".join(f"c{k}" for k in range(60))
    rows = [(5, a), (5, c), (1, a + " x"), (9, c + " y"), (20, None), (20, c + " z"), (30, ""), (30, "alone it stands"), (40, "nothing near")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 9 and {(r.doc_id, r.component_id) for r in got} == {(5, 1), (1, 1), (9, 1), (20, 1), (30, 30), (40, 40)}
    assert [r.n_shingles for r in got if r.doc_id == 20 and r.class_size == 0] == [0]


def test_many_rows_without_an_id_and_ids_of_any_type(spark):
    copies = [(None, "one text that stands in very many rows without an id")] * 3000 + [(4, "one text that stands in very many rows without an id at all")]
    got = near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), percent=70).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got), key=str) == [(4, 4, 1), (None, 4, 3000)]
    named = spark.createDataFrame([("b", "x y z"), ("a", "X y  z"), ("c", None)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(named).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {(r.doc_id.n, r.component_id.n) for r in near_duplicates(named.selectExpr("struct(doc_id as n, 1 as m) as doc_id", "text")).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_sketch_cut_keeps_pairs_at_the_threshold():
    assert 60 < sketch_cut(85) < 100 and sketch_cut(80) < sketch_cut(85)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.label for r in got if r.node < 1000} == {0} and {r.label for r in got if r.node >= 1000} == {1000} and len(got) == 501


def test_pages_of_one_template_are_branched_by_their_rare_shingles(spark, monkeypatch):
    """Hundreds of pages share most of their words under the threshold; among them are copies and a second large group."""
    monkeypatch.setattr(near_dedup, "NODE", 40)
    monkeypatch.setattr(near_dedup, "CLUSTER", 20)
    calls, buckets = [], near_dedup.rare_buckets
    monkeypatch.setattr(near_dedup, "rare_buckets", lambda *x: calls.append(1) or buckets(*x))
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(160)]
    texts = [" ".join(template + [word() for _ in range(38)]) for _ in range(150)]
    texts += [t + " " + word() for t in texts[:60:2]]
    second = template + [word() for _ in range(38)]
    texts += [" ".join(second[:-1] + [word()]) for _ in range(50)]
    third = template + [word() for _ in range(40)]
    texts += [" ".join(third[:-2] + [word()]) for _ in range(70)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 500))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 85) and calls
