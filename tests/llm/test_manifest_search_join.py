import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lotlens.llm import lexical_search, manifest, metric_join
from lotlens.llm.lexical_search import lexical_search as search
from lotlens.llm.manifest import fold, merkle_manifest, proof_digest
from lotlens.llm.metric_join import jaccard_join
from lotlens.llm.near_dedup import shingle_sets

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# --- manifest ---------------------------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(hashes):
    """The root, and for each place the (before, behind) steps up to it."""
    steps, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            steps[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], steps


def brute_manifest(rows, tampered):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in by:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: climb([leaf(r) for r in by[s]]) for s in order}
    root, top = climb([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, steps in zip(by[s], trees[s][1], strict=True):
            path, folded = steps + top[k], leaf((*r[:4], tampered(r[4])))
            for a, b in path:
                folded = h(a + folded + b)
            out.append((r[0], leaf(r), trees[s][0], root, h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def proved(docs, tampered=None):
    df = merkle_manifest(docs, tampered)
    folded = fold(F.col("given_leaf"), F.col("steps"))
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")), folded, folded == F.col("root")).collect()), key=repr)


def table_rows():
    rng = random.Random(3)
    sizes = {"hot": 300, None: 17, "": 16, "é": 1, "z": 257, "a": 2}
    rows = [(rng.randrange(10**6), s, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Straße A", "plain", "Ünder Q"])) for s, n in sizes.items() for _ in range(n)]
    rows += [rows[0]] * 20 + [(None, "hot", None, None, "No id"), (None, "hot", None, None, None), (7, "hot", "a", 1, "T"), (7, "hot", "a", 1, "U")]
    rng.shuffle(rows)
    return rows


def test_manifest_equals_plain_hashing(spark, monkeypatch):
    rows = table_rows()
    lower = lambda t: t and t.translate({c: c + 32 for c in range(65, 91)})
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(manifest, "RANGE_ROWS", 60)
    assert proved(docs, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) == brute_manifest(rows, lower)
    assert all(r[-1] for r in proved(docs))


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_manifest_of_few_rows_and_clashing_columns(spark, n):
    rows = [(k, "s", "en", 3, "abc" * k) for k in range(n)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("tree", "lo", "hi", "steps", "digest", "leaf", "root", "kids", "n", "cell")])
    assert proved(docs) == brute_manifest(rows, lambda t: t)


def test_manifest_of_an_empty_table_and_a_long_text(spark):
    assert proved(spark.createDataFrame([], DOCS)) == []
    rows = [(1, "s", "en", 3, "é" * 2_000_000), (2, "s", None, None, None)]
    assert proved(spark.createDataFrame(rows, DOCS)) == brute_manifest(rows, lambda t: t)


def test_any_change_of_a_row_breaks_its_proof_alone(spark):
    rows = [(k, f"s{k % 3}", "en", 3, f"text {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    got = proved(docs, F.when(F.col("doc_id") == 31, "text 31 ").otherwise(F.col("text")))
    assert [r[0] for r in got if not r[-1]] == [31]


# --- search -----------------------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    for i, ws in wanted.items():
        scored = []
        for d, b in bags:
            n = sum(b.values())
            score = 0
            for w in ws & set(b):
                m = 100 - 50 + 50 * n * n_docs // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], start=1)]
    return sorted(out, key=repr)


def search_case():
    rng = random.Random(5)
    word = lambda: rng.choice(["Alpha", "beta", "gam-ma", "δelta", "x", "b2b", "the", "ÀB", "a_b", "ALPHA"])
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(150)]
    docs += [(None, "alpha beta"), (None, None), (500, None), (501, ""), (502, "alphabet alph ALPHA\x00beta\x7fx"), (503, "\U0001f600 the 日本語 x"), docs[3], docs[3]]
    items = [(1, "alpha beta"), (2, "The the the X"), (3, None), (4, "?!"), (None, "alpha"), (5, "unseen"), (6, "日本語 b2b"), (1, "gam"), (7, "a b ma"), (8, "ÀB δelta x"), (2, "The the the X")]
    return docs, items


@pytest.mark.parametrize("part", [1 << 21, 12])
def test_search_equals_plain_counting(spark, monkeypatch, part):
    docs, items = search_case()
    monkeypatch.setattr(lexical_search, "PART_BYTES", part)
    table = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("item_id"), F.lit("x").alias("term"), F.lit(2).alias("score")).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("doc_id"), F.lit(3).alias("part"))
    for k in (3, 50):
        assert sorted((tuple(r) for r in search(table, asked, k=k).select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_search(docs, items, k)


def test_search_of_empty_tables_and_a_long_text(spark):
    docs, items = search_case()
    none = lambda s: spark.createDataFrame([], s)
    some = spark.createDataFrame(items, "item_id long, text string")
    assert search(none("doc_id long, text string"), some).count() == 0
    assert search(spark.createDataFrame(docs, "doc_id long, text string"), none("item_id long, text string")).count() == 0
    long = [(1, "alpha beta " * 300_000), (2, "beta")]
    got = search(spark.createDataFrame(long, "doc_id long, text string"), some)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_search(long, items, 50)


def test_best_rows_keep_ties_by_id():
    best = lexical_search.BestRows(2, 2)
    best.room = 3
    for item, score, doc in [(0, 5, 9), (0, 5, 3), (0, 5, 4), (1, 1, 1), (0, 5, 2), (0, 4, 1)]:
        best.add(np.array([item]), np.array([score]), np.array([0]), np.array([doc]))
    best.prune()
    assert list(zip(*(x.tolist() for x in best.kept), strict=True)) == [(0, 5, 0, 2), (0, 5, 0, 3), (1, 1, 0, 1)]


# --- Jaccard join -----------------------------------------------------------------------------------------------------


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset({tuple(w)} if 0 < len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)})


def brute_join(rows, percent):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    links = {s: set() for s in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
            if a != b:
                links[a].add(b)
                links[b].add(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), d) if x is not None], default=None)
    size = Counter(sets)
    return sorted(((d, len(s), least[find(i)], size[s] if s else 0, len(links[s])) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def join_corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d", "a b c d e", "x " * 4000]
    passage = [word() for _ in range(30)]
    for g in range(12):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(40):
        texts.append(" ".join([*passage, *(word() for _ in range(rng.randint(1, 60)))]))
    slide = [word() for _ in range(400)]
    texts += [" ".join(slide[2 * k : 2 * k + 90]) for k in range(60)]  # a chain: its ends share nothing
    hot = [word() for _ in range(120)]
    for _ in range(40):
        copy = list(hot)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    page = [word() for _ in range(100)]  # a template: many shared words, few links
    texts += [" ".join([*page[:50], *(word() for _ in range(rng.randint(4, 14))), *page[50:]]) for _ in range(30)]
    texts += [" ".join(hot)] * 20
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(1000 + d, texts[i]) for d, i in enumerate(order)] + [(None, " ".join(hot)), (None, "alone here"), (None, None)]


def joined(spark, rows, percent):
    df = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("cls", "node", "size", "region", "n_links")]), percent=percent)
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "class_size", "n_links").collect()), key=repr)


def bounds(monkeypatch, **values):
    for k, v in values.items():
        monkeypatch.setattr(metric_join, k, v)


@pytest.mark.parametrize("percent", [85, 70])
def test_join_equals_all_pairs(spark, percent):
    rows = join_corpus()
    assert joined(spark, rows, percent) == brute_join(rows, percent)


def test_join_with_regions_that_are_split(spark, monkeypatch):
    """Every branch: hot shingles, windows of sizes, regions split by pivots and again, cores and blocks."""
    rows = join_corpus()
    bounds(monkeypatch, NODE=6, REGION=16, PIVOTS=5, SHRINK=0.9, DEPTH=2)
    seen = []
    inner = metric_join.region_links
    monkeypatch.setattr(metric_join, "region_links", lambda *a: seen.append(a) or inner(*a))
    assert joined(spark, rows, 85) == brute_join(rows, 85)
    assert len(seen) > 2  # regions of regions
    bounds(monkeypatch, SHRINK=0.0)
    assert joined(spark, rows, 85) == brute_join(rows, 85)


def test_join_of_empty_and_long_texts(spark):
    assert joined(spark, [], 85) == []
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:150], "new", *long[150:]])), (3, " ".join(long[:100_000])), (4, None)]
    assert joined(spark, rows, 85) == brute_join(rows, 85)


def test_counts_in_bins_never_part_a_linked_pair():
    rng = np.random.default_rng(4)
    for n in (1, 3, 60, 511, 513, 700, 9000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for cut in (0, max(1, n // 20), n // 14):
            other = np.concatenate([base[cut:], rng.integers(0, 1 << 63, rng.integers(0, 2 + n // 15), dtype=np.uint64)])
            linked = metric_join._by_counts([metric_join.count_sketch(base), metric_join.count_sketch(other)], 85)(0, np.array([1]))[0]
            both = len(base) - cut
            assert linked or 100 * both < 85 * (len(base) + len(other) - both)


def test_window_of_a_pivot_holds_what_is_linked():
    """The theorem the regions rest on, on random sets: d(y, q) of a linked y is within 2 r of its nearest pivot."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[k : k + rng.randint(20, 40)]) for k in range(30)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    sets, begin = shingle_sets(data, offsets, 4)
    s = metric_join.Sets([sets[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], 85)
    apart = np.column_stack([s.distances(p) for p in range(len(texts))])
    pivots = apart[:, :6]
    home = pivots.argmin(1)
    for x, y in zip(*np.nonzero(apart <= 0.15), strict=True):
        assert pivots[y, home[x]] <= pivots[y].min() + 0.3 + 1e-9


def test_rows_of_joined_types(spark):
    df = jaccard_join(spark.createDataFrame([Row(doc_id="b", text="a b c d e"), Row(doc_id="a", text="A B c d e")]))
    assert sorted(tuple(r) for r in df.collect()) == [("a", 2, "a", 2, 0), ("b", 2, "a", 2, 0)]


def test_lines_that_many_documents_share_make_no_clusters(spark, monkeypatch):
    """Few of the sets reach the regions, whose work is all pairs, and first shingles are shuffled with their sets only if shared."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    lines = [" ".join(word() for _ in range(9)) for _ in range(4)]
    texts = [" ".join([lines[0], *(word() for _ in range(60)), lines[1], *(word() for _ in range(60)), lines[2 + k % 2]]) for k in range(400)]
    rows = [*enumerate(texts), (1000, f"new {texts[0]}")]
    bounds(monkeypatch, NODE=40)
    seen = []
    inner = metric_join.region_links
    monkeypatch.setattr(metric_join, "region_links", lambda *a: seen.append(a[0].count()) or inner(*a))
    got = joined(spark, rows, 85)
    assert got == brute_join(rows, 85) and sum(r[4] for r in got) == 2
    assert seen == [2]


def test_a_filter_holds_all_its_keys_and_few_others(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    inside = keys.toArrow().column("k").to_numpy().view(np.uint64)
    others = spark.range(5000, 105_000).select(F.xxhash64("id").alias("k")).toArrow().column("k").to_numpy().view(np.uint64)
    words = metric_join.key_filter(keys, "k")
    assert metric_join._may_hold(words, inside).all() and metric_join._may_hold(words, others).mean() < 0.06
    words = metric_join.key_filter(keys, "k", 1 << 15)  # too few bits let others pass and lose none
    assert len(words) == 512 and metric_join._may_hold(words, inside).all()
    assert not metric_join._may_hold(metric_join.key_filter(keys.filter("k is null"), "k"), others).any()


def test_rows_with_one_id_and_text_are_one_set_wherever_they_stand(spark):
    rows = [(7, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z aa")]
    df = jaccard_join(spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(6))
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()  # nor are texts read again for the result
    assert sorted(tuple(r) for r in df.collect()) == sorted([(7, 23, 7, 3, 1), (8, 24, 7, 3, 1)] * 3)
