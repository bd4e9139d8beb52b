import itertools
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lotlens.llm.packing import GROUPS, PackingPlan, best_config, linear_groups, pack, piece_lengths, solve_configs
from lotlens.llm.queries import tokenizer_added, tokenizer_path


def filled(plan, counts):
    rooms = defaultdict(list)
    for length, rank, n, first, each, offset in plan.entries:
        for k in range(n):
            rooms[first + k // each].append((offset + k % each * length, length))
    assert sum(n for _, _, n, *_ in plan.entries) == sum(counts.values())
    for length, n in counts.items():
        ranks = sorted((r, k) for x, r, k, *_ in plan.entries if x == length)
        assert not n or (ranks[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(ranks, ranks[1:], strict=False)) and sum(ranks[-1]) == n)
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= plan.capacity
    assert set(rooms) == set(range(plan.sequences))
    return plan.sequences


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = 1024
    lengths = [min(capacity, max(1, int(rng.choice([rng.uniform(1, 1024), rng.expovariate(1 / 200), 1024])))) for _ in range(rng.choice([1, 7, 500, 6000]))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    bound = -(-sum(lengths) // capacity)
    used = filled(PackingPlan(counts, capacity), counts)
    assert used <= max(bound + 3, 1.03 * bound) or used <= len(lengths)
    if len(lengths) == 6000:
        assert used <= 1.01 * bound + 2


def test_plan_grows_with_the_lengths_only():
    counts = {x: 10_000_000 + 37 * x for x in range(1, 1025)}
    plan = PackingPlan(counts, 1024)
    assert len(plan.entries) < 200_000
    assert plan.sequences <= 1.01 * sum(x * n for x, n in counts.items()) / 1024


def test_groups_have_equal_cardinality():
    rng = random.Random(3)
    counts = {x: rng.randint(0, 900) for x in range(257, 1024)}
    groups = linear_groups(counts, GROUPS)
    sizes, share = [sum(n for _, n in g) for g in groups], -(-sum(counts.values()) // GROUPS)
    assert len(groups) <= GROUPS and set(sizes[:-1]) == {share} and sizes[-1] <= share
    lengths = [x for g in groups for x, _ in g]
    assert lengths == sorted(lengths, reverse=True)
    assert len(linear_groups({500: 10_000, 300: 1}, GROUPS)) == 1 and linear_groups({}, GROUPS) == []


def test_configurations_are_optimal():
    rng = random.Random(4)
    for _ in range(20):
        sizes, capacity = sorted(rng.sample(range(20, 100), 5), reverse=True), 100
        worth = np.array([rng.random() for _ in sizes])
        every = [c for c in itertools.product(*[range(capacity // x + 1) for x in sizes]) if sum(n * x for n, x in zip(c, sizes, strict=True)) <= capacity]
        value, config = best_config(np.array(sizes), worth, capacity)
        assert value == pytest.approx(max(float(np.dot(c, worth)) for c in every)) == pytest.approx(float(config @ worth)) and tuple(config) in every
        demand = [rng.randint(1, 500) for _ in sizes]
        plan = solve_configs(sizes, demand, capacity)
        assert sum(c * n for c, n in plan) == pytest.approx(np.array(demand)) and all(tuple(c) in every and n >= 0 for c, n in plan)
        # no prices under which every configuration is worth 1 at most give more than the optimum; the plan's own reach it
        basis = np.array([c for c, _ in plan], float)
        price = np.linalg.solve(basis, np.ones(len(sizes)))
        assert max(float(np.dot(c, price)) for c in every) <= 1 + 1e-6 and float(np.dot(price, demand)) == pytest.approx(sum(n for _, n in plan))


def test_pieces_are_the_tokens(spark):
    texts = [None, "", "a", " \n\t  x", "héllo wörld 𝒳 ½ ٣ ১২", "<|endoftext|> it's we'll  x\u0085y", "abc " * 3000, "z" * 5000, "日本語" * 700, "a" * 4, "no\r\n\r\nbreak   "] + ["same text here"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "3 as n", "4 as cell")
    got = pack(df, tokenizer_path(), added=tokenizer_added()).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.length for r in pieces] == piece_lengths(len(ids), 1024) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == crc32(ids[r.start : r.start + r.length].tobytes())
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert pack(df.filter("false"), tokenizer_path()).count() == 0


def test_added_tokens_in_plain_text_have_their_ids(spark, tmp_path):
    import corpus_pipeline

    from lotlens.llm import queries

    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b <|endoftext|", " \n<|endoftext|>\n x", "word " * 2000 + "<|endoftext|>" + " tail" * 1500, None, "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, text in enumerate(texts):
        ids, start = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for piece, length in enumerate(piece_lengths(len(ids), 1024)):
            want[i, piece] = (start, length, crc32(ids[start : start + length].tobytes()))
            start += length
    for got in (queries.op7_linear_grouping_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, df, str(tmp_path))):
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.collect()} == want


def test_runs_of_a_million_signs_have_the_library_s_ids(spark):
    import corpus_pipeline

    from lotlens.llm.queries import tokenizer_json

    n = 1_000_000
    texts = ["x" + " " * n + "y", "\n" * n, "a" * n, "=" * n, "\t \n" * (n // 3) + "<|endoftext|>\u3000" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, text in enumerate(texts):
        ids, start = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for piece, length in enumerate(piece_lengths(len(ids), 1024)):
            want.add((i, piece, start, length, crc32(ids[start : start + length].tobytes())))
            start += length
    for got in (pack(df, tokenizer_path(), added=tokenizer_added(), json_path=tokenizer_json()), corpus_pipeline.packing(spark, df, "")):
        assert {tuple(r)[:5] for r in got.collect()} == want


def test_configurations_place_the_large_pieces():
    rng = random.Random(9)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(1023, max(1, int(rng.lognormvariate(5.5, 0.8))))] += 1
    plan = PackingPlan(dict(counts), 1024)
    large = sum(n for x, n in counts.items() if x > 1024 // 5)
    assert plan.configured >= 0.9 * large
    assert filled(plan, counts) <= 1.002 * sum(x * n for x, n in counts.items()) / 1024 + 2
