import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from lotlens.llm.license_scan import BASE_PHRASES, TEMPLATES, TokenAutomaton, scan_licenses
from lotlens.llm.quality_rules import apply_rules, host_verdicts
from lotlens.llm.sharding import interleave_shards

LONG = "word " * 30_000
TEXTS = [
    None, "", "   \n\t ", "a", "a b a b a b a b", "x y z x y z", "Licensed under the Apache License, Version 2.0.", "UNDER\nthe MIT-license and under the mit license",
    "This work is licensed under the GNU General Public License, version 3.", "cc by nc!", "cc by ncx", "sunder the mit license", "é# ** $a|b\n\nline\nline\n line\nline", "İstanbul under the MİT license", LONG,
    "one two three four\x0bfive\x0csix\rseven " * 9, "same same same same", "a a a\na a a\n", " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i % 30}" for i in range(80)),
]


def docs(spark, texts=TEXTS, extra=False):
    rows = [Row(doc_id=i, text=t, lang="en", source=None if i % 7 == 6 else f"s{i % 3}", n_chars=0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as n_words", "2 as shard", "3 as host", "4 as words", "5 as labels", "6 as kept", "7 as _k", "8 as n") if extra else df


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("extra", [False, True])
def test_license_base_against_brute_force(spark, extra):
    got = {r.doc_id: r for r in scan_licenses(docs(spark, extra=extra)).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = sorted((k, label) for p, label in BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None), t
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[8].labels == "gpl-3" and got[6].labels == "apache-2"


def test_automaton_takes_only_the_mandatory_wording():
    a = TokenAutomaton("keep this [[or [[even]] that]] for {{2}} years")
    ok = ["keep this for years", "keep this or that for five years", "keep this or even that for five long years"]
    bad = ["keep that for years", "keep this or for years", "keep this for one two three years", "keep this even that for years", "keep this for"]
    run = lambda s: a.match([w.encode() for w in s.split()], 0)
    assert all(run(s) == len(s.split()) for s in ok)
    assert all(run(s) == -1 for s in bad)


def test_shards_hold_every_source_in_its_share(spark):
    rows = [Row(doc_id=i, text=None if i % 9 == 0 else f"text {i % 400}", source="hot" if i % 3 == 0 else None if i % 3 == 1 else f"s{i % 50}") for i in range(3001)]
    got = interleave_shards(spark.createDataFrame(rows).selectExpr("*", "1 as u", "2 as cell"), shards=16, cell_rows=100).collect()
    assert len(got) == 3001 and len({r.doc_id for r in got}) == 3001
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    hot = Counter(r.shard for r in got if r.source == "hot")
    # a cut can move by what the 52 other sources round away: a tenth of the share here
    assert all(abs(n - 1001 / 16) <= 6.3 for n in hot.values())
    by = {r.doc_id: r for r in got}
    for r in rows:
        raw = (r.text or "").encode()
        assert by[r.doc_id].size == len(raw) + 1 and by[r.doc_id].text_crc32 == zlib.crc32(raw)


def placed_by_hand(rows, shards, seed=17):
    """(doc_id, source, shard, slot) by sorting all rows."""
    from hashlib import md5

    digits = lambda n, t: int(md5(t.encode()).hexdigest()[:n], 16)
    unit = lambda *c: digits(13, "|".join(str(x) for x in c if x is not None)) / 2**52
    ordered = []
    for source in {r.source for r in rows}:
        mine = sorted((unit(seed, r.doc_id, digits(15, r.text or "")), r.doc_id) for r in rows if r.source == source)
        ordered += [((k + unit(seed + 1, source)) / len(mine), d, source) for k, (_, d) in enumerate(mine)]
    ordered.sort(key=lambda x: x[0])
    out, n, begin = [], len(rows), {}
    for k, (_, d, source) in enumerate(ordered):
        shard = k * shards // n
        out.append((d, source, shard, k - begin.setdefault(shard, k)))
    return sorted(out, key=str)


def test_shards_against_sorting_by_hand(spark):
    rows = [Row(doc_id=i, text=None if i % 9 == 0 else f"text {i % 400}", source="hot" if i % 3 == 0 else [None, "", "\0", "s1", "s2"][i % 5]) for i in range(1501)]
    df = spark.createDataFrame(rows)
    for n, cells in ((16, 40), (7, 5000)):
        got = interleave_shards(df, shards=n, cell_rows=cells).collect()
        assert sorted(((r.doc_id, r.source, r.shard, r.slot) for r in got), key=str) == placed_by_hand(rows, n)


def test_no_value_stands_for_a_null_source(spark):
    rows = [(i, "t", None if i % 2 else "\0") for i in range(20)]
    got = interleave_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4).collect()
    assert len(got) == 20 and {(r.doc_id, r.source) for r in got} == {(i, s) for i, _, s in rows}


def test_alike_rows_are_dealt_over_all_shards(spark):
    df = spark.createDataFrame([(None, "same", "s")] * 2000 + [(7, "x", "s")] * 2000 + [(i, "y", "t") for i in range(500)], "doc_id long, text string, source string")
    got = interleave_shards(df, cell_rows=50).collect()
    count = Counter((r.shard, r.doc_id if r.source == "s" else "t") for r in got)
    assert len(got) == 4500 and {s for s, _ in count} == set(range(16))
    for s in range(16):
        assert count[s, None] > 60 and count[s, 7] > 60 and 25 <= count[s, "t"] <= 37
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(n for (x, _), n in count.items() if x == s)))


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("extra", [False, True])
def test_rules_against_brute_force(spark, extra):
    got = apply_rules(docs(spark, extra=extra)).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        want = brute_rules(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_small_hosts_are_shrunk(spark):
    rows = [(f"h{k}", i < 10) for k in range(30) for i in range(100)] + [("bad", True)] * 500 + [("one", True)] + [("half", i < 60) for i in range(120)]
    got = {r.host: r for r in host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert got["bad"].host_verdict == "blocked" and got["h1"].host_verdict == got["one"].host_verdict == "good" and got["half"].host_verdict == "suspect"
    assert got["one"].host_rate < got["bad"].host_rate


def test_hosts_that_differ_by_chance_alone_get_the_common_rate(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{k}", bool(rng.random() < 0.2)) for k in range(200) for _ in range(int(rng.integers(1, 60)))]
    got = host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()
    common = sum(f for _, f in rows) / len(rows)
    assert {r.host_verdict for r in got} == {"good"} and all(abs(r.host_rate - common) < 0.06 for r in got)
    for same in ([("a", False)] * 9 + [("b", False)], [("a", True)], [("a", True)] * 3 + [(None, True)]):
        assert {r.host_verdict for r in host_verdicts(spark.createDataFrame(same, "host string, failed boolean")).collect()} == {"good"}


def test_the_verdict_of_a_host_decides_on_its_documents(spark):
    """A long-worded text fails one soft rule: it stays on a good or a small host and goes on a suspect one."""
    good, soft, hard = (" ".join(f"{w}{i}" for i in range(60)) for w in ("word", "averyverylongword", "#$ word"))
    rows = [(f"h{k}", t) for k in range(40) for t in [good] * 48 + [soft] * 2]
    rows += [("suspect", t) for t in [good] * 120 + [soft] * 80] + [("blocked", t) for t in [good] * 20 + [hard] * 180] + [("small", soft), (None, good), (None, soft)]
    docs_of = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {(r.host, rows[r.doc_id][1] == good, rows[r.doc_id][1] == soft): (r.kept, r.host_verdict) for r in apply_rules(docs_of).collect()}
    assert got["h3", True, False] == got["h3", False, True] == (True, "good") == got["small", False, True] == got[None, False, True]
    assert got["suspect", True, False] == (True, "suspect") and got["suspect", False, True] == (False, "suspect")
    assert got["blocked", True, False] == got["blocked", False, False] == (False, "blocked")


def test_empty_tables(spark):
    empty = docs(spark).filter("false")
    for op in (scan_licenses, interleave_shards, apply_rules):
        assert op(empty).count() == 0


def test_the_gate_lets_through_all_that_an_automaton_accepts(spark):
    released = "This is free and unencumbered software released into the "
    texts = [released + "public\n// domain", released + "public  domain", released + "public\tdomain", "nothing", None, "under the mit", " license"]
    got = {r.doc_id: r for r in scan_licenses(docs(spark, texts)).collect()}
    assert all((got[i].labels, got[i].score, got[i].n_templates) == ("unlicense", 1.0, 1) for i in range(3))
    assert all(got[i].score == 0 for i in range(3, 7))
    own = {"beer": "[[licence]] {{2}} buy me a beer [[permission]]", "free": "[[do]] [[what]]"}
    texts = ["so buy me\na beer", "what", "see COPYING,\nplease", "buy a beer", "see", "copying please: see copying please"]
    got = {r.doc_id: r for r in scan_licenses(docs(spark, texts), templates=own, phrases={"see copying please": "see"}).collect()}
    assert [got[i].labels for i in range(6)] == ["beer", "free", "see", "", "", "see"]


def test_templates_as_patterns_accept_what_the_automata_do():
    """What the SQL of the licence query rests on, on texts made of the templates' own words."""
    from lotlens.llm.queries import template_pattern

    rng = np.random.default_rng(8)
    for name, markup in [*TEMPLATES.items(), ("own", "keep this [[or [[even]] that]] for {{2}} years")]:
        automaton, pattern = TokenAutomaton(markup), re.compile(template_pattern(markup))
        words = re.findall(r"[a-z0-9]+", markup)
        for k in range(60):
            tokens = list(words)
            for _ in range(k % 4):
                at = int(rng.integers(len(tokens)))
                tokens[at : at + 1] = [[], ["x"], [tokens[at], "x"]][rng.integers(3)] if len(tokens) > 1 else tokens
            accepted = any(automaton.match([t.encode() for t in tokens], i) > i for i in range(len(tokens)))
            assert accepted == bool(pattern.search(" " + "".join(t + " " for t in tokens))), (name, tokens)


def test_one_notice_is_one_template(spark):
    notice = TEMPLATES["mit"].replace("[[copyright [[c]] {{10}}]]", "Copyright (c) 2020 Some Body").replace("[[including the next paragraph]]", "")
    text = notice + " under the mit license. " + "released under the mit license"
    got = scan_licenses(docs(spark, [notice, text, None])).collect()
    assert [r.n_templates for r in got if r.doc_id < 3][:3] == [1, 3, 0]


def test_whole_wording_is_asked_for_and_families_give_one_label(spark):
    from lotlens.llm.license_scan import TEMPLATES, scan_licenses

    plain = lambda name: re.sub(r"\[\[|\]\]", "", re.sub(r"\{\{\d+\}\}", "holders", TEMPLATES[name]))
    cut = lambda text, word: text[: text.rindex(word)] + "invented liability" + text[text.rindex(word) + len(word) :]
    texts = [plain("bsd-3-clause"), plain("bsd-2-clause"), *[plain(n) for n in ("zlib", "bsl-1", "isc", "agpl-3", "cc-by-sa", "cc0", "epl-2", "artistic-2")]]
    texts += [cut(plain("mit"), "dealings"), cut(plain("isc"), "performance"), cut(plain("bsd-3-clause"), "damage"), plain("mit").split(" the software is provided")[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = [r.labels for r in scan_licenses(df).orderBy("doc_id").collect()]
    assert labels == ["bsd-3-clause", "bsd-2-clause", "zlib", "bsl-1", "isc", "agpl-3", "cc-by-sa", "cc0", "epl-2", "artistic-2", "", "", "", ""]


def test_tokens_in_hyphenated_runs_are_read_once(spark):
    import time

    from lotlens.llm.secret_scan import scan_secrets

    took = []
    for n in (50_000, 400_000):
        text = "eyJaaaaaaaa-" * (n // 12) + " eyJabcdefgh.eyJabcdefgh.abcdefgh"
        df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
        scan_secrets(df).count()
        start = time.time()
        spans = scan_secrets(df).first().spans
        took.append(time.time() - start)
        at = len(text) - 32
        assert spans == f"jwt:{at}:{len(text)}"
    assert took[1] < 8 * took[0] + 5
