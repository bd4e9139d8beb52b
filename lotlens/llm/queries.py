"""One query per operator, with production parameters, over its whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm.decontam import find_contamination
from lotlens.llm.lexical_search import lexical_search
from lotlens.llm.license_scan import BASE_PHRASES, LABEL_OF, TEMPLATES, scan_licenses
from lotlens.llm.lm_scoring import cross_entropy_difference
from lotlens.llm.manifest import fold, merkle_manifest, proof_digest
from lotlens.llm.metric_join import jaccard_join
from lotlens.llm.near_dedup import near_duplicates
from lotlens.llm.packing import added_tokens, pack
from lotlens.llm.pii import find_pii
from lotlens.llm.quality_classifier import classify_quality
from lotlens.llm.quality_rules import apply_rules
from lotlens.llm.secret_scan import KINDS, scan_secrets
from lotlens.llm.sharding import interleave_shards
from lotlens.llm.spark_util import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer_json() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_added() -> dict[str, int]:
    return added_tokens(tokenizer_json())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("n_templates")


def op2_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def op4_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op5_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names no repository: each language of a source stands for one, and the source for their owner."""
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs.withColumn("repo", F.concat_ws("/", "source", "lang")), repo_col="repo")


def op7_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), added=tokenizer_added(), json_path=tokenizer_json())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    scored = classify_quality(table(spark, sf_dir, "documents"), labels.filter(~held_out(F.col("doc_id"))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op10_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    proved = merkle_manifest(docs, F.when(altered, lower_ascii(F.col("text"))).otherwise(F.col("text")))
    folded = fold(F.col("given_leaf"), F.col("steps"))
    rows = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_aho_corasick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_metric_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_stratified_interleave, op3_host_rules, op4_semi_markov_pii, op5_chosen_path_dedup, op6_secret_ownership, op7_linear_grouping_packing, op8_quality_classifier, op9_cross_entropy_difference, op10_bm25_decontamination, op11_merkle_manifest, op12_aho_corasick_search, op13_metric_jaccard_join)
}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def template_pattern(markup: str) -> str:
    """A template as a regular expression over words that are each followed by one space."""
    piece = {"[[": "(?:", "]]": ")?"}
    tokens = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup)
    return " " + "".join(piece.get(t) or (f"(?:[^ ]+ ){{0,{t[2:-2]}}}" if t[0] == "{" else f"{t} ") for t in tokens)


def _licenses_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    places = " UNION ALL ".join(f"SELECT row, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()})) AS place, {quoted(label)} AS label FROM w WHERE contains(n, {quoted(f' {p} ')})" for p, label in BASE_PHRASES.items())
    accepted = " UNION ALL ".join(f"SELECT row, {quoted(LABEL_OF.get(name, name))} AS label FROM w WHERE regexp_matches(n, {quoted(template_pattern(m))})" for name, m in TEMPLATES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 w AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS n FROM d),
 p AS ({places}),
 t AS (SELECT DISTINCT row, label FROM ({accepted})),
 b AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY 1),
 a AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM p UNION ALL SELECT row, label FROM t) GROUP BY 1),
 s AS (SELECT DISTINCT row, 1.0 AS score FROM t)
SELECT doc_id, len(w.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(s.score, CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (row) LEFT JOIN a USING (row) LEFT JOIN s USING (row)"""


def _secrets_sql() -> str:
    """Places follow from the lengths of what lies between the matches and of the matches before."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT row, owner, repo, {i} AS kind, '{k.name}' AS name, {k.least} AS least, string_split_regex(t, {quoted(k.plain or k.pattern)}) AS gaps, regexp_extract_all(t, {quoted(k.plain or k.pattern)}) AS whole, regexp_extract_all(t, {quoted(k.plain or k.pattern)}, {k.group}) AS vals FROM d WHERE regexp_matches(t, {quoted(k.plain or k.pattern)})"
        for i, k in enumerate(KINDS)
    )
    base = [k for k in KINDS if k.base]
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k.name}" for i, k in enumerate(base))
    joined = "coalesce(string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
 f AS ({found}),
 u AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM f),
 p AS (SELECT row, owner, repo, kind, name, vals[i] AS v, list_sum([length(x) for x in gaps[1:i]]) + list_sum([length(x) for x in whole[1:i]]) AS e, length(whole[i]) AS n FROM u WHERE length(vals[i]) >= least),
 s AS (SELECT *, e - n AS b FROM p),
 a AS (SELECT DISTINCT v, owner, repo FROM s),
 g AS (SELECT v, count(DISTINCT coalesce(owner, chr(1))) AS owners, count(*) AS repos FROM a GROUP BY 1),
 c AS (SELECT v, length(v) AS n, [(length(v) - length(replace(v, x, ''))) / length(v) for x in list_distinct(string_split(v, ''))] AS shares FROM g),
 o AS (SELECT v, n >= 12 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND round(list_sum([-x * log2(x) for x in shares]), 6)
   >= round(0.75 * least(log2(n), log2(CASE WHEN regexp_matches(v, '^[0-9a-f]*$') THEN 16 WHEN regexp_matches(v, '^[0-9a-z]*$|^[0-9A-Z]*$') THEN 36 ELSE 64 END)), 6) AS random FROM c),
 k AS (SELECT s.*, owners, repos, CASE WHEN owners >= 3 OR repos >= 6 THEN 'example' WHEN owners = 1 AND random THEN 'live' ELSE 'plain' END AS class FROM s JOIN g USING (v) JOIN o USING (v)),
 r AS (SELECT row, {counts}, sha256({joined} FILTER (WHERE kind < {len(base)}), '')) AS base_sha256, {joined}, '') AS spans, count(*) FILTER (WHERE class = 'live') AS n_live, count(*) FILTER (WHERE class = 'example') AS n_example,
   max(owners) AS most_owners, max(repos) AS most_repos FROM k WHERE kind < {len(base)} OR class <> 'example' GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in base)}, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos,
 coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (row)"""


def _losses_sql() -> str:
    """Both models by plain counting; the unknown word is the empty text, a blank stands before a text's first word."""
    both = lambda key, at: f"SELECT {key}, count(*) FILTER (WHERE side) AS t, count(*) FILTER (WHERE NOT side) AS b FROM p GROUP BY {at}"
    own = lambda c, side, mine: f"({c}.{side} - CASE WHEN {'p.side' if side == 't' else 'NOT p.side'} THEN {mine} ELSE 0 END)"

    def loss(side: str) -> str:
        alone = f"({own('cw', side, 'ow.n')} + 1)::DOUBLE / ({own('tot', side, 'n.n')} + size)"
        follows = own("cv", side, "ov.n")
        pair = f"{own('cp', side, 'op.n')}::DOUBLE / greatest({follows}, 1)"
        return f"-ln(CASE WHEN {follows} > 0 THEN 0.4::DOUBLE * ({alone}) + 0.6::DOUBLE * ({pair}) ELSE {alone} END)"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS side, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 t AS (SELECT r, side, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
 voc AS (SELECT w FROM t GROUP BY 1 HAVING count(*) >= 2),
 m AS (SELECT r, side, i, CASE WHEN voc.w IS NULL THEN '' ELSE t.w END AS w FROM t LEFT JOIN voc ON voc.w = t.w),
 p AS (SELECT r, side, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), ' ') AS v FROM m),
 cw AS ({both('w', 'w')}), cv AS ({both('v', 'v')}), cp AS ({both('v, w', 'v, w')}),
 ow AS (SELECT r, w, count(*) AS n FROM p GROUP BY ALL), ov AS (SELECT r, v, count(*) AS n FROM p GROUP BY ALL), op AS (SELECT r, v, w, count(*) AS n FROM p GROUP BY ALL), n AS (SELECT r, count(*) AS n FROM p GROUP BY 1),
 tot AS (SELECT count(*) FILTER (WHERE side) AS t, count(*) FILTER (WHERE NOT side) AS b, (SELECT count(*) FROM voc) + 1 AS size FROM p),
 l AS (SELECT p.r, {loss('t')} AS t, {loss('b')} AS b FROM p JOIN cw USING (w) JOIN cv USING (v) JOIN cp ON cp.v = p.v AND cp.w = p.w JOIN ow ON ow.r = p.r AND ow.w = p.w JOIN ov ON ov.r = p.r AND ov.v = p.v JOIN op ON op.r = p.r AND op.v = p.v AND op.w = p.w JOIN n ON n.r = p.r, tot),
 s AS (SELECT r, sum(t) / count(*) AS t, sum(b) / count(*) AS b FROM l GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, round(coalesce(t, 0), 6) AS target_loss, round(coalesce(b, 0), 6) AS background_loss, round(coalesce(t - b, 0), 6) AS score FROM d LEFT JOIN s USING (r)"""


def _contamination_sql() -> str:
    """Every passage scored against every item that shares a word with it."""
    words = lambda t: rf"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = lambda ws, n: f"list_distinct(list_transform(range(1, len({ws}) - {n} + 2), lambda k: array_to_string({ws}[k:k + {n} - 1], ' ')))"
    share = lambda g, n: f"len(list_filter({g}, lambda x: list_contains({grams('passage', n)}, x))) / len({g})"
    return rf"""
WITH i AS (SELECT row_number() OVER () AS it, item_id, {words('text')} AS w, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: len({words('x')}) > 0) AS parts
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len({words('text')}) > 0),
 b AS (SELECT *, len(w) AS n, CASE WHEN len(w) <= 64 THEN 64 WHEN len(w) <= 256 THEN 256 WHEN len(w) <= 1024 THEN 1024 ELSE 4096 END AS step,
   CASE WHEN len(parts) > 1 THEN {words("array_to_string(parts[:-2], ' ')")} ELSE w END AS q, CASE WHEN len(parts) > 1 THEN {words('parts[-1]')} ELSE w END AS a FROM i),
 g AS (SELECT it, item_id, step, least(5, len(q)) AS nq, least(5, len(a)) AS na, least(5, n) AS nw, {grams('q', 'least(5, len(q))')} AS gq, {grams('a', 'least(5, len(a))')} AS ga, {grams('w', 'least(5, n)')} AS gw FROM b),
 iw AS (SELECT it, step, n, x AS w, count(*) AS tf FROM (SELECT it, step, n, unnest(w) AS x FROM b) GROUP BY ALL),
 df AS (SELECT w, count(*) AS df FROM iw GROUP BY 1), tot AS (SELECT count(*) AS items, avg(n) AS mean FROM b),
 im AS (SELECT it, step, iw.w, ln(1 + (items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS impact FROM iw JOIN df ON df.w = iw.w, tot),
 un AS (SELECT it, step, w, CAST(round_even(impact / sum(impact) OVER (PARTITION BY it) * 1099511627776, 0) AS BIGINT) AS impact FROM im),
 d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
 t AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
 k AS (SELECT DISTINCT step FROM b),
 pw AS (SELECT DISTINCT r, step, s, w FROM (SELECT r, step, i // step AS s, w FROM t, k UNION ALL SELECT r, step, i // step - 1, w FROM t, k WHERE i >= step)),
 sc AS (SELECT r, s, it FROM pw JOIN un ON un.w = pw.w AND un.step = pw.step GROUP BY r, s, it HAVING sum(impact) >= 549755813888),
 ve AS (SELECT sc.r, sc.it, s * step AS first_word, ws[s * step + 1:(s + 2) * step] AS passage, g.*, doc_id FROM sc JOIN g ON g.it = sc.it JOIN d ON d.r = sc.r),
 o AS (SELECT r, it, doc_id, item_id, first_word, {share('gw', 'nw')} AS whole, {share('gq', 'nq')} AS question, {share('ga', 'na')} AS answer FROM ve)
SELECT doc_id, item_id, round(whole, 6) AS overlap, round(question, 6) AS question_overlap, round(answer, 6) AS answer_overlap, CAST(first_word AS BIGINT) AS first_word FROM o
WHERE least(question, answer) >= 0.5 OR whole >= 0.5 QUALIFY row_number() OVER (PARTITION BY r, it ORDER BY whole DESC, first_word) = 1"""


_CRC_TABLE = """step(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
 crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8)"""


def _crc(text: str) -> str:
    """Unsigned crc32 of a text's bytes, with the table `t` of `crc`."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295)"


def _manifest_sql(levels: int = 6) -> str:
    """Trees of up to 16^levels leaves, the levels written out; a finished tree stays as it is."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars')))} || {field(text)})"

    def tree(name: str, leaves: str) -> str:
        """`name`k: nodes of level k (t, i, h, n nodes of the tree); `name`p: proofs of the leaves, cut where the tree ends."""
        out = [f"{name}0 AS ({leaves})"]
        for k in range(1, levels + 1):
            out.append(f"{name}{k} AS (SELECT t, b AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, CAST(ceil(any_value(n) / 16.0) AS BIGINT) AS n, list(h ORDER BY i) AS kids FROM (SELECT *, i // 16 AS b FROM {name}{k - 1}) GROUP BY t, b)")
        return ",\n ".join(out)

    def walk(name: str, source: str, columns: str) -> str:
        """CTEs that carry `folded` and `proof` of each row up one level at a time."""
        out, before = [], source
        for k in range(1, levels + 1):
            cut = lambda part: f"CASE WHEN w.n > 1 THEN array_to_string(x.kids[{part}], '') ELSE '' END"
            left, right = cut("1:w.i % 16"), cut("w.i % 16 + 2:")
            out.append(
                f"{name}w{k} AS (SELECT {columns}, w.t, w.i // 16 AS i, x.n AS n, w.proof || {left} || {right} AS proof, CASE WHEN w.n > 1 THEN sha256({left} || w.folded || {right}) ELSE w.folded END AS folded, x.h AS h FROM {before} w JOIN {name}{k} x ON x.t = w.t AND x.i = w.i // 16)"
            )
            before = f"{name}w{k}"
        return ",\n ".join(out)

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
 d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS t, {leaf('text')} AS leaf, {leaf(lower)} AS other, {_crc('CAST(doc_id AS VARCHAR)')} % 5 = 0 AS altered FROM documents, crc),
 r AS (SELECT doc_id, t, leaf, CASE WHEN coalesce(altered, false) THEN other ELSE leaf END AS given, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
 {tree('a', 'SELECT t, i, leaf AS h, n FROM r')},
 aw0 AS (SELECT doc_id, leaf, t, i, n, '' AS proof, given AS folded, leaf AS h FROM r),
 {walk('a', 'aw0', 'doc_id, leaf')},
 s AS (SELECT t AS of, h, row_number() OVER (ORDER BY encode(t)) - 1 AS i, count(*) OVER () AS n FROM a{levels}),
 {tree('b', "SELECT '' AS t, i, h, n FROM s")},
 bw0 AS (SELECT doc_id, leaf, s.h AS subroot, '' AS t, s.i, s.n, w.proof, w.folded, s.h FROM aw{levels} w JOIN s ON s.of = w.t),
 {walk('b', 'bw0', 'doc_id, leaf, subroot')}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM bw{levels}"""


def _search_sql() -> str:
    """Every item against every document that shares a term."""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ws FROM documents),
 c AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS docs, sum(len(ws)) AS terms FROM d),
 t AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
 i AS (SELECT DISTINCT item_id, unnest({terms}) AS w FROM benchmark WHERE item_id IS NOT NULL),
 f AS (SELECT w, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY w),
 s AS (SELECT item_id, t.r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * CAST(50 + (50 * len(ws) * docs) // terms AS BIGINT)))) AS BIGINT) AS score FROM i JOIN t ON t.w = i.w JOIN f ON f.w = i.w JOIN d ON d.r = t.r, c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s JOIN d ON d.r = s.r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 50"""


def _near_sql(k: int) -> str:
    """Every pair of different sets of k-word shingles that share one, and what is reached by those that are linked."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_AZ}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) END) AS g FROM d)),
 n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY 1),
 c AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n, count(*) AS size FROM n GROUP BY 1),
 cs AS (SELECT rep, g FROM c JOIN s ON s.doc_id = c.rep),
 i AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM cs a JOIN cs b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
 l AS (SELECT a, b FROM i JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 reach(a, b) AS (SELECT rep, rep FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
 m AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY 1)"""


_NEAR_ROWS = " FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.k = n.k LEFT JOIN m ON m.rep = c.rep"


#: The others hold a trained model, a tokenizer or an index, and are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_license_scan": _licenses_sql(),
    "op2_stratified_interleave": r"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
 crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
 d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
 b AS (SELECT doc_id, source, CAST(strlen(text) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(text), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS text_crc32,
   CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS tie FROM d, crc),
 u AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), CAST(tie AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u, CAST('0x' || substr(md5(concat_ws('|', '18', source)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS v FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, tie, doc_id NULLS FIRST) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM u),
 p AS (SELECT *, row_number() OVER (ORDER BY (k + CAST(v AS DOUBLE)) / n, source NULLS FIRST, tie, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 16 // total AS INTEGER) AS shard, CAST(place - (place * 16 // total * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p""",
    "op11_merkle_manifest": _manifest_sql(),
    "op12_aho_corasick_search": _search_sql(),
    "op6_secret_ownership": _secrets_sql(),
    "op9_cross_entropy_difference": _losses_sql(),
    "op10_bm25_decontamination": _contamination_sql(),
    "op3_host_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
 g AS (SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS tri FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
 twice AS (SELECT r, tri FROM g GROUP BY ALL HAVING count(*) > 1),
 cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (r, tri)) GROUP BY 1),
 c AS (SELECT w.r, doc_id, host, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN cover USING (r)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS hard,
   CAST(100 * n_dup_lines > 30 * n_lines AS INTEGER) + CAST(word_chars < 3 * n_words OR word_chars > 12 * n_words AS INTEGER) AS soft FROM c),
 h AS (SELECT host, count(*) AS host_docs, count(*) FILTER (WHERE base_failed OR hard OR soft > 0) AS host_failed FROM b GROUP BY 1),
 q AS (SELECT CAST(host_docs AS DOUBLE) AS n, CAST(host_failed AS DOUBLE) AS x FROM h),
 s AS (SELECT sum(n) AS n, sum(x) AS x, sum(n * n) AS nn, sum(x * x / n) AS xx, count(*) - 1 AS free, sum(x) / sum(n) AS m FROM q),
 r AS (SELECT m, CASE WHEN m > 0 AND m < 1 AND n - nn / n - free > 0 THEN ((xx - x * m) / (m * (1 - m)) - free) / (n - nn / n - free) ELSE 0 END AS spread FROM s),
 p AS (SELECT m, CASE WHEN spread > 1e-6 THEN greatest(1, least(1e6, 1 / spread - 1)) ELSE 1e6 END AS k FROM r),
 v AS (SELECT host, host_docs, host_failed, m, (host_failed + m * k) / (host_docs + k) AS rate, host_docs + k + 1 AS weight FROM h, p),
 l AS (SELECT *, rate - 1.645 * sqrt(rate * (1 - rate) / weight) AS low FROM v),
 x AS (SELECT *, CASE WHEN low > greatest(3 * m, 0.5) THEN 'blocked' WHEN low > 1.5 * m THEN 'suspect' ELSE 'good' END AS host_verdict FROM l)
SELECT doc_id, b.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT hard AND host_verdict <> 'blocked' AND soft <= CASE WHEN host_verdict = 'suspect' THEN 0 ELSE 1 END AS kept, host_docs, host_failed, round(rate, 9) AS host_rate, host_verdict
FROM b JOIN x ON b.host IS NOT DISTINCT FROM x.host""",
    "op5_chosen_path_dedup": _near_sql(5) + " SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept, coalesce(c.size, 0) AS class_size" + _NEAR_ROWS,
    "op13_metric_jaccard_join": _near_sql(4) + " SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(c.size, 0) AS class_size, coalesce(links, 0) AS n_links" + _NEAR_ROWS + " LEFT JOIN (SELECT a AS rep, count(*) AS links FROM e GROUP BY 1) k ON k.rep = c.rep",
}
