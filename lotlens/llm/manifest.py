"""Merkle dataset manifest by nested-interval labels.

Every row becomes a leaf digest. Leaves of a source have ranks, and a node of its tree is labelled with the interval of
ranks it covers, `[lo, hi)`, and its level; `FAN` consecutive nodes have one parent. The trees' roots are the leaves of
one more tree, ordered by source, whose root stands for the whole dataset.

Trees are built upwards, a level at a time, by grouping on (tree, bucket of the level). Proofs are made downwards: a
node is attached to its parent by a join on (tree, level bucket) that keeps what the parent's interval contains, its
siblings are the parent's interval less its own, what lies before and what lies behind, and these steps are put before
the parent's own. A group never holds more than `FAN` nodes and a join key never more than `FAN` children, whatever
share of the rows a source has; ranks are exact without a window over a source (`exact_rank` over ranges of ids).

Digests are lowercase hex sha256. Nulls: every null value is `-` in its leaf, so a null and an empty text differ; a
null source is a tree of its own that comes first, and rows without an id are first in their source. Ties: rows of one
source and id are ordered by their leaf digest, so the order of rows in the table has no effect; equal rows have equal
leaves and adjacent places. Long texts are hashed whole. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.spark_util import exact_rank, materialize, pick

FAN = 16
#: Rows of a range whose order one task settles, about.
RANGE_ROWS = 100_000
#: Levels of a tree; 16^16 leaves are beyond any table.
MOST_LEVELS = 16

_STEP = "array<struct<before:string,behind:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]).cast("binary"), 256)


def _ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`lo`, the exact rank of each row in its tree, and `n`, the tree's rows; ranges of the order are the cells."""
    parts = max(1, rows.count() // RANGE_ROWS)
    parts = max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(rows.repartitionByRange(parts, tree, *order).withColumn("cell", F.spark_partition_id()))
    ranked = exact_rank(dealt, [tree], "cell", order)
    sizes = rows.groupBy(tree).agg(F.count("*").alias("n"))
    return ranked.join(sizes, tree).withColumnRenamed("rank", "lo").drop("cell")


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of a level from those below (tree, n, lo, hi, digest), each with its children."""
    bucket = F.floor(F.col("lo") / FAN**level).cast("long")
    kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
    grouped = nodes.groupBy("tree", "n", bucket.alias("bucket")).agg(kids.alias("kids"))
    digest = F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), "").cast("binary"), 256)
    return grouped.select("tree", "n", "bucket", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), digest.alias("digest"), "kids")


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["digest"]), "")


def _siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """The parent's interval less the node's own: digests before and behind it."""
    before = _joined(F.filter(kids, lambda k: k["hi"] <= lo))
    behind = _joined(F.filter(kids, lambda k: k["lo"] >= hi))
    return F.struct(before.alias("before"), behind.alias("behind"))


def _attached(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """The nodes with their own step in front of those of the parent that contains them; parents have kids and steps."""
    up = parents.select(F.col("tree").alias("_t"), F.col("bucket").alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), F.col("steps").alias("_steps"))
    bucket = F.floor(F.col("lo") / FAN**level).cast("long")
    inside = (F.col("tree") == F.col("_t")) & (bucket == F.col("_b")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
    own = _siblings(F.col("_kids"), F.col("lo"), F.col("hi"))
    return nodes.join(up, inside).select(*[c for c in nodes.columns if c != "steps"], F.concat(F.array(own), "_steps").alias("steps"))


def interval_trees(leaves: DataFrame) -> list[DataFrame]:
    """Levels 1, 2, ... of the trees over leaves (tree, n, lo, hi, digest); a tree ends at its root."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    below = leaves.select("tree", "n", "lo", "hi", "digest")
    for level in range(1, MOST_LEVELS + 1):
        if FAN ** (level - 1) >= most:
            return levels
        # a tree with one node at the level below is finished
        levels.append(materialize(_parents(below.filter(F.col("n") > FAN ** (level - 1)), level)))
        below = levels[-1]
    raise ValueError("a tree has too many leaves")


def _roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, digest of each tree's root."""
    out = leaves.filter("n = 1").select("tree", "digest")
    for k, nodes in enumerate(levels, start=1):
        out = out.union(nodes.filter((F.col("n") > FAN ** (k - 1)) & (F.col("n") <= FAN**k)).select("tree", "digest"))
    return out


def _proofs(leaves: DataFrame, levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The leaves with `steps` up to the root of everything; `top` (tree, steps) continues each tree's root."""
    above = None
    for k in range(len(levels), 0, -1):
        nodes = levels[k - 1]
        ends = nodes.filter((F.col("n") > FAN ** (k - 1)) & (F.col("n") <= FAN**k)).join(top, "tree").select(*nodes.columns, "steps")
        if above is not None:
            ends = ends.unionByName(_attached(nodes.filter(F.col("n") > FAN**k), above, k + 1).select(*nodes.columns, "steps"))
        above = materialize(ends)
    alone = leaves.filter("n = 1").join(top, "tree").select(*leaves.columns, "steps")
    return alone if above is None else alone.unionByName(_attached(leaves.filter("n > 1"), above, 1))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["behind"]).cast("binary"), 256))


def merkle_manifest(docs: DataFrame, tampered_text: Column | None = None, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """doc_id, source, leaf_rank, n_leaves, subroot, root, leaf, steps and given_leaf of every row.

    `tampered_text` is the text as it is found now, an expression over the columns of `docs`: given_leaf is the digest
    of the row with it, so `fold(given_leaf, steps) = root` holds exactly if nothing of the row was altered. Without
    it, given_leaf is the leaf. `steps` holds, from the leaf to the root, the digests before and behind each node
    within its parent.
    """
    digest = lambda text: leaf_digest(docs[id_col], docs[source_col], docs[lang_col], docs[chars_col], text)
    source = docs[source_col].cast("string")
    tree = F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))
    leaf = digest(docs[text_col])
    rows = materialize(pick(docs, doc_id=docs[id_col], source=docs[source_col], tree=tree, digest=leaf, given=leaf if tampered_text is None else digest(tampered_text)))
    leaves = materialize(_ranked(rows, "tree", ["doc_id", "digest"]).withColumn("hi", F.col("lo") + 1))
    levels = interval_trees(leaves)
    subroots = materialize(_roots(leaves, levels))

    # the trees' roots are leaves in turn; one tree holds them all
    tops = materialize(_ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "tree", ["of"]).withColumn("hi", F.col("lo") + 1))
    top_levels = interval_trees(tops)
    root = _roots(tops, top_levels).select(F.col("digest").alias("root"))  # one row
    ended = tops.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(_STEP).alias("steps"))
    steps = materialize(_proofs(tops, top_levels, ended).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "steps"))

    proved = _proofs(leaves, levels, steps.select("tree", "steps")).join(steps.select("tree", "subroot"), "tree").crossJoin(F.broadcast(root))
    return proved.select("doc_id", "source", F.col("lo").alias("leaf_rank"), F.col("n").alias("n_leaves"), "subroot", "root", F.col("digest").alias("leaf"), "steps", F.col("given").alias("given_leaf"))


def proof_digest(steps: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["behind"])), "").cast("binary"), 256)
