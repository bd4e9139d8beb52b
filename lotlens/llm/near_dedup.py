"""Near-duplicates by a chosen-path set similarity join.

Each text becomes the set of its word shingles and a sequence of minwise tokens. Trees of nodes are grown over the
classes of equal sets: at the root of each independent tree a class goes to the node of its minwise token; a node that
is still large branches again, each class following two more of its minwise tokens that the node's path selects.
Small nodes are compared exhaustively on sketches of minwise tokens, whose cut-off loses a true pair with a chance
below `SKETCH_LOSS`; what sketches leave together is confirmed on full sets, read again from the texts.

Only what connects a group is passed on, never all its pairs: within a node or cluster a search over the members
yields one edge per member. A node that branching can't split is a group of alike sets and goes to the exact stage as
it is. There a cluster under a bound of members and shingles is one task's work; the members of a larger one are dealt
into chunks that all meet the same leaders, and those that stay outside the largest component then meet every chunk,
or, if they are many, the members that share one of their rarest shingles; so nothing is capped.

A pair of similarity J meets in a tree with a chance of at least J * (1 - (1 - J)^2)^2: with 10 trees, under 1e-7 of
pairs at J = 0.85 never meet.

Sets are compared as 64-bit hashes of their shingles: a link could only be wrong where two shingles of one pair of
documents share a hash, for sets of 10,000 a chance of 1e-11. Classes of equal sets are told by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lotlens.llm import text as tx
from lotlens.llm.components import connected_components
from lotlens.llm.spark_util import materialize, pick, skew_join

TREES, SKETCH, SHINGLE = 10, 128, 5
#: Members of a node that are compared exhaustively.
NODE = 1000
#: Members and shingles of a cluster that one task compares (16 MB of hashes).
CLUSTER, CLUSTER_SHINGLES = 4000, 2_000_000
BRANCHES, DEPTH, LEADERS = 2, 3, 32
SKETCH_LOSS = 1e-6

_rng = np.random.default_rng(20)
_XOR = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SHORT = np.uint64(0x9FB21C651E98DF25)


def sketch_cut(percent: int) -> int:
    """The most equal entries that a pair at the threshold falls short of with a chance under SKETCH_LOSS (Chernoff)."""
    j = percent / 100
    for least in range(int(SKETCH * j), 0, -1):
        p = least / SKETCH
        if p < j and math.exp(-SKETCH * (p * math.log(p / j) + (1 - p) * math.log((1 - p) / (1 - j)))) < SKETCH_LOSS:
            return least
    return 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words, one after the other, and where each text's begin."""
    data = tx.LOWER[data]
    starts, ends, first = tx.words(data, offsets, tx.SPACE_WORD)
    h = tx.word_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)
    wide = np.repeat(np.minimum(n, width), count)
    out = wide.astype(np.uint64) * _SHORT
    for k in range(width):
        full = wide > k
        out[full] += h[at[full] + k] * _PLACE[k]
    out = tx.mixed(out)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][count > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[begin]


def minwise(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SKETCH minwise tokens of each set; the sets must not be empty."""
    out = np.empty((len(begin) - 1, SKETCH), np.uint64)
    buffer = np.empty_like(sets)
    for k in range(SKETCH):
        np.bitwise_xor(sets, _XOR[k], out=buffer)
        np.multiply(buffer, _MUL[k], out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, begin[:-1])
    return tx.mixed(out)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, data, offsets in tx.slices(batch.column(2)):
            sets, begin = shingle_sets(data, offsets)
            n = np.diff(begin)
            some = np.flatnonzero(n)
            tokens = minwise(sets, np.append(begin[some], begin[-1])) if len(some) else np.zeros((0, SKETCH), np.uint64)
            cls, keys, sketch = [None] * len(n), [None] * len(n), [None] * len(n)
            for i, t in zip(some, tokens, strict=True):
                cls[i] = xxhash.xxh128_digest(sets[begin[i] : begin[i + 1]].tobytes())
                keys[i] = t[:TREES].view(np.int64)
                sketch[i] = t.astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, stop - row), batch.column(1).slice(row, stop - row), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["row_key", "doc_id", "n_shingles", "cls", "keys", "sketch"],
            )


Link = Callable[[int, np.ndarray], np.ndarray]


def _stars(m: int, linked: Link) -> Iterator[tuple[int, int]]:
    """(a member, another of its component) for all but one member of each component: a search from member to member."""
    left = np.arange(m)
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            hit = linked(todo.pop(), left)
            found, left = left[hit], left[~hit]
            for x in found:
                yield root, x
            todo.extend(found)


def _by_sketch(payload: list[bytes], percent: int) -> Link:
    s = np.frombuffer(b"".join(payload), np.uint16).reshape(-1, SKETCH)
    least = sketch_cut(percent)
    return lambda p, left: np.count_nonzero(s[left] == s[p], axis=1) >= least


def _by_set(payload: list[bytes], percent: int) -> Link:
    sets = [np.frombuffer(b, np.uint64) for b in payload]
    n = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(ids.max() + 1, np.int32)

    def linked(p: int, left: np.ndarray) -> np.ndarray:
        mine = ids[begin[p] : begin[p + 1]]
        near = np.flatnonzero(100 * np.minimum(n[left], n[p]) >= percent * np.maximum(n[left], n[p]))
        both = np.zeros(len(left), np.int64)
        mark[mine] = 1
        if 4 * len(near) < len(sets):
            for k in near:
                both[k] = mark[ids[begin[left[k]] : begin[left[k] + 1]]].sum()
        else:
            both[near] = np.add.reduceat(mark[ids], begin[:-1])[left[near]]
        mark[mine] = 0
        return 100 * both >= percent * (n[left] + n[p] - both)

    return linked


def _edges(groups: DataFrame, kernel: Callable[[list[bytes], int], Link], percent: int) -> DataFrame:
    """Edges a, b of the groups' rows `members`, an array of at most a few hundred (cls, payload)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in range(batch.num_rows):
                members = batch.column(0)[row].values
                cls, payload = members.field(0), members.field(1).to_pylist()
                for x, y in _stars(len(payload), kernel(payload, percent)):
                    a.append(cls[int(x)].as_py())
                    b.append(cls[int(y)].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return groups.select("members").mapInArrow(run, "a binary, b binary")


def _collected(rows: DataFrame, *by: str) -> DataFrame:
    """Members in a fixed order, so that a task that runs again gives the same edges."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cls", "payload"))).alias("members"))


def _shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a member, with the number of its shingles."""
    for batch in batches:
        for grp, cls, payload in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            tokens = np.frombuffer(payload, np.int64)
            n = len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, grp)), pa.array([cls.as_py()] * n, pa.binary()), pa.array(np.full(n, n)), pa.array(tokens)], ["grp", "cls", "n", "token"])


def rare_buckets(rows: DataFrame, outside: DataFrame, percent: int) -> DataFrame:
    """The members (grp, size, weight, cls, payload) dealt by the shingles of which two linked sets share at least one.

    In any one order of the shingles, sets at the threshold share one of their first n - ceil(percent n / 100) + 1. The
    order is by frequency in the cluster, so what all its pages have in common comes last and makes no bucket. Only
    buckets with two members, one of them in `outside`, are kept, and of equal ones one.
    """
    tokens = rows.select("grp", "cls", "payload").mapInArrow(_shingles, "grp long, cls binary, n long, token long").withColumn("bucket", F.xxhash64("grp", "token"))
    # what a template's pages share is held by every member
    ordered = skew_join(tokens, tokens.groupBy("bucket").agg(F.count("*").alias("f")), "bucket").drop("bucket")
    place = F.row_number().over(Window.partitionBy("grp", "cls").orderBy("f", "token"))
    first = materialize(ordered.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("grp", "cls", "n", "token"))
    marked = first.join(outside.select("grp", "cls", F.lit(True).alias("out")), ["grp", "cls"], "left")
    held = F.xxhash64("cls", F.lit(11))
    buckets = marked.groupBy("grp", "token").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.bool_or("out").alias("out"), F.bit_xor(held).alias("x"), F.sum(F.shiftright(held, 20)).alias("y"))
    buckets = buckets.filter("size > 1 and out").groupBy("grp", "size", "weight", "x", "y").agg(F.min("token").alias("token"))
    members = first.select("grp", "token", "cls").join(buckets.select("grp", "token", "size", "weight"), ["grp", "token"])
    return members.join(rows.select("grp", "cls", "payload"), ["grp", "cls"]).select(F.xxhash64("grp", "token").alias("grp"), "size", "weight", "cls", "payload")


def exact_labels(rows: DataFrame, percent: int, branch: bool = True) -> DataFrame:
    """node, label of the members (grp, size, weight, cls, payload) that are linked within their cluster.

    size and weight are the cluster's members and shingles. A cluster under both bounds is settled in one task. A
    larger one is dealt into chunks, each of which is compared within itself and with the cluster's leaders. What then
    stands outside its largest component meets all chunks, if it is no more than one chunk; if it is more, as among
    pages of one template, the cluster is branched once more by its rare shingles, and each bucket is settled likewise.
    A bucket is not branched again: one that shares even its rarest shingles, with m outsiders among n members, is
    read m n / CLUSTER^2 times CLUSTER sets.
    """
    fits = (F.col("size") <= CLUSTER) & (F.col("weight") <= CLUSTER_SHINGLES)
    small = _edges(_collected(rows.filter(fits), "grp"), _by_set, percent)
    small = materialize(small)
    settled = small.select(F.col("b").alias("node"), F.col("a").alias("label")).union(small.select("a", "a").distinct())
    large = rows.filter(~fits)
    if large.limit(1).count() == 0:
        return settled
    chunks = F.ceil(F.greatest(F.col("size") / CLUSTER, F.col("weight") / CLUSTER_SHINGLES)).cast("int")
    large = large.withColumn("h", F.xxhash64("cls", F.lit(3))).withColumn("chunks", chunks).withColumn("chunk", F.pmod("h", "chunks").cast("int"))
    lead = large.groupBy("grp", F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(LEADERS)).alias("k")).agg(F.min_by(F.struct("cls", "payload", "chunks"), F.struct("h", "cls")).alias("x"))
    lead = lead.select("grp", "x.cls", "x.payload", F.explode(F.sequence(F.lit(0), F.col("x.chunks") - 1)).alias("chunk"))
    first = materialize(_edges(_collected(large.select("grp", "cls", "payload", "chunk").union(lead.select("grp", "cls", "payload", "chunk")), "grp", "chunk"), _by_set, percent))
    placed = large.select("grp", "cls", "chunk", "chunks").join(connected_components(first).withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    main = placed.groupBy("grp", "label").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = placed.join(main, "grp").filter("label <> main").select("grp", "cls", "chunks")
    # an outsider's block is as large as a chunk, so a task holds two chunks at most
    per = outside.groupBy("grp").agg(F.count("*").alias("n"), F.max("chunks").alias("most")).join(large.select("grp", "size").distinct(), "grp").select("grp", F.ceil(F.col("n") * F.col("most") / F.col("size")).cast("int").alias("blocks"))
    per = materialize(per)
    wide = per.filter("blocks > 1").select("grp")
    if branch and wide.limit(1).count() > 0:
        buckets = materialize(rare_buckets(large.join(wide, "grp", "left_semi"), outside.join(wide, "grp", "left_semi"), percent))
        first = first.union(exact_labels(buckets, percent, branch=False).select(F.col("label").alias("a"), F.col("node").alias("b")))
        per = per.filter("blocks = 1")
    outside = materialize(outside.join(per, "grp").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), "blocks").cast("int")))
    every = large.join(per, "grp").select("grp", "cls", "payload", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    out = outside.join(large.select("grp", "cls", "payload"), ["grp", "cls"]).select("grp", "cls", "payload", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block")
    return settled.union(connected_components(first.union(_edges(_collected(every.union(out), "grp", "chunk", "block"), _by_set, percent))))


def _meet(members: DataFrame) -> DataFrame:
    """node, size, cls of the nodes with two members or more."""
    return materialize(skew_join(members, members.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "node").select("node", "size", "cls"))


def candidate_clusters(classes: DataFrame, percent: int) -> DataFrame:
    """cls (node) and cluster (label) of the classes that some node's sketches put together."""
    sketches = classes.select("cls", F.col("sketch").alias("payload"))
    level = _meet(classes.select("cls", F.posexplode("keys").alias("tree", "key")).select(F.xxhash64("tree", "key").alias("node"), "cls"))
    small = []
    for _ in range(1, DEPTH):
        small.append(level.filter(F.col("size") <= NODE))
        picks = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(SKETCH)) for j in range(BRANCHES)]
        paths = F.array(*[F.xxhash64("node", p, F.substring("payload", (2 * p + 1).cast("int"), F.lit(2))) for p in picks])
        level = _meet(level.filter(F.col("size") > NODE).join(sketches, "cls").select(F.explode(paths).alias("node"), "cls").distinct())
    small.append(level.filter(F.col("size") <= NODE))
    rows = small[0]
    for s in small[1:]:
        rows = rows.union(s)
    # independent trees often hold the same members: each set of members is compared once
    nodes = rows.groupBy("node").agg(F.sort_array(F.collect_list("cls")).alias("members")).groupBy(F.sha2(F.array_join(F.transform("members", F.hex), ""), 256).alias("grp")).agg(F.first("members").alias("members"))
    once = nodes.select("grp", F.explode("members").alias("cls")).join(sketches, "cls")
    hot = level.filter(F.col("size") > NODE)
    alike = skew_join(hot, hot.groupBy("node").agg(F.min("cls").alias("a")), "node").select("a", F.col("cls").alias("b")).distinct()
    return connected_components(_edges(_collected(once, "grp"), _by_sketch, percent).union(alike))


def _confirm_sets(batches: Iterable[pa.RecordBatch], width: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """Sets of the wanted classes, each once a task: rows without an id, or with one id and text, are read as often as they stand."""
    done: set[bytes] = set()
    for batch in batches:
        expected = batch.column(1).to_pylist()
        for row, stop, data, offsets in tx.slices(batch.column(0)):
            sets, begin = shingle_sets(data, offsets, width)
            raw = [sets[begin[i] : begin[i + 1]].tobytes() for i in range(stop - row)]
            same = []
            for i in range(stop - row):
                if expected[row + i] not in done and xxhash.xxh128_digest(raw[i]) == expected[row + i]:
                    done.add(expected[row + i])
                    same.append(i)
            kept = [batch.column(k).slice(row, stop - row).take(pa.array(same, pa.int64())) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([expected[row + i] for i in same], pa.binary()), *kept, pa.array([raw[i] for i in same], pa.binary())], ["cls", "grp", "size", "weight", "payload"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_size (rows with the same set) for every row.

    Rows are linked if 100 * shared >= percent * united distinct five-word shingles of the texts, A-Z lower-cased; a
    text of one to four words is one shingle. Null and empty texts have no set and are linked with nothing by their
    texts. Rows with one id are one document, whatever their texts: what one of them is linked with, all are.
    component_id is the smallest id reachable; a row without an id takes part in links, and stands alone if nothing
    with an id is reached. An empty table gives no rows. Ids may be of any type that can be ordered.
    """
    kind = docs.schema[id_col].dataType
    doc_id = docs[id_col].cast("long") if isinstance(kind, IntegralType) else docs[id_col]
    kind = "long" if isinstance(kind, IntegralType) else kind.simpleString()
    keyed = pick(docs, row_key=F.xxhash64(F.when(doc_id.isNull(), docs[text_col]), doc_id), doc_id=doc_id, text=docs[text_col])
    signed = materialize(keyed.mapInArrow(_sign, f"row_key long, doc_id {kind}, n_shingles long, cls binary, keys array<long>, sketch binary"))
    some = signed.filter("n_shingles > 0")
    classes = materialize(some.groupBy("cls").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("least"), F.count("*").alias("class_size"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    clusters = candidate_clusters(classes, percent)
    members = clusters.withColumnRenamed("node", "cls").join(classes.select("cls", "row_key", "n"), "cls")
    sized = members.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    wanted = materialize(skew_join(members, sized, "label").select("row_key", "cls", F.xxhash64("label").alias("grp"), "size", "weight"))
    read = keyed.join(wanted.select("row_key", "cls", "grp", "size", "weight"), "row_key").select("text", "cls", "grp", "size", "weight")
    full = materialize(read.mapInArrow(_confirm_sets, "cls binary, grp long, size long, weight long, payload binary"))
    labels = exact_labels(full, percent)
    # ids that stand in several classes, or beside a row without a set, and one class of each: they bind their classes
    shared = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("cls").alias("sets"), F.min("cls").alias("one"), F.max("cls").alias("other"))
    shared = materialize(shared.filter("rows > 1 and sets > 0 and (sets < rows or one <> other)").select("doc_id", "one"))
    bound = shared.limit(1).count() > 0
    if bound:
        same_id = signed.select("doc_id", "cls").join(shared, "doc_id").filter("cls is not null").select(F.col("one").alias("a"), F.col("cls").alias("b")).distinct()
        labels = connected_components(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).union(same_id))
    rooted = classes.select("cls", "least", "class_size").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("label", "cls"))
    resolved = skew_join(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "class_size", "component_id")
    rows = signed.select("doc_id", "n_shingles", "cls").withColumn("place", F.col("cls"))
    if bound:  # a row without a set stands where its id stands
        rows = rows.join(shared, "doc_id", "left").withColumn("place", F.coalesce("cls", "one")).select(*rows.columns)
    out = rows.join(resolved.withColumnRenamed("cls", "place"), "place", "left")
    component = F.coalesce("component_id", "doc_id")
    size = F.when(F.col("cls").isNotNull(), F.col("class_size")).otherwise(0)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce(size, F.lit(0)).cast("long").alias("class_size"))
