"""N-gram Jaccard join in metric space: pivots, Voronoi regions, windows by the triangle inequality.

The Jaccard distance of shingle sets is a metric. Within a group of documents that lie near each other, some are taken
as pivots; a document belongs to the region of its nearest pivot, and is also put into every region q with
``d(x, q) <= d(x, nearest) + 2 r``, since nothing that it is linked with (at a distance of r or less) can be at home
outside those windows. A region that is still too large is split again by pivots of its own. Within a region the
distances to a few pivots settle most pairs: too far apart by their difference, linked by their sum; the others are
compared on full sets. So all links are found, each counted in the home region of its ends, none by chance.

Most documents have no other one near them, and are at distance 1 from any pivot: no window of 2 r excludes anything
there. So groups are formed first, by what a link implies:

- two linked sets share one of their first n - ceil(t n) + 1 shingles in any one order; documents meet in groups by
  these shingles, of which those that only one set begins with are dropped after they are counted. The order is by hash;
- shingles that more than `OFTEN` sets begin with, as of lines that very many documents share, are put behind all others
  in the order (at most `HOT` of them, which are sent to all tasks), and the sets that begin with one are read again;
- the sizes of linked sets differ by the factor t at most: groups of more than `NODE` are split into windows of sizes;
- counts of a set's shingles in bins have an L1 distance that never exceeds the symmetric difference of the sets, which
  the sizes and t bound for linked ones. What no such bound keeps apart is one cluster.

A cluster or region of at most `REGION` sets and `REGION_SHINGLES` shingles is one task's work. One that pivots can't
split, as among thousands of copies of one text, has a core: the sets within r / 2 of one pivot are all linked, by the
triangle inequality, without being compared; the others, in blocks, meet the region's chunks, so what is read again
grows with (sets outside the core) x (sets) / REGION.

Sets are compared as 64-bit hashes of their shingles, as in `near_dedup`; equal sets are told by 128 bits.

First shingles and texts are many times what is left of them, so they are not shuffled to be joined: a filter of bits
(`key_filter`) of the keys that are wanted goes to all tasks, which drop nearly all others where they are read. What
passes by chance is dropped by an exact count or join. All texts are read once, and signed and stored once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lotlens.llm import text as tx
from lotlens.llm.components import connected_components
from lotlens.llm.near_dedup import Link, _confirm_sets, _stars, shingle_sets
from lotlens.llm.spark_util import materialize, pick, skew_join

SHINGLE = 4
#: Sets that meet by one shingle in one task.
NODE = 500
#: Sets of such a group of which only those are looked at together whose sizes allow a link.
PAIRS = 50
#: Sets that may begin with a shingle before it is moved behind all others, shingles that are moved, and times they are looked for.
OFTEN, HOT, ROUNDS = 50, 100_000, 2
#: Bits of a filter: for each key, of a slot (at least), and at most (16 MB).
KEY_BITS, SLOT_BITS, MOST_BITS = 8, 1 << 15, 1 << 27
#: Sets and shingles that one task compares (16 MB of hashes).
REGION, REGION_SHINGLES = 3000, 2_000_000
#: Pivots of a region that is split, and of a region within a task.
PIVOTS, INNER = 16, 8
#: A region is split if its parts have at most this share of it, and together at most so many times its sets.
SHRINK, COPIES = 0.6, 4
DEPTH = 6
#: Bins of counts: a power of two, an eighth of the shingles or more.
LEAST_BINS, MOST_BINS = 64, 1 << 14
_EPS = 1e-9
_DEALT = "slot long, places array<short>"
Run = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def bins_of(n: int) -> int:
    return min(MOST_BINS, max(LEAST_BINS, 1 << max(0, (n - 1) // 8).bit_length()))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of two sets that are linked, these many first shingles in a common order have one in common; 0 for empty sets."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def count_sketch(shingles: np.ndarray) -> bytes:
    """The size and the counts of the shingles in bins, up to 255."""
    bins = bins_of(len(shingles))
    counts = np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return len(shingles).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes()


def _lists(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> pa.Array:
    """Lists of the n values from each begin."""
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[at].view(np.int64)))


def _sign(percent: int, width: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row_key, doc_id, size and digest of each text's set; with a threshold also its first shingles and count sketch."""
    for batch in batches:
        for row, stop, data, offsets in tx.slices(batch.column(2)):
            sets, begin = shingle_sets(data, offsets, width)
            n = np.diff(begin)
            own = [sets[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
            columns = [*(batch.column(k).slice(row, stop - row) for k in (0, 1)), pa.array(n, pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in own], pa.binary())]
            if percent:
                columns += [_lists(sets, begin[:-1], prefix_length(n, percent)), pa.array([count_sketch(s) if len(s) else None for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row_key", "doc_id", "n_shingles", "cls", "prefix", "sketch"][: len(columns)])


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of each key, itself a hash."""
    return [((keys >> np.uint64(by)) & np.uint64(bits - 1)).astype(np.int64) for by in (0, 26)]


def _dealt(bits: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slot, places of the keys' bits."""
    for batch in batches:
        places = np.unique(np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits)))
        slots, begin = np.unique(places // SLOT_BITS, return_index=True)
        inside = pa.array((places % SLOT_BITS).astype(np.uint16).view(np.int16))
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.ListArray.from_arrays(pa.array([*begin, len(places)], pa.int32()), inside)], ["slot", "places"])


def _bits_set(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slot and its bits."""
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            bits = np.zeros(SLOT_BITS, np.uint8)
            bits[batch.column(1)[row].values.flatten().to_numpy().view(np.uint16)] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["slot", "bits"])


def _bits_for(n: int) -> int:
    return max(SLOT_BITS, min(MOST_BITS, 1 << (KEY_BITS * n).bit_length()))


def _words(dealt: DataFrame, bits: int) -> np.ndarray:
    slots = dealt.groupBy("slot").agg(F.collect_list("places").alias("places")).mapInArrow(_bits_set, "slot long, bits binary").toArrow()
    words = np.zeros((bits // SLOT_BITS, SLOT_BITS // 64), np.uint64)
    for slot, held in zip(slots.column("slot").to_pylist(), slots.column("bits").to_pylist(), strict=True):  # at most MOST_BITS / SLOT_BITS
        words[slot] = np.frombuffer(held, np.uint64)
    return words.ravel()


def key_filter(keys: DataFrame, key: str, bits: int = 0) -> np.ndarray:
    """Words of bits, two for each key (a hash): all bits of every key are set, and few other keys have theirs set.

    With more than `MOST_BITS` / `KEY_BITS` keys more of the others pass; the words grow no more.
    """
    bits = bits or _bits_for(keys.count())
    return _words(keys.select(key).mapInArrow(partial(_dealt, bits), _DEALT), bits)


def _may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for place in _places(keys, 64 * len(words)):
        out &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def _one_of(few: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among a few sorted ones."""
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values if len(few) else np.zeros(len(values), bool)


def _passed(words: np.ndarray, inside: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column, a key, passes the filter, or all the others."""
    for batch in batches:
        yield batch.filter(pa.array(_may_hold(words, batch.column(0).to_numpy().view(np.uint64)) == inside))


def _alone(copied: np.ndarray, run: Run, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return run(_passed(copied, False, batches))


class Signs:
    """One row of each class of signed rows; only rows that may have copies are shuffled for it."""

    def __init__(self, signed: DataFrame, classes: DataFrame):
        self.rows = signed.select(F.xxhash64("cls").alias("cid"), "cls", "row_key", F.col("n_shingles").alias("n"), "prefix", "sketch")
        self.bits = _bits_for(classes.count())
        self.copied = key_filter(classes.filter("class_size > 1"), "cid")
        some = self.rows.mapInArrow(partial(_passed, self.copied, True), self.rows.schema)
        first = [F.first(x).alias(x) for x in ("n", "prefix", "sketch")]
        self.some = materialize(some.groupBy("cid", "cls").agg(F.min("row_key").alias("row_key"), *first))

    def run(self, run: Run, schema: str, *columns: str) -> DataFrame:
        """Batches of cid and the columns, in one Python step of each task."""
        most = self.rows.select("cid", *columns).mapInArrow(partial(_alone, self.copied, run), schema)
        return most.union(self.some.select("cid", *columns).mapInArrow(run, schema))


def _begun(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node of the first shingles."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(1).flatten()], ["node"])


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.rename_columns(["cid", "payload"])


def _prefixes(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a column of lists, and the row of each."""
    lists = batch.column(k)
    return lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))


def _kept(words: np.ndarray, hot: np.ndarray, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, n, node of the first shingles that pass the filter, without hot ones."""
    for batch in batches:
        shingles, row = _prefixes(batch, 2)
        some = np.flatnonzero(_may_hold(words, shingles) & ~_one_of(hot, shingles))
        who = pa.array(row[some])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(shingles[some].view(np.int64))], ["cid", "n", "node"])


def _touched(hot: np.ndarray, bits: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slot, places of the row_key of the sets that begin with a hot shingle."""
    for batch in batches:
        shingles, row = _prefixes(batch, 2)
        some = pa.array(np.unique(row[_one_of(hot, shingles)]))
        yield from _dealt(bits, [pa.RecordBatch.from_arrays([batch.column(1).take(some)], ["row_key"])])


def _reordered(percent: int, width: int, hot: np.ndarray, words: np.ndarray, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, n and new first shingles, with hot ones put behind, of the texts that begin with a hot one; rows by a filter."""
    for batch in _passed(words, True, batches):
        for _, _, data, offsets in tx.slices(batch.column(1)):
            sets, begin = shingle_sets(data, offsets, width)
            n = np.diff(begin)
            late = _one_of(hot, sets)
            length = prefix_length(n, percent)
            cls, size, more = [], [], []
            for i in np.flatnonzero(n):
                own, behind = sets[begin[i] : begin[i + 1]], late[begin[i] : begin[i + 1]]
                if behind[: length[i]].any():
                    first = np.argsort(behind, kind="stable")[: length[i]]
                    cls.append(xxhash.xxh128_digest(own.tobytes()))
                    size.append(len(own))
                    more.append(own[first[(first >= length[i]) | behind[first]]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(size, pa.int64()), pa.array(more, pa.list_(pa.int64()))], ["cls", "n", "more"])


def _by_counts(payload: list[bytes], percent: int) -> Link:
    """What counts in bins can't keep apart; sets with twice the bins are folded."""
    n = np.array([int.from_bytes(b[:8], "little") for b in payload])
    bins = np.array([len(b) - 8 for b in payload])
    row = np.full((2, len(payload)), -1)
    tables = {}
    for width in np.unique(bins).tolist():
        own, twice = np.flatnonzero(bins == width), np.flatnonzero(bins == 2 * width)
        counts = np.frombuffer(b"".join(payload[i][8:] for i in own), np.uint8).reshape(-1, width).astype(np.int16)
        folded = np.frombuffer(b"".join(payload[i][8:] for i in twice), np.uint8).reshape(-1, 2, width).astype(np.int16).sum(1)
        tables[width] = np.concatenate([counts, np.minimum(folded, 255)])
        row[0, own], row[1, twice] = np.arange(len(own)), len(own) + np.arange(len(twice))

    def linked(p: int, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), bool)
        near = np.flatnonzero(100 * np.minimum(n[left], n[p]) >= percent * np.maximum(n[left], n[p]))
        for other in (1, 2, 0.5):  # bins of the other set over those of this one
            some = near[bins[left[near]] == int(bins[p] * other)]
            if len(some):
                table = tables[min(bins[p], int(bins[p] * other))]
                apart = np.abs(table[row[int(other == 2), left[some]]] - table[row[int(other == 0.5), p]]).sum(1, dtype=np.int64)
                out[some] = apart * (100 + percent) <= (100 - percent) * (n[left[some]] + n[p])
        return out

    return linked


class Sets:
    """Shingle sets of one region, their distances to a few of them, and the links that follow."""

    def __init__(self, payload: list[bytes], percent: int, pivots: int = INNER):
        parts = [np.frombuffer(b, np.uint64) for b in payload]
        self.percent, self.radius = percent, 1 - percent / 100
        self.n = np.array([len(s) for s in parts])
        self.ids = np.unique(np.concatenate(parts), return_inverse=True)[1]
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        self.mark = np.zeros(self.ids.max() + 1, np.int32)
        # each next pivot is the set that is farthest from those before
        self.apart = np.zeros((len(parts), 0))
        p = 0
        for _ in range(min(pivots, len(parts) // 4)):
            self.apart = np.column_stack([self.apart, self.distances(p)])
            p = int(np.argmax(self.apart.min(1)))

    def shared(self, p: int, who: np.ndarray) -> np.ndarray:
        mine = self.ids[self.begin[p] : self.begin[p + 1]]
        self.mark[mine] = 1
        if 4 * len(who) < len(self.n):
            out = np.array([self.mark[self.ids[self.begin[k] : self.begin[k + 1]]].sum() for k in who], np.int64)
        else:
            out = np.add.reduceat(self.mark[self.ids], self.begin[:-1])[who].astype(np.int64)
        self.mark[mine] = 0
        return out

    def distances(self, p: int) -> np.ndarray:
        both = self.shared(p, np.arange(len(self.n)))
        return 1 - both / (self.n + self.n[p] - both)

    def linked(self, p: int, who: np.ndarray) -> np.ndarray:
        """Which of `who` are linked with p: by the triangle inequality where it decides, else by their sets."""
        far = np.abs(self.apart[who] - self.apart[p]).max(1, initial=0) > self.radius + _EPS
        out = (self.apart[who] + self.apart[p]).min(1, initial=2) < self.radius - _EPS
        open_ = np.flatnonzero(~far & ~out & (100 * np.minimum(self.n[who], self.n[p]) >= self.percent * np.maximum(self.n[who], self.n[p])))
        both = self.shared(p, who[open_])
        out[open_] = 100 * both >= self.percent * (self.n[who[open_]] + self.n[p] - both)
        return out


def _root(of: list[int], x: int) -> int:
    while of[x] != x:
        of[x] = of[of[x]]
        x = of[x]
    return x


def _links(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root, links of regions' members (cls, payload, query, side): root is of the node's component in the region.

    side 0: all pairs. side 1 and 2, blocks and chunks: each of a block meets each of a chunk; a member of a block has
    its links counted from there, one of side 3, of a chunk but of no block, from all blocks. Links count for queries.
    """
    for batch in batches:
        node, root, links = [], [], []
        for row in range(batch.num_rows):
            members = batch.column(0)[row].values
            cls, payload, query, side = (members.field(k) for k in range(4))
            cls, payload = cls.to_pylist(), payload.to_pylist()
            query, side = np.asarray(query.to_numpy(zero_copy_only=False), bool), side.to_numpy()
            sets, of, n = Sets(payload, percent), list(range(len(cls))), np.zeros(len(cls), np.int64)
            number = {c: k for k, c in enumerate(cls)}
            name = np.array([number[c] for c in cls])
            for p in np.flatnonzero(side < 2):
                who = np.arange(p + 1, len(cls)) if side[p] == 0 else np.flatnonzero((side > 1) & (name != name[p]))
                who = who if query[p] else who[query[who]]
                found = who[sets.linked(p, who)] if len(who) else who
                n[p] += len(found)
                n[found[side[found] != 2]] += 1
                for q in found.tolist():
                    of[_root(of, q)] = _root(of, int(p))
            for p in range(len(cls)):
                top = _root(of, p)
                if top != p or n[p]:
                    node.append(cls[p])
                    root.append(cls[top])
                    links.append(int(n[p]) if query[p] else 0)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64())], ["node", "root", "links"])


def _found(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    groups = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cls", "payload", "query", "side"))).alias("members"))
    return materialize(groups.select("members").mapInArrow(partial(_links, percent), "node binary, root binary, links long"))


def _place(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, region, home, dist and windows (pivots) of a chunk's members, by their distances to the region's pivots."""
    window = 2 * (1 - percent / 100) + _EPS
    for batch in batches:
        for row in range(batch.num_rows):
            members = batch.column(1)[row].values
            cls, payload, pivot = (members.field(k).to_pylist() for k in range(3))
            sets = Sets(payload, percent, 0)
            pivots, own = np.flatnonzero(pivot), np.flatnonzero(~np.array(pivot))
            apart = np.column_stack([sets.distances(p) for p in pivots])[own]
            home = apart.argmin(1)
            near = apart <= apart.min(1, keepdims=True) + window
            names = [cls[p] for p in pivots]
            columns = [pa.array([cls[i] for i in own], pa.binary()), pa.array(np.full(len(own), batch.column(0)[row].as_py())), pa.array([names[h] for h in home], pa.binary()), pa.array(apart.min(1)), pa.array([[names[k] for k in np.flatnonzero(x)] for x in near], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "region", "home", "dist", "windows"])


def _fits() -> Column:
    return (F.col("size") <= REGION) & (F.col("weight") <= REGION_SHINGLES)


def _chunks() -> Column:
    return F.ceil(F.greatest(F.col("size") / REGION, F.col("weight") / REGION_SHINGLES)).cast("int")


def region_links(rows: DataFrame, percent: int, level: int = 0) -> list[DataFrame]:
    """Tables of node, root, links of the members (region, size, weight, cls, payload, query) of all regions.

    size and weight are the region's members and shingles. All links of a query are within its region; they are found
    for queries alone.
    """
    out = [_found(rows.filter(_fits()).withColumn("side", F.lit(0)), ["region"], percent)]
    large = rows.filter(~_fits())
    if large.limit(1).count() == 0:
        return out
    large = materialize(large.withColumn("h", F.xxhash64("cls", F.lit(level))).withColumn("chunks", _chunks()).withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(97)), "chunks").cast("int")))
    lead = large.groupBy("region", F.pmod("h", F.lit(PIVOTS)).alias("k")).agg(F.min_by(F.struct("cls", "payload", "chunks"), F.struct("h", "cls")).alias("x"))
    lead = lead.select("region", "x.cls", "x.payload", F.explode(F.sequence(F.lit(0), F.col("x.chunks") - 1)).alias("chunk"), F.lit(True).alias("pivot"))
    dealt = large.select("region", "cls", "payload", "chunk", F.lit(False).alias("pivot")).union(lead.select("region", "cls", "payload", "chunk", "pivot"))
    dealt = dealt.groupBy("region", "chunk").agg(F.sort_array(F.collect_list(F.struct("cls", "payload", "pivot"))).alias("members"))
    placed = materialize(dealt.select("region", "members").mapInArrow(partial(_place, percent), "cls binary, region long, home binary, dist double, windows array<binary>"))

    # which regions do pivots split
    parts = placed.select("region", F.explode("windows").alias("pivot")).groupBy("region", "pivot").agg(F.count("*").alias("n"))
    parts = parts.groupBy("region").agg(F.max("n").alias("most"), F.sum("n").alias("all")).join(large.groupBy("region").agg(F.count("*").alias("m")), "region")
    splits = (F.col("most") <= SHRINK * F.col("m")) & (F.col("all") <= COPIES * F.col("m")) & F.lit(level < DEPTH)
    parts = materialize(parts.select("region", splits.alias("splits")))
    joined = large.join(placed, ["cls", "region"])
    # a row for each large region goes to all tasks
    if parts.filter("splits").limit(1).count() > 0:
        inner = joined.join(F.broadcast(parts.filter("splits")), "region").select("region", "cls", "payload", "query", "home", F.explode("windows").alias("pivot"))
        inner = materialize(inner.select(F.xxhash64("region", "pivot").alias("region"), "cls", "payload", (F.col("query") & (F.col("home") == F.col("pivot"))).alias("query")))
        sizes = inner.groupBy("region").agg(F.count("*").alias("size"), F.sum(F.octet_length("payload") / 8).alias("weight"), F.bool_or("query").alias("any"))
        out += region_links(skew_join(inner, sizes.filter("any").drop("any"), "region"), percent, level + 1)
    if parts.filter("not splits").limit(1).count() == 0:
        return out
    inside = F.col("dist") < (1 - percent / 100) / 2 - _EPS
    cores = placed.filter(inside).groupBy("region", "home").agg(F.count("*").alias("n")).groupBy("region").agg(F.max_by("home", F.struct("n", "home")).alias("core"), F.max("n").alias("n_core"))
    whole = parts.filter("not splits").select("region").join(cores, "region", "left")
    dense = joined.join(F.broadcast(whole), "region").withColumn("in_core", F.coalesce(inside & (F.col("home") == F.col("core")), F.lit(False)))
    dense = materialize(dense.select("region", "cls", "payload", "query", "chunks", "chunk", "core", "n_core", "in_core", F.pmod(F.xxhash64("cls", F.lit(7)), "chunks").cast("int").alias("block")))
    out.append(dense.filter("in_core").select(F.col("cls").alias("node"), F.col("core").alias("root"), F.when(F.col("query"), F.col("n_core") - 1).otherwise(0).alias("links")))
    outside = dense.filter("not in_core")
    left = outside.select("region", "cls", "payload", "query", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"))
    # only blocks that hold someone
    blocks = outside.groupBy("region").agg(F.collect_set("block").alias("blocks"))
    right = dense.join(F.broadcast(blocks), "region").select("region", "cls", "payload", "query", F.explode("blocks").alias("block"), "chunk", F.when(F.col("in_core"), 3).otherwise(2).alias("side"))
    out.append(_found(left.unionByName(right), ["region", "block", "chunk"], percent))
    return out


def _near(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges a, b of the groups' members (cid, payload) that counts can't keep apart, one fewer than a component has members."""
    for batch in batches:
        a, b = [], []
        for row in range(batch.num_rows):
            members = batch.column(0)[row].values
            cid, payload = members.field(0).to_pylist(), members.field(1).to_pylist()
            for x, y in _stars(len(cid), _by_counts(payload, percent)):
                a.append(cid[int(x)])
                b.append(cid[int(y)])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _by_sizes(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g1, g2, cid of groups (g1, g2, members): a set with all later ones whose sizes allow a link, or a large group as it is."""
    for batch in batches:
        members = batch.column(2)
        ends, flat = members.offsets.to_numpy() - members.offsets[0].as_py(), members.flatten()
        cid, n = (flat.field(k).to_numpy() for k in range(2))
        sizes = np.diff(ends)
        large = np.repeat(sizes > PAIRS, sizes)
        g1, g2 = (np.repeat(batch.column(k).to_numpy(), sizes)[large] for k in range(2))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in np.unique(sizes[sizes <= PAIRS]).tolist():
            i, j = np.triu_indices(m, 1)
            begin = ends[:-1][sizes == m][:, None]
            i, j = (begin + i).ravel(), (begin + j).ravel()
            may = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            left.append(cid[i[may]])
            right.append(cid[j[may]])
        left, right = np.concatenate(left), np.concatenate(right)
        own = np.unique(left)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((g1, left, own), (g2, np.zeros(len(left) + len(own), np.int64)), (cid[large], right, own))], ["g1", "g2", "cid"])


def _shared(tokens: DataFrame) -> DataFrame:
    """node, size of the shingles that two sets or more begin with."""
    return materialize(tokens.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"))


def _meeting(keyed: DataFrame, signs: Signs, percent: int, width: int) -> DataFrame:
    """cid, n, node, size of the shingles that two sets or more begin with, frequent ones put behind all others.

    Without its hot shingles a set begins with those that it began with, and with `more`.
    """
    shared = _shared(signs.run(_begun, "node long", "prefix"))
    once, hot = key_filter(shared, "node"), np.zeros(0, np.uint64)
    shape = "cid long, n long, node long"
    tokens = signs.run(partial(_kept, once, hot), shape, "n", "prefix")
    for _ in range(ROUNDS):
        often = shared.filter(F.col("size") > min(OFTEN, NODE)).orderBy(F.col("size").desc(), "node").limit(HOT).select("node").toArrow()  # at most HOT numbers
        often = np.setdiff1d(often.column("node").to_numpy().view(np.uint64), hot)[: HOT - len(hot)]
        if not len(often):
            break
        hot = np.union1d(hot, often)
        touched = _words(signs.run(partial(_touched, hot, signs.bits), _DEALT, "row_key", "prefix"), signs.bits)
        again = keyed.select("row_key", "text").mapInArrow(partial(_reordered, percent, width, hot, touched), "cls binary, n long, more array<long>")
        more = again.groupBy("cls").agg(F.first("n").alias("n"), F.first("more").alias("more"))
        more = materialize(more.select(F.xxhash64("cls").alias("cid"), "n", F.explode("more").alias("node")))
        words = once | key_filter(more, "node", 64 * len(once))
        tokens = signs.run(partial(_kept, words, hot), shape, "n", "prefix").union(more)
        shared = _shared(tokens)
    return materialize(skew_join(tokens, shared, "node"))


def candidate_clusters(keyed: DataFrame, signs: Signs, percent: int, width: int) -> DataFrame:
    """node (cid) and label of the sets that no bound keeps apart; sets with one cid are taken together."""
    band = F.floor(F.log("n") / (-math.log(percent / 100) * (1 + _EPS))) if percent < 100 else F.col("n")
    level = _meeting(keyed, signs, percent, width)
    banded = level.filter(F.col("size") > NODE).select("cid", "n", F.explode(F.array(band, band + 1)).alias("band"), "node")
    banded = banded.select("cid", "n", F.xxhash64("node", "band").alias("node"))
    banded = materialize(skew_join(banded, banded.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "node"))
    small = level.filter(F.col("size") <= NODE).select("node", "cid", "n").union(banded.filter(F.col("size") <= NODE).select("node", "cid", "n"))
    # members that meet by many shingles are looked at once
    nodes = small.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("cid", "n"))).alias("members"))
    nodes = nodes.groupBy(F.xxhash64(F.lit(1), "members").alias("g1"), F.xxhash64(F.lit(2), "members").alias("g2")).agg(F.first("members").alias("members"))
    once = nodes.mapInArrow(partial(_by_sizes, percent), "g1 long, g2 long, cid long").distinct().join(signs.run(_sketches, "cid long, payload binary", "sketch"), "cid")
    groups = once.groupBy("g1", "g2").agg(F.sort_array(F.collect_list(F.struct("cid", "payload"))).alias("members"))
    near = groups.select("members").mapInArrow(partial(_near, percent), "a long, b long")
    large = banded.filter(F.col("size") > NODE).select("node", "cid")
    alike = skew_join(large, large.groupBy("node").agg(F.min("cid").alias("a")), "node").select("a", F.col("cid").alias("b"))
    return connected_components(near.union(alike))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size and n_links of every row.

    Rows are linked if 100 * shared >= percent * united distinct shingles of `width` words (five at most) of the texts,
    A-Z lower-cased; a text of fewer words is one shingle. class_size counts the rows with the same set, n_links the other sets
    that this one is linked with. component_id is the smallest id reachable by links, copies included.

    Null and empty texts have no set, are linked with nothing and have a class_size of 0. A row without an id takes
    part in links; its component_id is null if nothing with an id is reached. Repeated ids are documents of their own.
    Texts of any length are read whole. An empty table gives no rows. Other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType
    doc_id = docs[id_col].cast("long") if isinstance(kind, IntegralType) else docs[id_col]
    kind = "long" if isinstance(kind, IntegralType) else kind.simpleString()
    keyed = pick(docs, row_key=F.xxhash64(F.when(doc_id.isNull(), docs[text_col]), doc_id), doc_id=doc_id, text=docs[text_col])
    shape = f"row_key long, doc_id {kind}, n_shingles long, cls binary"
    signed = materialize(keyed.mapInArrow(partial(_sign, percent, width), f"{shape}, prefix array<long>, sketch binary"))
    some = signed.filter("n_shingles > 0")
    classes = materialize(some.groupBy("cls").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("least"), F.count("*").alias("class_size"), F.first("n_shingles").alias("n")).withColumn("cid", F.xxhash64("cls")))
    signs = Signs(some, classes)
    members = candidate_clusters(keyed, signs, percent, width).withColumnRenamed("node", "cid").join(classes.select("cid", "cls", "row_key", "n"), "cid")
    sized = members.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    wanted = materialize(skew_join(members, sized, "label").select("row_key", "cls", F.xxhash64("label").alias("grp"), "size", "weight"))
    texts = keyed.select("row_key", "text").mapInArrow(partial(_passed, key_filter(wanted, "row_key"), True), "row_key long, text string")
    # not broadcast: rows with one id and text must come together, to be taken once
    read = texts.join(wanted.hint("merge"), "row_key").select("text", "cls", "grp", "size", "weight")
    full = materialize(read.mapInArrow(partial(_confirm_sets, width=width), "cls binary, grp long, size long, weight long, payload binary"))
    tables = region_links(full.select(F.col("grp").alias("region"), "size", "weight", "cls", "payload", F.lit(True).alias("query")), percent)
    found = tables[0]
    for t in tables[1:]:
        found = found.union(t)
    found = materialize(found)
    labels = connected_components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    links = found.groupBy(F.col("node").alias("cls")).agg(F.sum("links").alias("n_links"))
    rooted = classes.select("cls", "least", "class_size").join(labels.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left").withColumn("root", F.coalesce("label", "cls"))
    resolved = skew_join(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "class_size", "component_id", "n_links")
    out = signed.select("doc_id", "n_shingles", "cls").join(resolved, "cls", "left")
    count: Callable[[str], Column] = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), count("class_size"), count("n_links"))
