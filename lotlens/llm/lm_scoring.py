"""Cross-entropy difference between two n-gram models over one vocabulary.

A target model and a background model of the same order count the same words. The vocabulary is every word that the
corpus as a whole holds `least` times or more, and one unknown word for all others; words are mapped to it before
bigrams are formed. Both models are interpolated bigram models and sum to 1 over the vocabulary after any word: where
a model has never seen the word before, its one-word part has the whole weight. A document's score is its mean loss
per token under the target model less that under the background model: the lower, the more like the target.

A document is in one of the two corpora itself. Its own counts are left out of that model when it is scored, so the
score tells what it is like and not on which list it stands. Copies of it are other documents and stay.

Words and bigrams are counted exactly, under hashes of 64 bits, and neither model is ever in one place. Documents are
cut into chunks, each kept as its distinct words and the places of its tokens among them. A chunk sends its own
distinct words with its counts, in order and by ranges of the hash; the totals come back to it in the order sent,
without the keys, and tell it which words are known; then the same is done with bigrams. A word or bigram is sent
once by a chunk, however frequent it is, so no range is hot.

Labels reach a chunk as a bit for each document, so no text is exchanged.

Null and empty texts have no tokens, losses and a score of 0. Rows without a target label belong to the background
alone. Repeated rows count and are scored one by one; rows that share an id share its label. An empty table gives no
rows. Columns of the input other than the id and the text are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm import text as tx
from lotlens.llm.spark_util import materialize, pick

#: Bytes of text in a chunk, unless a single text is longer; tokens whose keys one range of the hash takes.
CHUNK_BYTES, RANGE_TOKENS = 12 << 20, 2_000_000
_NEXT = np.uint64(0xA24BAED4963EE407)
#: Place in a pair of a text's first word.
_START = np.uint64(0x2545F4914F6CDD1D)
#: What pairs hold in place of a word outside the vocabulary.
_UNKNOWN = np.uint64(0x9E6C63D0876A9A35)
#: Over the distinct words of a range: how many are known, and counts of the unknown ones and of all.
_SUMS = ["known", "rare_background", "rare_target", "rare_before_background", "rare_before_target", "all_background", "all_target"]


def _shut(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of equal weight together, which compress better."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.copy()


def _values(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class Chunk:
    """Some whole documents: their ids, distinct words, and each token's place among these."""

    def __init__(self, blob: bytes):
        self.ids, self.null, self.first, words, tokens = _opened(blob)
        stored = _values(words, np.uint64)
        order = np.argsort(stored)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.words, self.token = stored[order], place[_values(tokens, np.uint32)]
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[self.first[:-1][np.diff(self.first) > 0]] = np.searchsorted(self.words, _START)

    def pairs(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct bigrams over the vocabulary, and each token's place among them."""
        shared = np.where(known | (self.words == _START), self.words, _UNKNOWN)
        return np.unique(tx.mixed(shared[self.before] * _NEXT + shared[self.token]), return_inverse=True)

    @staticmethod
    def write(ids: pa.Array, first: np.ndarray, hashes: np.ndarray) -> bytes:
        """Words are stored by falling classes of frequency, so that most places are small and compress."""
        words, place, n = np.unique(np.append(hashes, _START), return_inverse=True, return_counts=True)
        order = np.argsort(-np.log2(n).astype(np.int64), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        return _shut(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), first, _planes(words[order]), _planes(rank[place[:-1]]))

    def counts(self, target: np.ndarray, places: np.ndarray, n: int) -> list[np.ndarray]:
        """Background and target counts of the n keys."""
        mine = np.repeat(target, np.diff(self.first))
        return [np.bincount(places[side], minlength=n).astype(np.int32) for side in (~mine, mine)]

    def word_counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words, and their counts as a token and as the word before one."""
        n = len(self.words)
        return self.words, np.stack([*self.counts(target, self.token, n), *self.counts(target, self.before, n)])

    def pair_counts(self, target: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, places = self.pairs(known)
        return keys, np.stack(self.counts(target, places, len(keys)))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for row, stop, data, offsets in tx.slices(batch.column(1), CHUNK_BYTES):
            data = tx.LOWER[data]
            starts, ends, first = tx.words(data, offsets, tx.ALNUM_WORD)
            blob = Chunk.write(batch.column(0).slice(row, stop - row), first, tx.word_hashes(data, starts, ends))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([stop - row]), pa.array([len(starts)]), pa.array([blob], pa.binary())], ["chunk", "docs", "tokens", "blob"])
            number += 1


def _ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, chunk and place in it of each document with an id."""
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids, null, *_ = _opened(blob.as_py())
            at = np.flatnonzero(~null)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), chunk)), pa.array(at)], ["doc_id", "chunk", "place"])


def _bits(table: pa.Table) -> pa.Table:
    bits = np.zeros(int(table.column("place").to_numpy().max()) + 1, bool)
    bits[table.column("place").to_numpy()] = True
    return pa.table([table.column("chunk")[:1], pa.array([np.packbits(bits).tobytes()], pa.binary())], ["chunk", "blob"])


def _parts(table: pa.Table) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """A chunk from its rows by kind: the chunk (0), the target bit of each document (1), the totals of its words (2)."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "range", "blob")), strict=True), key=lambda r: r[:2])
    chunk = Chunk(rows[0][2])
    bits = next((np.unpackbits(np.frombuffer(b, np.uint8))[: len(chunk.ids)] for k, _, b in rows if k == 1), [])
    target = np.zeros(len(chunk.ids), bool)
    target[: len(bits)] = bits
    return chunk, target, np.concatenate([np.zeros((4, 0), np.int32), *(_opened(b)[0] for k, _, b in rows if k == 2)], 1)


def _sent(parts: DataFrame, least: int | None, ranges: int) -> DataFrame:
    """chunk, range and a blob of the range's keys and counts: of words, or of bigrams of words with `least` in all."""

    def run(table: pa.Table) -> pa.Table:
        chunk, target, words = _parts(table)
        keys, counts = chunk.word_counts(target) if least is None else chunk.pair_counts(target, words[:2].sum(0) >= least)
        range_of = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        some, lo = np.unique(range_of, return_index=True)
        blobs = [_shut(_planes(keys[a:b]), counts[:, a:b]) for a, b in pairwise([*lo, len(keys)])]  # none without keys
        return pa.table([pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64()), pa.array(some), pa.array(blobs, pa.binary())], ["chunk", "range", "blob"])

    return parts.groupBy("chunk").applyInArrow(run, "chunk long, range long, blob binary")


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of a range, their totals, each sent key's place among them, and how many each chunk sent."""
    parts = [_opened(b.as_py()) for b in table.column("blob")]
    keys, place = np.unique(np.concatenate([_values(k, np.uint64) for k, _ in parts]), return_inverse=True)
    totals = np.zeros((len(parts[0][1]), len(keys)), np.int64)
    done = 0
    for _, counts in parts:  # a chunk's keys are distinct
        totals[:, place[done : done + counts.shape[1]]] += counts
        done += counts.shape[1]
    return keys, totals, place, [c.shape[1] for _, c in parts]


def _returned(sent: DataFrame, ranges: int, least: int = 0) -> DataFrame:
    """chunk, range and the totals of the keys that the chunk sent; sums over the range's distinct words in its first row."""

    def run(table: pa.Table) -> pa.Table:
        keys, totals, place, sizes = _summed(table)
        ends = np.cumsum(sizes)
        blobs = [_shut(totals[:, place[b - n : b]].astype(np.int64 if totals.max() >> 31 else np.int32)) for n, b in zip(sizes, ends, strict=True)]
        known = totals[:2].sum(0) >= least
        rare = totals[:, ~known & (keys != _START)].sum(1).tolist()
        sums = [int(known.sum()), *rare, *[0] * (4 - len(rare)), *totals[:2].sum(1).tolist()]
        rest = [0] * (len(sizes) - 1)
        return pa.table([table.column("chunk"), table.column("range"), pa.array(blobs, pa.binary()), *(pa.array([x, *rest], pa.int64()) for x in sums)], ["chunk", "range", "blob", *_SUMS])

    return _dealt(sent, "range", ranges).groupBy("range").applyInArrow(run, "chunk long, range long, blob binary, " + ", ".join(f"{c} long" for c in _SUMS))


def _dealt(df: DataFrame, key: str, keys: int) -> DataFrame:
    """By a key into as many partitions as it has values, so that a task's share doesn't grow with the input."""
    return df.repartition(max(keys, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


@dataclass(frozen=True)
class Sums:
    """What both models share with every chunk.

    size: words of the vocabulary, the unknown one with them. rare: tokens of unknown words, and places after them, in
    background and target. tokens: all of either. weight: of the bigram part. least: occurrences of a known word.
    """

    size: int
    rare: np.ndarray
    tokens: np.ndarray
    weight: float
    least: int

    def losses(self, chunk: Chunk, target: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """A row for each model with the loss of each token of a chunk, from the totals of its words and bigrams.

        What a document counts itself is taken off the totals of its own side.
        """
        known = words[:2].sum(0) >= self.least
        place = np.where(known, np.arange(len(known)), len(known))
        token = place[chunk.token]
        before = np.where(chunk.before == np.searchsorted(chunk.words, _START), chunk.before, place[chunk.before])
        pair = chunk.pairs(known)[1]
        totals = np.concatenate([words, self.rare[:, None]], 1)
        n = np.diff(chunk.first)
        doc = np.repeat(np.arange(len(n)), n)
        own = [_own(doc, x) for x in (token, before, pair)]
        out = np.empty((2, len(token)))
        for side in (0, 1):
            mine = target[doc] == side
            alone = (totals[side, token] - mine * own[0] + 1) / (self.tokens[side] - mine * n[doc] + self.size)
            follows = totals[2 + side, before] - mine * own[1]
            both = (pairs[side, pair] - mine * own[2]) / np.maximum(follows, 1)
            out[side] = -np.log(np.where(follows > 0, (1 - self.weight) * alone + self.weight * both, alone))
        return out


@dataclass(frozen=True)
class PairModel:
    """Both models over the corpus that they count: its chunks with the totals of each chunk's words, and their sums."""

    parts: DataFrame
    chunks: int
    ranges: int
    sums: Sums

    def sent_pairs(self) -> DataFrame:
        return _sent(self.parts, self.sums.least, self.ranges)

    def pair_totals(self) -> DataFrame:
        """A row (background, target) for each distinct bigram of the corpus."""

        def run(table: pa.Table) -> pa.Table:
            return pa.table([pa.array(x) for x in _summed(table)[1]], ["background", "target"])

        return self.sent_pairs().groupBy("range").applyInArrow(run, "background long, target long")

    @property
    def pair(self) -> np.ndarray:
        """The bigram totals on the driver: for looking into small corpora, no operator needs it."""
        return np.array([tuple(r) for r in self.pair_totals().collect()], float).reshape(-1, 2)


def _own(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each token's place stands in the token's own document."""
    _, at, n = np.unique(doc * (place.max(initial=0) + 1) + place, return_inverse=True, return_counts=True)
    return n[at]


def fit_models(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = 0.6, least: int = 2) -> PairModel:
    """Models of the documents whose ids are in `targets`, and of all others; nine numbers reach the driver.

    The target ids grow with the corpus, so they are merged with the documents at every size and never broadcast.
    """
    chunks = materialize(pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col]).mapInArrow(_chunks, "chunk long, docs long, tokens long, blob binary"))
    n, tokens = (x or 0 for x in chunks.agg(F.count("*"), F.sum("tokens")).first())
    wanted = pick(targets, doc_id=targets[id_col].cast("long")).dropna().distinct()
    placed = chunks.select("chunk", "blob").mapInArrow(_ids, "doc_id long, chunk long, place long")
    bits = placed.join(wanted.hint("merge"), "doc_id").select("chunk", "place").groupBy("chunk").applyInArrow(_bits, "chunk long, blob binary")
    kind = lambda df, k, r=F.lit(0).cast("long"): df.select("chunk", F.lit(k).alias("kind"), r.alias("range"), "blob")
    parts = kind(chunks, 0).union(kind(materialize(bits), 1))
    ranges = max(1, -(-tokens // RANGE_TOKENS))
    words = materialize(_returned(_sent(_dealt(parts, "chunk", n), None, ranges), ranges, least))
    known, *sums = (x or 0 for x in words.agg(*[F.sum(c) for c in _SUMS]).first())
    parts = _dealt(parts.union(kind(words, 2, F.col("range"))), "chunk", n)
    return PairModel(parts, n, ranges, Sums(known + 1, np.array(sums[:4], np.int64), np.array(sums[4:], np.int64), weight, least))


def score_documents(model: PairModel) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every whole text of the model's corpus."""

    sums = model.sums

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, target, words = _parts(left)
        blobs = sorted(zip(right.column("range").to_pylist(), right.column("blob").to_pylist(), strict=True))
        loss = sums.losses(chunk, target, words, np.concatenate([np.zeros((2, 0), np.int32), *(_opened(b)[0] for _, b in blobs)], 1))
        n = np.diff(chunk.first)
        some, mean = np.flatnonzero(n), np.zeros((2, len(n)))
        if len(some):  # each document's own sum, which no running sum over the chunk has rounded
            mean[:, some] = np.add.reduceat(loss, chunk.first[some], axis=1) / n[some]
        columns = [pa.array(chunk.ids, pa.int64(), mask=chunk.null), pa.array(n, pa.int64()), pa.array(mean[1]), pa.array(mean[0]), pa.array(mean[1] - mean[0])]
        return pa.table(columns, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    pairs = _dealt(_returned(model.sent_pairs(), model.ranges).select("chunk", "range", "blob"), "chunk", model.chunks)
    out = model.parts.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score_documents(fit_models(docs, targets, id_col, text_col))
