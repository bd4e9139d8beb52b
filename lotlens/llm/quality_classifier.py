"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Every token (a run of letters and digits, or of other signs) has a sparse ternary index vector, drawn from its hash.
A token's word vector is the sum of the index vectors of its neighbours over all documents: whole numbers, summed by
Spark over hashed buckets, so the model is the same however the work is split and has a fixed size. A document is the
mean vector of its tokens and of its distinct tokens with a few shape figures. The network is fitted on a bounded
sample of labelled rows, and its logits are divided by a temperature fitted on rows kept aside.

Labels, language, source and id are never inputs of a score. Null and empty texts get the score of an all-zero
document. Repeated rows are scored one by one; an empty table gives no rows. Words share buckets: 16,384 of them hold
the 280,000 words of the tables of scale 0.1, the frequent ones of which decide; `BUCKETS` and `DIM` set the size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm import text as tx
from lotlens.llm.spark_util import pick

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 2, 2
#: Bytes whose token vectors are in memory at once.
SLICE = 1 << 20
SHAPES = 6

_all = np.arange(256)
#: 0 between tokens, 1 letters and digits, 2 other signs.
_KIND = np.where(tx.SPACE_WORD, 2, 0)
_KIND[tx.ALNUM_WORD | ((_all >= 0x41) & (_all <= 0x5A))] = 1

_rng = np.random.default_rng(8)
_AT = _rng.integers(0, DIM, (BUCKETS, NONZERO))
_SIGN = _rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, byte lengths and kinds of the tokens, and where each text's begin."""
    kind = np.zeros(len(data) + 1, np.int8)
    kind[:-1] = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    change = edge.copy()
    change[0] = True
    change[1:] |= kind[1:] != kind[:-1]
    bounds = np.flatnonzero(change)
    starts = bounds[kind[bounds] > 0]
    ends = np.append(bounds, len(data))[np.searchsorted(bounds, starts) + 1]
    h = tx.word_hashes(tx.LOWER[data], starts, ends)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), ends - starts, kind[starts], np.searchsorted(starts, offsets)


def _count_contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * DIM, np.int64)
    seen = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offsets in tx.slices(batch.column(0), SLICE):
            b, _, _, first = tokens(data, offsets)
            seen += np.bincount(b, minlength=BUCKETS)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for reach in range(1, REACH + 1):
                same = doc[reach:] == doc[:-reach]
                left, right = b[:-reach][same], b[reach:][same]
                for k in range(NONZERO):
                    for word, near in ((left, right), (right, left)):
                        total += np.bincount(word * DIM + _AT[near, k], weights=_SIGN[near, k], minlength=BUCKETS * DIM).astype(np.int64)
    some = np.flatnonzero(seen)
    table = total.reshape(BUCKETS, DIM)[some]
    for lo in range(0, len(some), 4096):
        part = slice(lo, lo + 4096)
        yield pa.RecordBatch.from_arrays([pa.array(some[part]), pa.array(seen[some[part]]), *(pa.array(np.ascontiguousarray(table[part, d])) for d in range(DIM))], ["bucket", "n", *(f"v{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors of all buckets, counted over every document; at most BUCKETS rows reach the driver."""
    names = [f"v{d}" for d in range(DIM)]
    counted = docs.select(text_col).mapInArrow(_count_contexts, "bucket long, n long, " + ", ".join(f"{c} long" for c in names))
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros((BUCKETS, DIM), np.float64)
    if len(rows):
        # the mean context of all words says nothing on any of them
        values, n = rows[names].to_numpy(np.float64), rows["n"].to_numpy(np.float64)
        values -= n[:, None] * (values.sum(0) / n.sum())
        out[rows["bucket"].to_numpy()] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def document_features(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 2 * DIM + SHAPES numbers for each text; zeros without tokens."""
    b, size, kind, first = tokens(data, offsets)
    docs = len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    pair, count = np.unique(doc * BUCKETS + b, return_counts=True)
    owner, bucket = pair // BUCKETS, pair % BUCKETS
    n, distinct = np.bincount(doc, minlength=docs), np.bincount(owner, minlength=docs)
    out = np.zeros((docs, 2 * DIM + SHAPES), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        begin = np.searchsorted(owner, some)
        v = vectors[bucket]
        out[some, DIM : 2 * DIM] = np.add.reduceat(v, begin) / distinct[some, None]
        out[some, :DIM] = np.add.reduceat(v * count[:, None].astype(np.float32), begin) / n[some, None]
        word = np.maximum(np.bincount(doc, weights=kind == 1, minlength=docs), 1)
        top = np.zeros(docs)
        np.maximum.at(top, owner, count)
        letters = np.bincount(doc, weights=size * (kind == 1), minlength=docs) / word
        spread = np.bincount(doc, weights=(size > 10) & (kind == 1), minlength=docs) / word
        shapes = np.stack([np.log1p(n) / 10, distinct / np.maximum(n, 1), np.bincount(doc, weights=kind == 2, minlength=docs) / np.maximum(n, 1), letters / 10, spread, top / np.maximum(n, 1)], 1)
        out[some, 2 * DIM :] = shapes[some]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 1500, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the logistic loss; every fifth row sets the temperature alone. One class or no rows: a constant."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    aside = np.arange(len(x)) % 5 == 4
    if len(x) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(x) else 0.5, 0.01, 0.99))
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    net = Network(x[~aside].mean(0), x[~aside].std(0) + 1e-3, rng.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), 0.0)
    xs, ys = ((x - net.mean) / net.scale)[~aside], y[~aside]
    theta = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        pick_rows = rng.integers(0, len(xs), min(batch, len(xs)))
        a, t = xs[pick_rows], ys[pick_rows]
        h = np.maximum(a @ theta[0] + theta[1], 0)
        error = (1 / (1 + np.exp(-np.clip(h @ theta[2] + theta[3], -30, 30))) - t) / len(a)
        back = np.outer(error, theta[2]) * (h > 0)
        for i, g in enumerate((a.T @ back + decay * theta[0], back.sum(0), h.T @ error + decay * theta[2], np.array([error.sum()]))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] - rate * (1 - step / (steps + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(net.mean, net.scale, theta[0], theta[1], theta[2], float(theta[3][0]))
    if aside.any():
        z, t = net.logits(x[aside]), y[aside]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> Network:
    """Fit on at most `max_labelled` labelled rows, those whose ids have the smallest hashes.

    The caller passes only the labels that may be learnt. Of two labels of an id the larger holds; null ids and labels
    are not learnt from. The bound also bounds the ids sent to the executors and the features sent to the driver (280
    bytes a row).
    """
    bounded = pick(labels, doc_id=labels[id_col].cast("long"), label=labels[label_col].cast("double")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    bounded = bounded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col]).join(F.broadcast(bounded), "doc_id").select("text", "label", "doc_id")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in tx.slices(batch.column(0), SLICE):
                x = document_features(vectors, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(row, stop - row), batch.column(1).slice(row, stop - row), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    made = chosen.mapInArrow(features, "doc_id long, label double, x binary")  # more rows than ids where ids repeat
    rows = sorted(made.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_labelled).collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), 2 * DIM + SHAPES).astype(np.float64)
    return fit_network(x, np.array([r.label for r in rows]))


def score_quality(docs: DataFrame, vectors: np.ndarray, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text; one narrow pass with a model of fixed size (2 MB)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in tx.slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(net.scores(document_features(vectors, data, offsets)), pa.float64())], ["doc_id", "score"])

    return pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col]).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> DataFrame:
    """The rows, with all columns, whose texts are predicted to be good. Each row is judged by its text alone, so neither ids nor joins are needed."""
    vectors = word_vectors(docs, text_col)
    net = train(docs, labels, vectors, id_col, text_col, label_col, max_labelled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            scores = [net.scores(document_features(vectors, data, offsets)) for _, _, data, offsets in tx.slices(column, SLICE)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> DataFrame:
    """doc_id, score and predicted (1 from a score of 0.5) of every document."""
    vectors = word_vectors(docs, text_col)
    net = train(docs, labels, vectors, id_col, text_col, label_col, max_labelled)
    return score_quality(docs, vectors, net, id_col, text_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
