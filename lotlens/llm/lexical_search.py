"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

An automaton of all terms of the items is sent to the tasks. Terms stand in it between guards (one blank on either
side), and every byte of a text that is in no term is read as a guard, so an output is exactly a whole term; outputs
count the terms of a text, and map to the items that hold them.

The texts are scanned twice. The first scan takes, for each term, the documents that hold it, and the number of
documents and of terms in all; each task sends only its sums. The second scores: the term counts of a text go through
the lists of items, and a task keeps the best rows of each item, at most `k`, since what is not among a task's best is
not among all; these are ranked last. No posting is ever shuffled.

Items are taken in parts of at most `PART_BYTES` of terms (but at least one item), with two scans for each part, so
what is sent is bounded; documents are never collected.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), all else whole numbers, so scores do not depend on the order
of a sum. A term counts once in an item.

Nulls: a document without a text has no terms; one without an id is ranked, behind others of its score. Items without
an id or without terms have no rows. Rows with one item id are one item with the terms of all. Ties go by id;
repeated documents are ranked one by one. Long texts are read whole. Empty tables give no rows. Other columns of the
inputs are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.llm import text as tx
from lotlens.llm.spark_util import materialize, pick

#: Bytes of terms whose automaton is sent at once (a node for each byte at most, some 50 bytes each).
PART_BYTES = 2 << 20
#: Counts of a slice of documents that go through the lists of items at once.
PAIRS = 1 << 18
#: Buckets in which each item's rows of all tasks are ranked before the last ranking.
BUCKETS = 16

#: Bytes of terms, A-Z lower-cased; all others are guards.
GUARDED = np.where(tx.ALNUM_WORD[tx.LOWER], tx.LOWER, 0x20).astype(np.uint8)


def terms_of(text: str | None) -> set[str]:
    return set(GUARDED[np.frombuffer((text or "").encode(), np.uint8)].tobytes().decode().split(" ")) - {""}


class TermScanner:
    """Counts of given terms in texts."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.n, self.automaton = len(terms), ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(terms):
            self.automaton.add_word(f" {term} ", k)
        if terms:
            self.automaton.make_automaton()

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The terms that occur and how often, of a text whose bytes are guarded."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.fromiter((k for _, k in self.automaton.iter(f" {text.decode()} ")), np.int64)
        return np.unique(found, return_counts=True)

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(row, terms in all, terms found, their counts) of each text."""
        for row, _, data, offsets in tx.slices(texts):
            data = GUARDED[data]
            _, _, first = tx.words(data, offsets, tx.ALNUM_WORD)
            for i, n in enumerate(np.diff(first).tolist()):
                yield row + i, n, *self.counts(data[offsets[i] : offsets[i + 1]].tobytes())


class ItemScores:
    """Scores of all items of a part by the lists of items of each term."""

    def __init__(self, item_terms: list[np.ndarray], weights: np.ndarray, documents: int, terms: int):
        items = np.repeat(np.arange(len(item_terms)), [len(t) for t in item_terms])
        term = np.concatenate([np.zeros(0, np.int64), *item_terms])
        order = np.argsort(term, kind="stable")
        self.items, self.begin = items[order], np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.size, self.weights, self.documents, self.terms = len(item_terms), weights, documents, terms

    def of(self, rows: np.ndarray, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score above 0); `n` is the length of the document of each (row, term, tf)."""
        m = 50 + (50 * n * self.documents) // self.terms
        part = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        width = self.begin[term + 1] - self.begin[term]
        at = np.repeat(self.begin[term] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        key = np.repeat(rows, width) * self.size + self.items[at]
        key, where = np.unique(key, return_inverse=True)
        score = np.zeros(len(key), np.int64)
        np.add.at(score, where, np.repeat(part, width))
        some = score > 0
        return key[some] // self.size, key[some] % self.size, score[some]


class BestRows:
    """The best k rows of each item seen so far, by falling score and rising id; pruned when it has doubled."""

    def __init__(self, items: int, k: int):
        self.k, self.kept = k, [np.zeros(0, np.int64)] * 4  # item, score, null id, id
        self.least, self.room = np.zeros(items, np.int64), max(1 << 16, 2 * items * k)

    def add(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.least[item]
        self.kept = [np.concatenate([a, b[good]]) for a, b in zip(self.kept, (item, score, null, doc), strict=True)]
        if len(self.kept[0]) > self.room:
            self.prune()

    def prune(self) -> None:
        item, score, null, doc = self.kept
        order = np.lexsort((doc, null, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        last = order[place == self.k - 1]
        self.least[item[last]] = score[last]
        self.kept = [a[order[place < self.k]] for a in self.kept]


def _part_terms(items: DataFrame) -> DataFrame:
    """item_id and term, each once, with the number of the part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = sorted(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.string())], ["item_id", "term"])

    terms = materialize(items.mapInArrow(run, "item_id long, term string").distinct())
    size = terms.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    return terms.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(-(-size // PART_BYTES) or 1)))


def _frequencies(wanted: DataFrame, terms: list[str]) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, documents with a term, terms in all."""
    sent = wanted.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = TermScanner(sent.value)
        held, documents, total = np.zeros(scanner.n, np.int64), 0, 0
        for batch in batches:
            for _, n, term, _ in scanner.scan(batch.column(0)):
                held[term] += 1
                documents, total = documents + (n > 0), total + n
        some = np.flatnonzero(held)
        keys, values = [*some.tolist(), -1, -2], [*held[some].tolist(), documents, total]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], ["key", "n"])

    # a row for each term of the part
    sums = dict(wanted.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect())
    return np.array([sums.get(k, 0) for k in range(len(terms))], np.int64), sums.get(-1, 0), sums.get(-2, 0)


def _best(wanted: DataFrame, terms: list[str], ids: list[int], item_terms: list[np.ndarray], k: int) -> DataFrame:
    """Each task's best rows of each item: item_id, score, doc_id."""
    held, documents, total = _frequencies(wanted, terms)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    sent = wanted.sparkSession.sparkContext.broadcast((terms, ids, item_terms, weights, documents, max(total, 1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, item_terms, weights, documents, total = sent.value
        scanner, scores, best = TermScanner(terms), ItemScores(item_terms, weights, documents, total), BestRows(len(ids), k)
        for batch in batches:
            null = np.asarray(batch.column(0).is_null()).astype(np.int64)
            doc = batch.column(0).fill_null(0).to_numpy()
            waiting: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            pairs = 0

            def settle() -> None:
                sizes = [len(t) for _, _, t, _ in waiting]
                row, n = (np.repeat(np.array([x[i] for x in waiting], np.int64), sizes) for i in (0, 1))
                row, item, score = scores.of(row, n, *(np.concatenate([np.zeros(0, np.int64), *[x[i] for x in waiting]]) for i in (2, 3)))
                best.add(item, score, null[row], doc[row])
                waiting.clear()

            for x in scanner.scan(batch.column(1)):
                waiting.append(x)
                pairs += int((scores.begin[x[2] + 1] - scores.begin[x[2]]).sum())
                if pairs > PAIRS:
                    settle()
                    pairs = 0
            settle()
        best.prune()
        item, score, null, doc = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[item]), pa.array(score), pa.array(doc, mask=null > 0)], ["item_id", "score", "doc_id"])

    return wanted.mapInArrow(run, "item_id long, score long, doc_id long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item with a score above 0."""
    wanted = pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col])
    terms = materialize(_part_terms(pick(items, item_id=items[item_id_col].cast("long"), text=items[item_text_col]).filter("item_id is not null")))
    best = None
    for (part,) in terms.select("part").distinct().orderBy("part").collect():  # a row for each PART_BYTES of terms
        rows = terms.filter(F.col("part") == part).select("item_id", "term").orderBy("item_id", "term").collect()
        names = sorted({r.term for r in rows})
        place = {t: n for n, t in enumerate(names)}
        ids = sorted({r.item_id for r in rows})
        own: dict[int, list[int]] = {i: [] for i in ids}
        for r in rows:
            own[r.item_id].append(place[r.term])
        found = _best(wanted, names, ids, [np.array(own[i], np.int64) for i in ids], k)
        best = found if best is None else materialize(best).union(found)
    if best is None:
        best = docs.sparkSession.createDataFrame([], "item_id long, score long, doc_id long")
    # the rows of all tasks are ranked in buckets first, so that no item's rows are one task's work
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = F.row_number().over(Window.partitionBy("item_id", "bucket").orderBy(*order))
    some = best.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))).withColumn("place", first).filter(F.col("place") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return some.select("item_id", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)
