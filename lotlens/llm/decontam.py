"""Benchmark decontamination: a BM25 inverted index of test items, queried with every training passage.

The index is over the items: impacts are BM25 weights divided by an item's own score, so that 1 is a passage with all
of its words; they are kept as whole numbers, so a sum is exact in any order. Items stand in blocks with the largest
impact of each word kept per block. Texts are cut into passages of two overlapping segments. For all passages of a
slice at once, the lists of the words without which no item reaches the threshold are read, and the blocks of items
that may reach it are walked with block-max WAND. Retrieved items are verified word by word: shares of the question's and the
answer's n-grams that the passage's surroundings hold.

Document frequencies, mean length and the number of items are taken by Spark over all items. The index is then built
in parts of about `INDEX_ITEMS` items of a like length, whose passages have the length of that class: a score, and
hence a result, depends on the item and the passage and not on what else is in the part. Documents are read once for
all parts that fit `BROADCAST_BYTES` together, which a task takes in turn; beyond that there is a pass for each such
group, and never more than one of them on the driver.

Nulls and empty texts or items match nothing, nor do items without an id. Equal items are one; an id with several
texts is found by each. Texts of any length are read whole, and lists of items for a bounded number of entries at once. Repeated documents are tested one by one. Empty tables give no rows. Other columns of the
inputs are not looked at.
"""

from __future__ import annotations

import pickle
import re
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm import text as tx
from lotlens.llm.spark_util import materialize, pick

INDEX_ITEMS, BLOCK = 500, 2
#: Index parts that are sent to the executors at once, and opened ones that a worker keeps.
BROADCAST_BYTES, OPEN_BYTES = 64 << 20, 128 << 20
#: Entries of the lists of items that are read at once.
GATHER = 1 << 20
K1, B = 1.2, 0.75
#: Words of the shortest class of items; the next is four times as long.
LEAST_STEP = 64
#: An item's own score.
UNIT = 1 << 40
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    data = tx.LOWER[raw]
    starts, ends, _ = tx.words(data, np.array([0, len(data)]), tx.ALNUM_WORD)
    return tx.word_hashes(data, starts, ends)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams; of the whole if it is shorter."""
    n = min(n, len(h))
    if n == 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = tx.mixed(out + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return out


def step_of(words: int) -> int:
    """Words of a segment for an item of so many: it lies within two segments wherever it begins."""
    step = LEAST_STEP
    while step < words:
        step *= 4
    return step


class ItemIndex:
    """Postings with normalised impacts, block maxima, and what verification needs, of items of one length class."""

    def __init__(self, items: list[tuple[int, str]], words: np.ndarray, frequency: np.ndarray, n: int, mean: float, gram: int = 5):
        """`words` holds sorted hashes of these items' words, `frequency` how many of all `n` items hold each."""
        rows = [(i, t, h) for i, t in items if len(h := _hashes(t))]
        # alike items stand together, so that a block's maxima are near its items' own impacts: first those that share
        # their most common word, hence a language, then those of about one length, hence of about one impact a word
        rows.sort(key=lambda x: (int(words[np.searchsorted(words, x[2])[np.argmax(frequency[np.searchsorted(words, x[2])])]]), len(x[2]), x[0], x[1]))
        self.vocabulary, self.ids = words, [i for i, *_ in rows]
        self.step = step_of(max((len(h) for *_, h in rows), default=1))
        self.blocks = -(-len(rows) // BLOCK)
        idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        terms, places, impacts = [], [], []
        self.parts = []
        for k, (_, text, h) in enumerate(rows):
            token, tf = np.unique(np.searchsorted(words, h), return_counts=True)
            impact = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))
            terms.append(token)
            places.append(np.full(len(token), k, np.int32))
            impacts.append(np.rint(impact / impact.sum() * UNIT).astype(np.int64))
            pieces = [p for p in _SENTENCE.split(text) if len(_hashes(p))]
            answer = _hashes(pieces[-1]) if len(pieces) > 1 else h
            question = _hashes(" ".join(pieces[:-1])) if len(pieces) > 1 else h
            self.parts.append([(min(gram, len(q)), np.unique(_grams(q, gram))) for q in (question, answer, h)])
        term, place, impact = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (terms, places, impacts))
        order = np.argsort(term, kind="stable")
        self.term, self.place, self.impact = term[order].astype(np.int64), place[order].astype(np.int64), impact[order].astype(np.int64)
        self._open()

    def _open(self) -> None:
        self.begin = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1))
        self.block_max = np.zeros((len(self.vocabulary), self.blocks), np.float32)
        np.maximum.at(self.block_max, (self.term, self.place // BLOCK), self.impact.astype(np.float32))
        self.block_max *= np.float32(1.000001)
        self.term_max = np.zeros(len(self.vocabulary), np.int64)
        np.maximum.at(self.term_max, self.term, self.impact)
        self.by_item = np.argsort(self.place, kind="stable")
        self.own = np.searchsorted(self.place[self.by_item], np.arange(len(self.ids) + 1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("begin", "block_max", "term_max", "by_item", "own")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    @staticmethod
    def alone(items: list[tuple[int, str]], gram: int = 5) -> ItemIndex:
        """An index of a few items by their own statistics."""
        sets = [np.unique(h) for _, t in items if len(h := _hashes(t))]
        words, frequency = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        return ItemIndex(items, words, frequency, len(sets), float(np.mean([len(_hashes(t)) for _, t in items if len(_hashes(t))] or [1.0])), gram)

    def postings(self, token: int) -> tuple[list[int], list[int]]:
        part = slice(self.begin[token], self.begin[token + 1])
        return self.place[part].tolist(), self.impact[part].tolist()

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary of each hash, or -1."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def search(self, tokens: Iterable[int], threshold: int, blocks: set[int] | None = None) -> list[tuple[int, int]]:
        """(item place, score) of all items that reach the threshold for a set of words, by block-max WAND.

        Lists are kept by their next item; the pivot is the first item whose lists could reach the threshold by their
        overall maxima; block maxima then decide whether it is scored or all its lists skip the block.
        """
        lists = []
        for t in tokens:
            places, impacts = self.postings(t)
            if places:
                lists.append([places, 0, int(self.term_max[t]), self.block_max[t], impacts])
        found = []
        while True:
            lists = [x for x in lists if x[1] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[1]])
            bound, pivot = 0, -1
            for i, x in enumerate(lists):
                bound += x[2]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0][lists[pivot][1]]
            block = item // BLOCK
            tied = [x for x in lists if x[0][x[1]] <= item]
            if (blocks is not None and block not in blocks) or sum(float(x[3][block]) for x in lists if x[0][x[1]] < (block + 1) * BLOCK) < threshold:
                for x in lists:
                    while x[1] < len(x[0]) and x[0][x[1]] < (block + 1) * BLOCK:
                        x[1] += 1
            elif lists[0][0][lists[0][1]] == item:
                score = sum(x[4][x[1]] for x in tied)
                if score >= threshold:
                    found.append((item, score))
                for x in tied:
                    x[1] += 1
            else:
                for x in tied:
                    while x[1] < len(x[0]) and x[0][x[1]] < item:
                        x[1] += 1

    def verify(self, item: int, passage: np.ndarray) -> tuple[float, float, float]:
        """Shares of the question's, the answer's and the whole item's n-grams in a passage."""
        return tuple(float(np.isin(grams, _grams(passage, n)).mean()) for n, grams in self.parts[item])


Hits = dict[tuple[int, int], tuple[float, float, float, int]]


def _blocks_in_reach(index: ItemIndex, word: np.ndarray, begin: np.ndarray, ends_of: np.ndarray, least: int) -> Iterator[tuple[int, set[int]]]:
    """(passage, blocks) where some item may reach the threshold; a passage's distinct words stand from begin to ends_of.

    A passage's words are ordered by the largest impact that each has on any item. The first ones, which together
    stay under the threshold, can't bring an item there alone, so only the lists of the others are read; the largest
    impacts of the first ones are added to what those give. So frequent words, which are in many items and matter to
    none, cost nothing. Items that still may reach it are scored by their own words. Lists are read for as many
    passages at once as give `GATHER` entries.
    """
    width, every, of = len(index.vocabulary), word, np.repeat(np.arange(len(begin)), ends_of - begin)
    passage = of
    most = index.term_max[word]
    order = np.lexsort((word, most, passage))
    word, most = word[order], most[order]
    total = np.cumsum(most)
    total -= np.repeat(total[begin] - most[begin], ends_of - begin)
    first = total < least
    rest = np.zeros(len(begin), np.int64)
    np.add.at(rest, passage[first], most[first])
    passage, word = passage[~first], word[~first]
    lists = index.begin[word + 1] - index.begin[word]
    entries = np.concatenate([[0], np.cumsum(lists)])
    edges = np.searchsorted(passage, np.arange(len(begin) + 1))
    i = 0
    while i < len(begin):
        j = max(i + 1, min(i + 1 + GATHER // len(index.ids), i + 1 + 16 * GATHER // width, int(np.searchsorted(entries[edges], entries[edges[i]] + GATHER, "right")) - 1))
        j = min(j, len(edges) - 1)
        part = slice(edges[i], edges[j])
        n = lists[part]
        at = np.arange(n.sum()) + np.repeat(index.begin[word[part]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        low, cells = i, (j - i) * len(index.ids)
        # sums of whole numbers under 2^53 are exact as doubles
        score = np.bincount(np.repeat((passage[part] - low) * len(index.ids), n) + index.place[at], index.impact[at], cells).reshape(-1, len(index.ids))
        near = np.flatnonzero(score >= (least - rest[low : low + len(score)])[:, None])
        key = near + low * len(index.ids)
        held = np.zeros((j - i) * width, bool)
        own = slice(begin[i], ends_of[j - 1])
        held[(of[own] - low) * width + every[own]] = True
        for c in range(0, len(key), GATHER // 256):
            some = key[c : c + GATHER // 256]
            p, item = some // len(index.ids), some % len(index.ids)
            n = index.own[item + 1] - index.own[item]
            at = index.by_item[np.arange(n.sum()) + np.repeat(index.own[item] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)]
            sums = np.concatenate([[0], np.cumsum(np.where(held[np.repeat(p - low, n) * width + index.term[at]], index.impact[at], 0))])
            ends = np.cumsum(n)
            key[c : c + GATHER // 256] = np.where(sums[ends] - sums[ends - n] >= least, some, -1)
        key = key[key >= 0]
        found, start = np.unique(key // len(index.ids), return_index=True)
        for k, blocks in zip(found.tolist(), np.split(key % len(index.ids) // BLOCK, start)[1:], strict=True):
            yield k, set(blocks.tolist())
        i = j


def passage_hits(index: ItemIndex, h: np.ndarray, first: np.ndarray, threshold: float, overlap: float) -> Hits:
    """By (text, item place): the best verified passage's overlaps and first word, of texts with word hashes `h`.

    Of equally good passages the first holds.
    """
    token = index.look_up(h)
    step, least = index.step, -int(-threshold * UNIT // 1)
    n = np.diff(first)
    segments = -(-n // step)
    base = np.concatenate([[0], np.cumsum(segments)])
    doc = np.repeat(np.arange(len(n)), n)
    segment = base[doc] + (np.arange(len(h)) - first[doc]) // step
    known = token >= 0
    segment, token, begins = segment[known], token[known], base[doc[known]]
    # passage s is segments s and s + 1 of a text; a word counts once in it, so both are joined before they are summed
    width = len(index.vocabulary) + 1
    back = segment > begins
    pair = np.unique(np.concatenate([segment * width + token, (segment[back] - 1) * width + token[back]]))
    out: Hits = {}
    if not len(pair):
        return out
    passage_of, word = pair // width, pair % width
    some, begin = np.unique(passage_of, return_index=True)
    ends_of = np.append(begin[1:], len(word))
    for k, blocks in _blocks_in_reach(index, word, begin, ends_of, least):
        s = int(some[k])
        d = int(np.searchsorted(base, s, "right") - 1)
        lo = int(first[d] + (s - base[d]) * step)
        passage = h[lo : min(lo + 2 * step, int(first[d + 1]))]
        for item, _ in index.search(word[begin[k] : ends_of[k]].tolist(), least, blocks):
            question, answer, whole = index.verify(item, passage)
            if (min(question, answer) >= overlap or whole >= overlap) and out.get((d, item), (-1.0,))[0] < whole:
                out[d, item] = (whole, question, answer, lo - int(first[d]))
    return out


def _word_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part and hash of each item's distinct words."""
    for batch in batches:
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = np.unique(_hashes(text)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), part)), pa.array(h)], ["part", "h"])


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(_hashes(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array([step_of(x) for x in n], pa.int64())], ["item_id", "text", "n", "step"])


def build_index(items: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """part, size in bytes and blob of each part of the index, built where the part is."""
    rows = pick(items, item_id=items[item_id_col].cast("long"), text=items[item_text_col]).dropna().distinct()
    rows = materialize(rows.mapInArrow(_lengths, "item_id long, text string, n long, step long").filter("n > 0"))
    n, mean = rows.agg(F.count("*"), F.avg("n")).first()
    classes = rows.groupBy("step").agg(F.ceil(F.count("*") / INDEX_ITEMS).alias("parts"))
    number = F.col("step") * (1 << 32) + F.pmod(F.xxhash64("item_id", "text"), "parts")
    parted = rows.join(F.broadcast(classes), "step").select(number.alias("part"), "item_id", "text")  # a row for each power of four
    words = parted.select("part", "text").mapInArrow(_word_sets, "part long, h long")
    frequency = words.groupBy("h").agg(F.count("*").alias("df"))
    known = words.distinct().join(frequency, "h")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h = right.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        index = ItemIndex(list(zip(left.column("item_id").to_pylist(), left.column("text").to_pylist(), strict=True)), h[order], right.column("df").to_numpy()[order], n, mean)
        blob = pickle.dumps(index, 5)
        return pa.table([left.column("part")[:1], pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], ["part", "size", "blob"])

    return parted.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, "part long, size long, blob binary")


class _Open:
    """Parts of a broadcast list, opened when they are needed; the last ones stay open up to OPEN_BYTES."""

    def __init__(self, blobs: list[bytes]):
        self.blobs, self.kept, self.size = blobs, OrderedDict(), 0

    def __iter__(self) -> Iterator[ItemIndex]:
        for k, blob in enumerate(self.blobs):
            if k not in self.kept:
                self.kept[k] = pickle.loads(blob)
                self.size += self.kept[k].block_max.nbytes + len(blob)
                while self.size > OPEN_BYTES and len(self.kept) > 1:
                    _, old = self.kept.popitem(last=False)
                    self.size -= old.block_max.nbytes
            self.kept.move_to_end(k)
            yield self.kept[k]


def _groups(index: DataFrame) -> Iterator[list[bytes]]:
    """Blobs of parts that fit BROADCAST_BYTES together; a part of its own size if it alone is larger."""
    group, size = [], 0
    for r in index.select("part", "size").orderBy("part").collect():  # a row for each INDEX_ITEMS items
        if group and size + r["size"] > BROADCAST_BYTES:
            yield [bytes(x.blob) for x in index.filter(F.col("part").isin(group)).orderBy("part").select("blob").collect()]
            group, size = [], 0
        group.append(r.part)
        size += r["size"]
    if group:
        yield [bytes(x.blob) for x in index.filter(F.col("part").isin(group)).orderBy("part").select("blob").collect()]


Found = Callable[[pa.RecordBatch, pa.Array], Iterator[tuple[int, int, list[tuple[ItemIndex, Hits]]]]]


def _finder(docs: DataFrame, blobs: list[bytes], threshold: float, overlap: float) -> Found:
    """(first row, end row, hits in each part of the index) of the slices of a batch's texts."""
    sent = docs.sparkSession.sparkContext.broadcast(blobs)

    def hits(batch: pa.RecordBatch, texts: pa.Array, opened: list[_Open] = []) -> Iterator[tuple[int, int, list[tuple[ItemIndex, Hits]]]]:  # noqa: B006
        if not opened:
            opened.append(_Open(sent.value))
        for row, stop, data, offsets in tx.slices(texts, 1 << 20):
            data = tx.LOWER[data]
            starts, ends, first = tx.words(data, offsets, tx.ALNUM_WORD)
            h = tx.word_hashes(data, starts, ends)
            yield row, stop, [(index, passage_hits(index, h, first, threshold, overlap)) for index in opened[0]]

    return hits


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """A row (doc_id, item_id, overlap, question_overlap, answer_overlap, first_word) for each item a document holds.

    threshold: the part of an item's own BM25 score that a passage must reach to be retrieved. overlap: the share of
    n-grams of question and answer, or of the whole item, that it must hold. An item's last sentence is its answer.
    """
    wanted = pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col])
    schema = "doc_id long, item_id long, overlap double, question_overlap double, answer_overlap double, first_word long"

    def found(blobs: list[bytes]) -> DataFrame:
        finder = _finder(docs, blobs, threshold, overlap)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, _, parts in finder(batch, batch.column(1)):
                    rows = sorted((row + d, index.ids[i], *hit) for index, hits in parts for (d, i), hit in hits.items())
                    columns = list(zip(*rows, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:5]), pa.array(columns[5], pa.int64())], [x.split()[0] for x in schema.split(", ")])

        return wanted.mapInArrow(run, schema)

    index = materialize(build_index(items, item_id_col, item_text_col))
    out = None
    for blobs in _groups(index):
        out = found(blobs) if out is None else materialize(out).union(found(blobs))  # one group at a time is sent
    out = found([]) if out is None else out
    return out.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("overlap", "question_overlap", "answer_overlap")], "first_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose texts hold no item. Each row is judged by its text alone, so neither ids nor joins are needed."""

    def kept(given: DataFrame, blobs: list[bytes]) -> DataFrame:
        finder = _finder(docs, blobs, threshold, overlap)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _, parts in finder(batch, batch.column(batch.schema.get_field_index(text_col))):
                    clean[np.array([row + d for _, hits in parts for d, _ in hits], np.int64)] = False
                yield batch.filter(pa.array(clean))

        return given.mapInArrow(run, given.schema)

    out = docs
    for k, blobs in enumerate(_groups(materialize(build_index(items, item_id_col, item_text_col)))):
        out = kept(materialize(out) if k else out, blobs)
    return out
