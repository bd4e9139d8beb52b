"""Best-fit packing of token sequences by linear grouping.

Texts are tokenised once. A text of over `capacity` tokens is cut into full pieces behind a shorter first one; every
other piece is packed whole. The plan is made from the histogram of piece lengths alone, at most `capacity` numbers:
large lengths are sorted into groups of equal cardinality, at most `GROUPS`, and rounded up to the largest of their
group. The linear programme over all configurations of these few sizes is solved by column generation (a knapsack
finds the configuration that most improves the last solution). The pieces themselves then take the places of its at
most `GROUPS` configurations, each used a whole number of times: a place takes the longest piece left that still leaves
the rounded sizes of the places behind it, so what rounding up gave away is won back as a sequence fills. Pieces that
whole uses do not cover are grouped and planned again, up to `ROUNDS` times; the few that are still left, and all small
ones, go best-fit, by falling length, into the room that is really left. Each plan entry places a range of ranks of one
length; the pieces' exact ranks, found by Spark, turn it into places.

Texts of any length are encoded whole. The fast encoder's expression engine runs out of its stack in blanks of some
700,000 signs and more: texts with over `LONG_BLANK` of them in a row are encoded by the library of the JSON file.

Null and empty texts hold only the end token. Rows with equal or null ids are packed one by one, alike pieces in the
order of the table. An empty table gives no pieces. Other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import re
from base64 import b64decode
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.spark_util import exact_rank, materialize, pick

END_ID = 2
CELL_ROWS = 500
#: Groups of large lengths, and the part of the capacity from which a length is large.
GROUPS, LARGE_PART = 64, 5
#: Times that large pieces are grouped and planned.
ROUNDS = 4
#: Blanks in a row from which on the library of the JSON file encodes a text.
LONG_BLANK = 50_000
#: Columns that may be generated; a solution is feasible after each of them.
MOST_COLUMNS = 4000


def best_config(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration (how often each size) that fits, by a knapsack."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int16)
    for g, (size, value) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        before = best.copy()
        for m in range(1, capacity // size + 1 if value > 0 else 1):
            with_it = before[: capacity + 1 - m * size] + m * value
            better = with_it > best[m * size :] + 1e-12
            best[m * size :][better] = with_it[better]
            taken[g, m * size :][better] = m
    config, room = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    for g in range(len(sizes) - 1, -1, -1):
        config[g] = taken[g, room]
        room -= int(config[g] * sizes[g])
    return float(best.max()), config


def solve_configs(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, in fractions, so that the demand is met by the fewest sequences.

    The simplex method on the demand's rows; columns are generated by `best_config` from the prices of the sizes.
    """
    size, need = np.array(sizes), np.array(demand, float)
    columns = [np.eye(len(sizes), dtype=np.int64)[g] * (capacity // x) for g, x in enumerate(sizes)]
    basis = np.array(columns, float).T
    used = np.linalg.solve(basis, need)
    for _ in range(MOST_COLUMNS):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, config = best_config(size, price, capacity)
        if value <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, config.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, used / change, np.inf)
        out = int(np.argmin(ratio))
        used = np.maximum(used - ratio[out] * change, 0)
        used[out] = ratio[out]
        basis[:, out], columns[out] = config, config
    return list(zip(columns, used.tolist(), strict=True))


def linear_groups(counts: dict[int, int], most: int) -> list[list[list[int]]]:
    """(length, pieces) by falling length in groups of equal cardinality; a length may be in two groups.

    Groups that are rounded to one size are one.
    """
    share = -(-sum(counts.values()) // most)
    groups: list[list[list[int]]] = []
    filled = share
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if filled == share:
                groups.append([])
                filled = 0
            take = min(n, share - filled)
            groups[-1].append([length, take])
            filled, n = filled + take, n - take
    merged: list[list[list[int]]] = []
    for g in groups:
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    return merged


class PackingPlan:
    """Entries (length, first rank, pieces, first sequence, pieces in each sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        #: Pieces that configurations placed.
        self.configured = 0
        self.entries: list[tuple[int, int, int, int, int, int]] = []
        self.used: defaultdict[int, int] = defaultdict(int)
        #: Open runs of alike sequences by their free room: (first sequence, end sequence).
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        least_large = capacity // LARGE_PART + 1
        rest = {x: n for x, n in counts.items() if n}
        self._alone(rest.pop(capacity, 0))
        over = self._large({x: n for x, n in rest.items() if x >= least_large})
        for x in sorted((over | {x: n for x, n in rest.items() if x < least_large}).items(), reverse=True):
            self._best_fit(*x)

    def _alone(self, n: int) -> None:
        """Full pieces are sequences as they are."""
        if n:
            self._place(self.capacity, n, self.sequences, 1, 0)
            self.sequences += n

    def _place(self, length: int, pieces: int, first: int, each: int, offset: int) -> None:
        self.entries.append((length, self.used[length], pieces, first, each, offset))
        self.used[length] += pieces

    def _leave(self, room: int, first: int, end: int) -> None:
        if room and first < end:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first, end))

    def _large(self, counts: dict[int, int]) -> dict[int, int]:
        """Places large pieces by configurations; gives the few that are left over by length."""
        left = dict(counts)
        for k in range(ROUNDS):
            groups = [(g[0][0], g[-1][0], sum(n for _, n in g)) for g in linear_groups({x: n for x, n in left.items() if n}, GROUPS)]
            plan = solve_configs([g[0] for g in groups], [g[2] for g in groups], self.capacity) if groups else []
            before = self.configured
            for config, used in sorted(plan, key=lambda c: (-max(np.flatnonzero(c[0]), default=0), c[0].tolist())):
                # later rounds have few pieces, and uses of less than one
                if times := int(used + (0.5 if k else 1e-6)):
                    self._substitute([groups[g][:2] for g in np.flatnonzero(config) for _ in range(config[g])], times, left)
            if self.configured == before:
                break
        return left

    def _substitute(self, places: list[tuple[int, int]], times: int, left: dict[int, int]) -> None:
        """Up to `times` sequences of a configuration's places (largest and least length of the group) from what is left.

        Each place takes the longest piece that leaves the places behind it their rounded sizes; a configuration ends
        when a group has no piece left that is as long as its least one. Runs of alike sequences are placed at once.
        """
        lengths = sorted(x for x, n in left.items() if n)
        while times:
            taken: defaultdict[int, int] = defaultdict(int)
            chosen, room, behind = [], self.capacity, sum(most for most, _ in places)
            for most, least in places:
                behind -= most
                at = bisect_left(lengths, room - behind + 1) - 1
                while at >= 0 and left[lengths[at]] <= taken[lengths[at]]:
                    at -= 1
                if at < 0 or lengths[at] < least:
                    return
                chosen.append(lengths[at])
                taken[lengths[at]] += 1
                room -= lengths[at]
            run = min(times, *(left[x] // n for x, n in taken.items()))
            offset, first = 0, self.sequences
            for x in chosen:
                self._place(x, run, first, 1, offset)
                offset += x
                left[x] -= run
            self.configured += run * len(chosen)
            self.sequences += run
            self._leave(self.capacity - offset, first, first + run)
            times -= run
            lengths = [x for x in lengths if left[x]]

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                new = -(-n // (self.capacity // length))
                self._leave(self.capacity, self.sequences, self.sequences + new)
                self.sequences += new
                continue
            room = self.rooms[at]
            first, end = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.rooms.pop(at)
            each = room // length
            full = min(end - first, n // each)
            if full:
                self._place(length, full * each, first, each, self.capacity - room)
                self._leave(room - each * length, first, first + full)
                n -= full * each
            if first + full < end:
                if n and n < each:
                    self._place(length, n, first + full, n, self.capacity - room)
                    self._leave(room - n * length, first + full, first + full + 1)
                    n, full = 0, full + 1
                self._leave(room, first + full, end)


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a text's pieces: full ones behind the first, which may be shorter."""
    if n <= capacity:
        return [n]
    full = -(-n // capacity) - 1
    return [n - full * capacity, *[capacity] * full]


@lru_cache(maxsize=1)
def _encoder(tokenizer_path: str):
    """Made once for each Python worker: it takes a second and a hundred megabytes."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path, "rb") as lines:
        ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _library(json_path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(json_path)


_BLANK = re.compile(rf"\s{{{LONG_BLANK},}}+")


def added_tokens(json_path: str) -> dict[str, int]:
    """Ids of the tokens that a tokenizer's JSON file adds to its vocabulary; they are recognised in plain text."""
    with open(json_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"only added tokens that stand for themselves are known, not {odd}")
    return {t["content"]: t["id"] for t in added}


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = END_ID, added: dict[str, int] | None = None, json_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32.

    `tokenizer_path` names a byte-level BPE as ranks. A rank file knows no added tokens: with those of the JSON file of
    the same vocabulary as `added`, texts are split at them, the longest first, and the ids are those that the library
    tokenizers gives for the JSON file; without, they are those that it gives with encode_special_tokens. The tests
    hold both against each other. `json_path` names that file; texts with long blanks need it.
    """
    added = added or {}
    marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path).encode_ordinary
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if len(text) >= LONG_BLANK and json_path and _BLANK.search(text):
                    found = _library(json_path).encode(text, add_special_tokens=False).ids
                else:
                    parts = marks.split(text) if marks else [text]  # every second part is a mark
                    found = [x for k, part in enumerate(parts) for x in ((added[part],) if k % 2 else encode(part))]
                ids = np.array([*found, end_id], "<u4")
                start = 0
                for piece, length in enumerate(piece_lengths(len(ids), capacity)):
                    for column, value in zip(out, (doc_id, piece, start, length, crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col]).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, added: dict[str, int] | None = None, json_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    pieces = materialize(tokenise(docs, tokenizer_path, id_col, text_col, capacity, added=added, json_path=json_path).withColumn("row", F.monotonically_increasing_id()))
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n"))
    plan = PackingPlan({r.length: r.n for r in histogram.collect()}, capacity)  # a row for each length at most
    by_length: dict[int, np.ndarray] = {}
    for length in plan.used:
        by_length[length] = np.array(sorted(e[1:] for e in plan.entries if e[0] == length), np.int64)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                mine = length == x
                e = by_length[x]
                at = np.searchsorted(e[:, 0], rank[mine], "right") - 1
                inner = rank[mine] - e[at, 0]
                sequence[mine] = e[at, 2] + inner // e[at, 3]
                offset[mine] = e[at, 4] + inner % e[at, 3] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    # at most `capacity` rows
    celled = pieces.join(F.broadcast(histogram), "length").withColumn("cell", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / CELL_ROWS)))
    ranked = exact_rank(celled, ["length"], "cell", ["row"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
