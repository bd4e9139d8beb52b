"""Personal data by a semi-Markov conditional random field.

Base patterns find emails, addresses, cards and phone numbers. Beside them a segment model reads every island of
words with a digit or an at sign: each candidate segment of atoms gets whole-span features (digits, groups, Luhn sum,
marks, ends, the word before), and dynamic programming over segments of bounded length chooses boundaries and types
together. The weights maximise the likelihood of segmented examples that a seeded generator writes in the formats of
such data; they are fitted on the driver in a second or two and have a fixed size. There are no label-to-label
features: which kind a span is tells nothing on the next one's, and what lies between two spans is outside of both.

All steps are linear in the text: an email is looked for backwards from its at sign, numbers with dots are read as
maximal runs, islands grow outwards from a digit or an at sign, a segment has at most `MAX_ATOMS` atoms, and the
features of many islands are made at once from running sums.

Null and empty texts have no spans. Repeated rows give repeated results; texts are read whole; an empty table gives
an empty result. Of two equally good segmentations the one with fewer and then longer spans holds. Offsets are in code
points. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.spark_util import pick

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Emails and addresses are read in linear time by the rules below them.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What any span holds, by a base pattern or by the model.
GATE = "[0-9@]"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGIT = re.compile("[0-9]")
_HIT = re.compile(GATE)
_SPACE = re.compile(r"\s")
_ATOM = re.compile(r"[0-9]+|[^\W\d]+|[^\w\s]|\w")
_BEFORE = re.compile(r"(\w+)\W*$")
MAX_ATOMS, LEAST_SIGNS, MOST_SIGNS = 17, 7, 80


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL: the signs before an at sign up to the last match, if a domain follows it."""
    seen, at = 0, text.find("@")
    while at >= 0:
        before = text[seen:at]
        start = seen + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        seen = m.end() if m else at + 1
        at = text.find("@", seen)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of IP with parts of at most 255: four parts of a dotted run after the other."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order; failing matches are dropped without a retry."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(a, 1, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Neighbouring words with a digit or an at sign, one space between them."""
    done, hit = 0, _HIT.search(text)
    while hit:
        before = text[done : hit.start()].rsplit(None, 1)
        ends_word = hit.start() > done and not text[hit.start() - 1].isspace()
        start = hit.start() - (len(before[-1]) if ends_word else 0)
        space = _SPACE.search(text, hit.end())
        while space and space[0] == " ":
            following = _SPACE.search(text, space.end())
            stop = following.start() if following else len(text)
            if not _HIT.search(text, space.end(), stop):
                break
            space = following
        done = space.start() if space else len(text)
        yield start, done
        hit = _HIT.search(text, done)


# Words that come before such data.
_CUES = {"mail": 0, "email": 0, "contact": 0, "ip": 1, "host": 1, "server": 1, "address": 1, "card": 2, "visa": 2, "credit": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3}
N_FEATURES = 29
_NUMBERS = re.compile(r"[0-9 ().+-]+")


def span_features(span: str, before: str, after: str, cue: int) -> list[float]:
    """Whole-span features of one candidate; `before` and `after` are the signs next to it, `cue` a kind or -1."""
    digits = re.sub("[^0-9]", "", span)
    n, groups = len(digits), re.findall("[0-9]+", span)
    letters = sum(c.isalpha() for c in span)
    at, dots, dashes, spaces = span.count("@"), span.count("."), span.count("-"), span.count(" ")
    local, _, domain = span.partition("@")
    labels = domain.split(".")
    mail = at == 1 and len(local) > 0 and len(labels) >= 2 and all(labels) and labels[-1].isalpha() and " " not in span
    quad = len(groups) == 4 and dots == 3 and len(span) == n + 3 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    plain = _NUMBERS.fullmatch(span) is not None
    width = {len(g) for g in groups[:-1]}
    return [
        1.0,
        float(mail), float(at == 1), float(at > 1), float(mail and span[0].isalnum() and span[-1].isalnum()),
        float(quad), float(dots == 3 and plain), float(dots == 3 and plain and not quad),
        float(plain and n >= 12 and luhn(digits)), float(plain and 13 <= n <= 16), float(plain and n >= 12 and not luhn(digits)), float(plain and width == {4} and n == 16),
        float(span[0] == "+"), float(span[0] == "(" or span[1:2] == "("), float(plain and 10 <= n <= 12), float(plain and 7 <= n <= 9), float(plain and n < 7), float(plain and 3 <= len(groups) <= 5 and dashes + spaces >= 2),
        float(plain and len(groups) == 1 and span[0] != "+"), float(letters > 0 and at == 0), float("/" in span or ":" in span or "$" in span or "%" in span),
        float(before.isalnum() or before in ("@", "$", "/")), float(after.isalnum() or after in ("@", "/", "%")), float(before == "+"),
        float(cue == 0), float(cue == 1), float(cue == 2), float(cue == 3),
        len(span) / 20,
    ]


_SIGNS = np.array([chr(c).isalpha() + 2 * chr(c).isalnum() for c in range(0x110000)], np.uint8)
#: Candidates whose features are in memory at once.
BLOCK = 100_000


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


class Islands:
    """Stretches of texts with their atoms and candidate segments, and the features of many candidates at once.

    The stretches are joined by line ends, which no candidate crosses; what stands before and after a stretch is space
    or an end of the text. `cues` has the kind that the word before each stretch hints at, or -1.
    """

    def __init__(self, stretches: list[str], cues: list[int]):
        self.text = text = "\n".join(stretches)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        spans = [m.span() for m in _ATOM.finditer(text)]
        self.begin, self.end = (np.array(x, np.int64) for x in (zip(*spans, strict=True) if spans else ((), ())))
        starts = np.cumsum([0, *(len(x) + 1 for x in stretches)])
        self.of = np.searchsorted(starts, self.begin, "right") - 1
        own = [_CUES.get(text[a:b].lower(), -1) if b - a > 1 else -1 for a, b in spans]
        self.cue = np.array([-1, *own[:-1]][: len(own)], np.int64)
        first = np.ones(len(spans), bool)
        first[1:] = self.of[1:] != self.of[:-1]
        self.cue[first] = np.array(cues, np.int64)[self.of[first]]
        self.alpha, self.alnum = (_SIGNS[code] & 1).astype(bool), _SIGNS[code] > 1
        self.code = np.append(code, [10, 10])  # a sign after the last, and one before the first at -1
        digit = (code >= 48) & (code <= 57)
        is_in = lambda signs: np.isin(code, [ord(x) for x in signs])
        at, dot = code == 64, code == 46
        double = np.append(dot[1:] & dot[:-1], False) if len(code) else dot
        self.count = {k: _sums(v) for k, v in {"digit": digit, "alpha": self.alpha, "at": at, "dot": dot, "dash": code == 45, "space": code == 32, "odd": is_in("/:$%"), "number": digit | is_in(" ().+-"), "double": double}.items()}
        self.last_at = np.maximum.accumulate(np.where(at, np.arange(len(code)), -1)) if len(code) else np.zeros(0, np.int64)
        self.last_other = np.maximum.accumulate(np.where(self.alpha, -1, np.arange(len(code)))) if len(code) else np.zeros(0, np.int64)
        # digits by their place among all digits: a card's digits count doubled at every second place from its end
        value = (code[digit] - 48).astype(np.int64)
        twice = 2 * value - 9 * (value > 4)
        even = np.arange(len(value)) % 2 == 0
        self.plain_sum, self.twice_sum = ([_sums(np.where(side, v, 0)) for side in (even, ~even)] for v in (value, twice))
        # groups of digits are atoms
        size = self.end - self.begin
        group = digit[self.begin] if len(spans) else np.zeros(0, bool)
        byte = np.zeros(len(spans), bool)
        for k in np.flatnonzero(group & (size <= 3)):
            byte[k] = int(text[spans[k][0] : spans[k][1]]) <= 255
        self.group = {k: _sums(v) for k, v in {"all": group, "byte": byte, "four": group & (size == 4)}.items()}
        self.last_group = np.maximum.accumulate(np.where(group, np.arange(len(spans)), -1)) if len(spans) else np.zeros(0, np.int64)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First atom and the atom after the last of the candidate segments, by their first and then their last atom."""
        n = len(self.begin)
        opens = self.alnum[self.begin] | np.isin(self.code[self.begin], [43, 40]) if n else np.zeros(0, bool)
        closes = self.alnum[self.end - 1] if n else opens
        for lo in range(0, n, BLOCK // MAX_ATOMS):
            i = np.arange(lo, min(n, lo + BLOCK // MAX_ATOMS))
            i, j = np.repeat(i[opens[i]], MAX_ATOMS), (i[opens[i], None] + np.arange(MAX_ATOMS)).ravel()
            i, j = i[j < n], j[j < n]
            length = self.end[j] - self.begin[i]
            fits = closes[j] & (self.of[i] == self.of[j]) & (length >= LEAST_SIGNS) & (length <= MOST_SIGNS)
            yield i[fits], j[fits] + 1

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A row for each candidate, as span_features gives it."""
        a, b = self.begin[i], self.end[j - 1]
        held = {k: v[b] - v[a] for k, v in self.count.items()}
        groups, bytes_, fours = (self.group[k][j] - self.group[k][i] for k in ("all", "byte", "four"))
        n, length = held["digit"], b - a
        plain = held["number"] == length
        at = self.last_at[b - 1]
        one_at = held["at"] == 1
        dot_in_domain = self.count["dot"][b] - self.count["dot"][np.minimum(at + 1, b)]
        whole = (held["double"] - (self.count["double"][np.maximum(at, a)] - self.count["double"][a])) == 0
        label = self.last_other[b - 1]
        mail = one_at & (at > a) & (held["space"] == 0) & (dot_in_domain > 0) & whole & (self.code[at + 1] != 46) & self.alpha[b - 1] & (label > at) & (self.code[label] == 46)
        quad = (groups == 4) & (held["dot"] == 3) & (length == n + 3) & (bytes_ == 4)
        dotted = (held["dot"] == 3) & plain
        low, high = self.count["digit"][a], self.count["digit"][b]
        side = (high - 1) % 2  # of the last digit
        luhn_sum = sum(np.where(side == s, self.plain_sum[s][high] - self.plain_sum[s][low], self.twice_sum[s][high] - self.twice_sum[s][low]) for s in (0, 1))
        card = luhn_sum % 10 == 0
        final = self.last_group[j - 1]
        four = (groups > 1) & (self.group["four"][np.maximum(final, i)] - self.group["four"][i] == groups - 1)
        first, second = self.code[a], np.where(length > 1, self.code[a + 1], 10)
        before, after = self.code[a - 1], self.code[b]
        alnum_at = lambda k: np.append(self.alnum, [False, False])[k]
        cue = self.cue[i]
        return np.stack([
            np.ones(len(i)),
            mail, one_at, held["at"] > 1, mail & self.alnum[a] & self.alnum[b - 1],
            quad, dotted, dotted & ~quad,
            plain & (n >= 12) & card, plain & (n >= 13) & (n <= 16), plain & (n >= 12) & ~card, plain & four & (n == 16),
            first == 43, (first == 40) | (second == 40), plain & (n >= 10) & (n <= 12), plain & (n >= 7) & (n <= 9), plain & (n < 7), plain & (groups >= 3) & (groups <= 5) & (held["dash"] + held["space"] >= 2),
            plain & (groups == 1) & (first != 43), (held["alpha"] > 0) & (held["at"] == 0), held["odd"] > 0,
            alnum_at(a - 1) | np.isin(before, [64, 36, 47]), alnum_at(b) | np.isin(after, [64, 47, 37]), before == 43,
            cue == 0, cue == 1, cue == 2, cue == 3,
            length / 20,
        ], 1).astype(float)

    def best(self, weights: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each stretch the (start, kind, end) of the segmentation with the highest score; a lone atom outside scores 0.

        Starts and ends are places in the joined text.
        """
        kept = []
        for i, j in self.candidates():
            scores = self.features(i, j) @ weights.T
            some = scores.max(1) > 0
            kept.append((i[some], j[some], scores[some].argmax(1), scores[some].max(1)))
        found = [[] for _ in range(int(self.of.max(initial=-1)) + 1)]
        if not kept:
            return found
        i, j, kind, score = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((i, j))
        stretch = self.of[i[order]]
        for lo, hi in pairwise([*np.flatnonzero(np.diff(stretch, prepend=-1)).tolist(), len(order)]):
            c = order[lo:hi]
            found[int(stretch[lo])] = [(int(self.begin[i[k]]), int(kind[k]), int(self.end[j[k] - 1])) for k in _best_chain(i[c].tolist(), j[c].tolist(), score[c].tolist(), c.tolist())]
        return found


def _best_chain(first: list[int], end: list[int], score: list[float], name: list[int]) -> list[int]:
    """Names of the disjoint candidates with the highest sum of scores; they are given by their ends."""
    ends, tops, back = [-1], [0.0], [(-1, -1)]  # only where a candidate ends can the best sum change
    for a, b, s, c in zip(first, end, score, name, strict=True):
        value = tops[bisect_right(ends, a) - 1] + s
        if value > tops[-1]:
            if ends[-1] == b:
                tops[-1], back[-1] = value, (c, a)
            else:
                ends.append(b)
                tops.append(value)
                back.append((c, a))
    out, k = [], len(ends) - 1
    while k > 0:
        c, a = back[k]
        out.append(c)
        k = bisect_right(ends, a) - 1
    return out[::-1]


def _cue_before(text: str, start: int) -> int:
    found = _BEFORE.search(text, max(0, start - 24), start)
    return _CUES.get(found[1].lower(), -1) if found else -1


def examples(n: int, seed: int = 5) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with their gold spans: each kind in several formats, and numbers that are no personal data."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick_one = lambda *x: x[rng.integers(len(x))]
    name = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8)))

    def card() -> str:
        body = str(rng.integers(3, 7)) + d(pick_one(14, 14, 14, 12, 13))
        full = next(body + str(x) for x in range(10) if luhn(body + str(x)))
        sep = pick_one("", "", " ", "-", ".")
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4)) if sep else full

    def wrong_card() -> str:
        while luhn(x := d(pick_one(12, 13, 16))):
            pass
        return x

    makers = [
        lambda: (0, f"{name()}{pick_one('', '.', '_', '-')}{name()}{d(rng.integers(0, 4))}@{name()}{pick_one('', d(1))}.{pick_one('', name() + '.')}{pick_one('com', 'org', 'net', 'de')}"),
        lambda: (1, ".".join(str(rng.integers(0, 256)) for _ in range(4))),
        lambda: (2, card()),
        lambda: (3, pick_one(f"+{rng.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{rng.integers(1, 99)} {d(3)} {d(3)} {d(4)}", f"+{rng.integers(1, 99)}{d(10)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"+{rng.integers(1, 99)}-{d(3)}-{d(3)}-{d(4)}")),
        lambda: (-1, pick_one(f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"${d(3)},{d(3)}.{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(2)}.{d(3)}", d(rng.integers(1, 9)), f"{d(3)}.{rng.integers(256, 999)}.{d(3)}.{d(2)}", f"{name()}{d(8)}", f"{d(4)}/{d(4)}", f"@{name()}{d(3)}", f"{d(3)} {d(3)} {d(2)}", f"{rng.integers(1900, 2030)}-{rng.integers(1900, 2030)}")),
        lambda: (-1, wrong_card()),
        lambda: (-1, "".join(rng.choice(list("0123456789abcdef"), 32))),
    ]
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.integers(1, 4)):
            kind, value = makers[rng.integers(len(makers))]()
            text += pick_one("", "", f"{name()} ", f"{name()}, ", f"{pick_one(*_CUES)} ", f"{pick_one(*_CUES)}: ")
            if kind >= 0:
                gold.append((len(text), kind, len(text) + len(value)))
            text += value + pick_one(" ", ", ", ". ", "; ", f" {name()} ", "### ")
        yield text, gold


@lru_cache(maxsize=2)
def fitted_weights(n: int = 400, rounds: int = 45, seed: int = 5) -> np.ndarray:
    """Weights (kind, feature) by gradient ascent on the conditional likelihood of the examples' segmentations."""
    given = []
    for text, gold in examples(n, seed):
        marks = {(a, b): k for a, k, b in gold}
        for start, end in islands(text):
            x = Islands([text[start:end]], [_cue_before(text, start)])
            i, j = (np.concatenate(k) for k in zip(*x.candidates(), strict=True))
            if len(i):
                at = lambda v: [np.flatnonzero(v == k) for k in range(len(x.begin) + 1)]  # noqa: B023, E731
                given.append((x.features(i, j), i, j, at(i), at(j), [marks.get((start + int(x.begin[p]), start + int(x.end[q - 1])), -1) for p, q in zip(i, j, strict=True)]))
    truth = sum(x[[c]].T @ np.eye(len(KINDS))[[k]] for x, *_, gold in given for c, k in enumerate(gold) if k >= 0).T
    w = np.zeros((len(KINDS), N_FEATURES))
    w[:, 0] = -1
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        expected = np.zeros_like(w)
        for x, i, j, starting, ending, _ in given:
            size = len(starting) - 1
            scores = x @ w.T
            weight = np.logaddexp.reduce(scores, axis=1)
            alpha, beta = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
            alpha[0] = beta[size] = 0.0
            for k in range(1, size + 1):
                alpha[k] = np.logaddexp.reduce([alpha[k - 1], *(alpha[i[ending[k]]] + weight[ending[k]])]) if len(ending[k]) else alpha[k - 1]
            for k in range(size - 1, -1, -1):
                beta[k] = np.logaddexp.reduce([beta[k + 1], *(beta[j[starting[k]]] + weight[starting[k]])]) if len(starting[k]) else beta[k + 1]
            chance = np.exp(alpha[i] + beta[j] - alpha[size] + weight)
            expected += (np.exp(scores - weight[:, None]) * chance[:, None]).T @ x
        gradient = (truth - expected) / len(given) - 0.002 * w
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w + 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


Spans = list[tuple[int, int, int]]


def all_spans(texts: list[str], weights: np.ndarray) -> list[tuple[Spans, Spans]]:
    """For each text its base spans, and all spans: the base ones and the model's that overlap none of them."""
    places, stretches, cues = [], [], []
    for k, text in enumerate(texts):
        for start, end in islands(text):
            if end - start >= LEAST_SIGNS:
                places.append((k, start))
                stretches.append(text[start:end])
                cues.append(_cue_before(text, start))
    model: list[Spans] = [[] for _ in texts]
    found = Islands(stretches, cues).best(weights) if stretches else []
    at = 0
    for (k, start), stretch, spans in zip(places, stretches, [*found, *[[]] * (len(places) - len(found))], strict=True):
        model[k] += [(a - at + start, kind, b - at + start) for a, kind, b in spans]
        at += len(stretch) + 1
    out = []
    for text, extra in zip(texts, model, strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for a, _, b in base)
        starts, reach = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken]) if taken else None
        free = []
        for a, kind, b in extra:
            k = int(np.searchsorted(starts, b)) if taken else 0
            if not (k and reach[k - 1] > a):
                free.append((a, kind, b))
        out.append((base, sorted(base + free)))
    return out


def find_spans(text: str, weights: np.ndarray) -> tuple[Spans, Spans]:
    return all_spans([text], weights)[0]


def _in_groups(texts: list[str | None], weights: np.ndarray, signs: int = 1 << 20) -> Iterator[tuple[Spans, Spans] | None]:
    """all_spans of many texts, about so many signs at a time; None for a text without any sign that a span holds."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= signs):
            size += len(texts[hi] or "")
            hi += 1
        some = [i for i in range(lo, hi) if texts[i] and _HIT.search(texts[i])]
        done = dict(zip(some, all_spans([texts[i] for i in some], weights), strict=True))
        yield from (done.get(i) for i in range(lo, hi))
        lo = hi


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """One row per document with the base counts and digest, and all spans. One narrow pass, no shuffle.

    Only texts with a digit or an at sign are sent to Python; no span can be in another.
    """
    weights = fitted_weights() if weights is None else weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, digest, spans, total = np.zeros((n, 4), np.int64), [nothing] * n, [""] * n, [0] * n
            for i, found in enumerate(_in_groups(batch.column(1).to_pylist(), weights)):
                if found:
                    base, every = found
                    for _, k, _ in base:
                        counts[i, k] += 1
                    digest[i], spans[i], total[i] = sha256(_digest(base).encode()).hexdigest(), _digest(every), len(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(4)), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(total, pa.int64())], [x.split()[0] for x in SCHEMA.split(", ")])

    text = docs[text_col]
    return pick(docs, doc_id=docs[id_col].cast("long"), text=F.when(text.rlike(GATE), text)).mapInArrow(run, SCHEMA)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes its kind in angle brackets; overlapping spans become one, of the first one's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", weights: np.ndarray | None = None) -> DataFrame:
    """The same columns with all spans redacted; `length_col`, if the table has it, gets the new length."""
    weights = fitted_weights() if weights is None else weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            done = [redact(t, found[1]) if found else t for t, found in zip(texts, _in_groups(texts, weights), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(done, batch.schema.field(at).type)
            if length_col in batch.schema.names:
                k = batch.schema.get_field_index(length_col)
                columns[k] = pa.array([None if t is None else len(t) for t in done], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
