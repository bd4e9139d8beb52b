"""License scans: template markup compiled to token automata that accept texts with exactly the mandatory wording.

Markup of a template: plain words are mandatory, ``[[ ... ]]`` is an optional region, ``{{n}}`` a replaceable region
of up to n words. A template becomes an automaton over words; it is run from every place where one of its first
words stands, so a licence is found anywhere in a text and with any punctuation, case or line breaks between words.

Nulls and empty texts have no words and no labels; repeated rows give repeated results; texts are read whole. An
empty table gives an empty result. Labels found more than once are given once; no other column is looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lotlens.llm import text as tx
from lotlens.llm.spark_util import pick

# The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public licences and licence notices, in the markup above.
TEMPLATES = {
    "apache-2": "licensed under [[the terms of]] the apache license version 2 [[0]] [[the license]]",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{8}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{8}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "cc-by": "licensed under [[the terms of]] [[a]] [[the]] creative commons attribution [[{{1}} 0]] [[international]] license",
    "cc-by-nc": "licensed under [[the terms of]] [[a]] [[the]] [[creative commons]] cc by nc [[{{1}} 0]]",
    "gpl-3": "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 3",
    "gpl-2": "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 2",
    "lgpl": "licensed under [[the terms of]] the gnu lesser general public license [[version {{2}}]]",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit": "[[copyright [[c]] {{10}}]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-notice": "[[licensed]] [[released]] under [[the terms of]] the mit license",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{8}}",
    "agpl-3": "licensed under [[the terms of]] the gnu affero general public license [[as published by the free software foundation]] [[either]] version 3",
    "cc-by-sa": "licensed under [[the terms of]] [[a]] [[the]] creative commons attribution sharealike [[{{1}} 0]] [[international]] license",
    "cc0": "[[creative commons]] cc0 1 0 universal [[public domain dedication]]",
    "epl-2": "this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] 2 0",
    "artistic-2": "licensed under [[the terms of]] the artistic license [[version]] 2 0",
    "bsl-1": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Label of a template whose name says more than its licence.
LABEL_OF = {"apache-2-notice": "apache-2", "mit-notice": "mit"}
#: Labels whose texts hold much of each other's wording: of runs that lie within one another the outer one holds.
FAMILY_OF = {"bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "gpl-2": "gpl", "gpl-3": "gpl", "agpl-3": "gpl", "cc-by": "cc-by", "cc-by-sa": "cc-by"}

_SEPARATOR = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_EDGE = rb"[0-9a-z\x80-\xff]"


class TokenAutomaton:
    """States joined by words; `skips` are moves without a word, a gap takes any one word."""

    def __init__(self, markup: str):
        self.words: list[dict[bytes, int]] = []
        self.gaps: list[int | None] = []
        self.skips: list[list[int]] = []
        end = self._sequence(re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup.lower()), self._state())
        self.accepting = end
        self.closure = [self._close(s) for s in range(len(self.words))]
        self.first = {w for s in self.closure[0] for w in self.words[s]}
        self.needed = self._needed(markup.lower())

    def _needed(self, markup: str) -> set[bytes]:
        """Words of which every accepted run holds at least one: the longest mandatory word, else the first words."""
        while (bare := re.sub(r"\[\[(?:(?!\[\[|\]\]).)*\]\]", " ", markup, flags=re.DOTALL)) != markup:
            markup = bare
        mandatory = re.findall(r"[^\s\[\]{}]+", re.sub(r"\{\{\d+\}\}", " ", markup))
        return {max(mandatory, key=len).encode()} if mandatory else self.first

    def _state(self) -> int:
        self.words.append({})
        self.gaps.append(None)
        self.skips.append([])
        return len(self.words) - 1

    def _sequence(self, tokens: list[str], at: int) -> int:
        opened: list[int] = []
        for token in tokens:
            if token == "[[":
                opened.append(at)
                fresh = self._state()
                self.skips[at].append(fresh)
                at = fresh
            elif token == "]]":
                fresh = self._state()
                self.skips[at].append(fresh)
                self.skips[opened.pop()].append(fresh)
                at = fresh
            elif token.startswith("{{"):
                steps = [at]
                for _ in range(int(token[2:-2])):
                    self.gaps[steps[-1]] = self._state()
                    steps.append(self.gaps[steps[-1]])
                at = self._state()
                for s in steps:
                    self.skips[s].append(at)
            else:
                fresh = self._state()
                self.words[at][token.encode()] = fresh
                at = fresh
        if opened:
            raise ValueError("an optional region is not closed")
        return at

    def _close(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, tokens: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from `start`, or -1."""
        active, best, i = self.closure[0], -1, start
        while active:
            if self.accepting in active:
                best = i
            if i == len(tokens):
                break
            token, after = tokens[i], set()
            for s in active:
                if (to := self.words[s].get(token)) is not None:
                    after |= self.closure[to]
                if (to := self.gaps[s]) is not None:
                    after |= self.closure[to]
            active, i = after, i + 1
        return best


class LicenseMatcher:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {name: TokenAutomaton(m) for name, m in templates.items()}
        self.phrases = [(re.compile(rb"(?<!" + _EDGE + rb")" + _SEPARATOR.join(p.encode().split()) + rb"(?!" + _EDGE + rb")"), label) for p, label in phrases.items()]
        self.by_first: dict[bytes, list[str]] = {}
        for name, a in self.automata.items():
            for w in a.first:
                self.by_first.setdefault(w, []).append(name)
        #: Every label needs one of these, which stand in few texts: a text without them is accepted by nothing.
        needed = [re.escape(w) for a in self.automata.values() for w in a.needed] + [_SEPARATOR.join(re.escape(w) for w in p.encode().split()) for p in phrases]
        self.gate = re.compile(b"|".join(sorted(set(needed))) or b"(?!)")

    def scan(self, lower: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Base places as (word index, label), accepted templates as (first word, end word, label), none inside another of its family."""
        spots = [(m.start(), label) for pattern, label in self.phrases for m in pattern.finditer(lower)]
        found = [(m.start(), m[0]) for m in _WORD.finditer(lower)]
        starts, tokens = [s for s, _ in found], [t for _, t in found]
        at = np.searchsorted(np.asarray(starts), [s for s, _ in spots]) if spots else []
        base = sorted((int(i), label) for i, (_, label) in zip(at, spots, strict=True))
        hits = []
        for i, token in enumerate(tokens):
            for name in self.by_first.get(token, ()):
                if (end := self.automata[name].match(tokens, i)) > i:
                    hits.append((i, end, LABEL_OF.get(name, name)))
        # a run inside another of its label is the same notice, one inside a longer one of its family a part of it
        outer, reach = [], {}
        for i, end, label in sorted(hits, key=lambda h: (h[0], -h[1], h[2])):
            family = FAMILY_OF.get(label, label)
            if end > reach.get(family, -1):
                outer.append((i, end, label))
                reach[family] = end
        return base, outer


def gated(gate: re.Pattern[bytes], raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """Texts that the gate hits; a hit over the edge of two texts may hide one behind it, so it counts for both."""
    spans = np.array([m.span() for m in gate.finditer(raw)], np.int64).reshape(-1, 2)
    lo, hi = (np.searchsorted(offsets, x, "right") - 1 for x in (spans[:, 0], spans[:, 1] - 1))
    return np.unique(np.concatenate([lo, *(np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True) if a < b)]))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document with its base phrases, its licence labels and a score.

    score: 1 if a template is accepted, 0.5 if only a base phrase stands in the text, else 0. A null text is empty.
    One narrow pass: no shuffle, memory bounded by a slice of the batch or the longest text.
    """
    templates, phrases = templates or TEMPLATES, phrases or BASE_PHRASES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = LicenseMatcher(templates, phrases)
        for batch in batches:
            for row, stop, data, offsets in tx.slices(batch.column(1)):
                data = tx.LOWER[data]
                _, _, first = tx.words(data, offsets, tx.ALNUM_WORD)
                n, raw = stop - row, data.tobytes()
                out = {"n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n, "n_templates": [0] * n}
                for i in gated(matcher.gate, raw, offsets):
                    base, hits = matcher.scan(raw[offsets[i] : offsets[i + 1]])
                    labels = {x for _, x in base}
                    if base:
                        out["n_base"][i], out["first_word"][i], out["last_word"][i] = len(base), base[0][0], base[-1][0]
                        out["base_labels"][i] = ",".join(sorted(labels))
                    labels |= {x for _, _, x in hits}
                    out["labels"][i], out["n_templates"][i] = ",".join(sorted(labels)), len(hits)
                    out["score"][i] = 1.0 if hits else 0.5 * bool(base)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(np.diff(first), pa.int64()), *(pa.array(v, pa.float64() if k == "score" else pa.string() if "labels" in k else pa.int64()) for k, v in out.items())],
                    ["doc_id", "n_words", *out],
                )

    return pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col]).mapInArrow(run, SCHEMA)
