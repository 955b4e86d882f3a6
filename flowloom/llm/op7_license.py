"""License scans by template markup compiled into token automata.

A template is a line of words with markup: ``[[ ... ]]`` may be left out, ``{n}`` stands
for one up to n words of any kind, ``{}`` for one or more words up to the place where the
template goes on, all of one sentence (see ``breaks_before``). Everything else is mandatory
and must match word by word. Words are runs of letters, digits and characters beyond ASCII,
A-Z lower-cased; templates and texts are compared by word hashes. An automaton is tried
wherever one of its possible first words stands, so a whole text costs one vectorised
search. A ``{}`` divides a template into parts with an automaton each: what follows the
region is the next place of the next part, found by bisection, so the search stays
linear in the text however many beginnings stand in one sentence.

Defined results: null and empty texts have no words, no labels and score 0; repeated
rows are scanned alike; an empty table gives no rows; extra columns are ignored; places may
overlap; of several matches from one place the longest is reported (a ``{}`` region ends at
the first place where its template can go on); very long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.llm.arrow import map_batches
from flowloom.llm.wordtable import PUNCT, SPACE, Group, byte_class, groups, hash_bytes

#: Phrases of the base scan and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label; wording of public licenses and their usual notices (fixed values).
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software [[and associated documentation files]] "
    "[[the {1}]] to deal in [[the]] {1} without restriction"
)
_MIT_REST = (
    "including without limitation [[on]] the rights to use copy modify merge publish distribute sublicense and or sell copies of the {1} and to "
    "permit persons to whom the {1} is furnished to do so subject to the following conditions the above copyright notice and this permission "
    "notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
)
_MIT_DISCLAIMER = (
    "the {1} is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose [[title]] and [[noninfringement]] [[non infringement]] in no event shall {} be liable for any claim "
    "[[damages or other liability]] whether in an action of contract tort or otherwise arising from out of or in connection with the {1} or the "
    "use or other dealings in the {1}"
)
_BSD_GRANT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
)
_BSD_TWO = (
    "[[{1}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[{1}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution"
)
_BSD_THIRD = (
    "[[{1}]] neither the name of {} nor the names of [[its]] [[the]] contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission"
)
_BSD_DISCLAIMER = (
    "this software is provided by {} as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall {} be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or "
    "profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
    "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = (
    "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {1} [[{6}]] "
    "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {} "
    "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": ("gnu affero general public license", "gnu agpl", "spdx license identifier agpl"),
    "apache": (
        "licensed under the apache [[software]] license [[version {3}]]",
        "you may not use this file except in compliance with the license",
        "spdx license identifier apache",
    ),
    "bsd": (_BSD_GRANT, "[[released]] [[licensed]] under the [[{3}]] bsd license", "spdx license identifier bsd"),
    "bsd-2-clause": (f"{_BSD_GRANT} {_BSD_TWO} {_BSD_DISCLAIMER}",),
    "bsd-3-clause": (f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_BSD_DISCLAIMER}",),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial [[{2}]] [[international]] license"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives [[{2}]] [[international]] license"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike [[{2}]] [[international]] license"),
    "cc-by": ("creative commons attribution [[{2}]] [[international]] license",),
    "cc0": ("cc0", "dedicated to the public domain"),
    "copyright": ("copyright [[c]] {} all rights reserved",),
    "gpl": (
        "licensed under the [[terms of the]] [[gnu]] general public license [[version {1}]]",
        "under the terms of the gnu general public license as published by the free software foundation",
        "gnu gpl",
        "spdx license identifier gpl",
    ),
    "isc": (_ISC_GRANT, "spdx license identifier isc"),
    "isc-text": (f"{_ISC_GRANT} {_ISC_REST}",),
    "lgpl": ("gnu lesser general public license", "gnu lgpl", "spdx license identifier lgpl"),
    "mit": ("[[released]] [[licensed]] under the [[terms of the]] mit license", _MIT_GRANT, "spdx license identifier mit"),
    "mit-text": (f"{_MIT_GRANT} {_MIT_REST} {_MIT_DISCLAIMER}",),
    "mpl": ("subject to the terms of the mozilla public license [[v]] [[version]] [[{2}]]", "spdx license identifier mpl"),
    "spdx": ("spdx license identifier {1}",),
    "warranty": (
        "without warranty of any kind",
        "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "without warranties or conditions of any kind",
        _BSD_DISCLAIMER,
    ),
}
BASE_SCORE = 0.6

_TOKEN = re.compile(r"\[\[|\]\]|\{\d*\}|[^\s\[\]{}]+")
_ANY = -1
_STOP = byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))


class Automaton:
    """A part of a template as states 0..final; ``steps[s]`` maps a word (or any word) to following states."""

    def __init__(self, tokens: list[str]):
        self.steps: list[dict[int, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []
        at = 0
        for token in tokens:
            if token == "[[":
                opened.append(at)
            elif token == "]]":
                self.free[opened.pop()].append(at)
            elif token[0] == "{":
                first = at
                for _ in range(int(token[1:-1])):
                    at = self._step(at, _ANY)
                # one word is needed; the others may be left out
                for s in range(first + 1, at):
                    self.free[s].append(at)
            else:
                at = self._step(at, hash_bytes(token.encode()))
        if opened:
            raise ValueError(f"an optional region is not closed: {' '.join(tokens)}")
        self.final = at
        self.start = self._closed({0})
        self.firsts = {w for s in self.start for w in self.steps[s]}
        if _ANY in self.firsts or self.final in self.start:
            raise ValueError(f"a template and what follows a region begin with a mandatory word: {' '.join(tokens)}")

    def _step(self, state: int, word: int) -> int:
        self.steps.append({})
        self.free.append([])
        new = len(self.steps) - 1
        self.steps[state].setdefault(word, []).append(new)
        return new

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def ends(self, words: np.ndarray, at: int, stop: int) -> list[int]:
        """Ends (exclusive, ascending) of all matches that begin at ``at``."""
        states, out, i = self.start, [], at
        while states and i < stop:
            word = int(words[i])
            states = self._closed({t for s in states for key in (word, _ANY) for t in self.steps[s].get(key, ())})
            i += 1
            if self.final in states:
                out.append(i)
        return out


class Template:
    """The parts of a template between its ``{}`` regions."""

    def __init__(self, template: str):
        parts: list[list[str]] = [[]]
        for token in _TOKEN.findall(template):
            if token == "{}":
                parts.append([])
            else:
                parts[-1].append(token)
        self.parts = [Automaton(p) for p in parts]
        self.firsts = {w for p in self.parts for w in p.firsts}

    def matches(self, words: np.ndarray, at: dict[int, np.ndarray], stops: np.ndarray, sentence: np.ndarray) -> list[tuple[int, int]]:
        """``(start, end)`` of the longest match from each place.

        ``at`` holds the places of each first word, ``stops`` the end of each word's text and
        ``sentence`` the end of each word's sentence.
        """
        later: tuple[np.ndarray, np.ndarray] | None = None
        for part in reversed(self.parts):
            found = []
            for i in np.sort(np.concatenate([at[w] for w in part.firsts])).tolist():
                ends = part.ends(words, i, int(stops[i]))
                if later is not None:
                    ends = [e for k in ends if (e := self._beyond(k, int(stops[i]), sentence, later))]
                if ends:
                    found.append((i, max(ends)))
            if not found:
                return []
            later = tuple(np.array(x, dtype=np.int64) for x in zip(*found))
        return found

    @staticmethod
    def _beyond(at: int, stop: int, sentence: np.ndarray, later: tuple[np.ndarray, np.ndarray]) -> int:
        """End of the match whose region begins at ``at``, 0 if the template does not go on."""
        if at >= stop:
            return 0
        k = int(np.searchsorted(later[0], at + 1))
        # the region lies in one sentence; what follows may begin the next
        return int(later[1][k]) if k < len(later[0]) and later[0][k] <= sentence[at] and later[0][k] < stop else 0


def breaks_before(g: Group) -> np.ndarray:
    """Whether a new sentence begins at each word.

    It does after ``.``, ``!`` or ``?`` with white space behind it, unless the word before is a
    single letter (an initial), and after an empty line.
    """
    out = np.zeros(len(g.hashes), dtype=bool)
    if len(out) < 2:
        return out
    mark = np.zeros(len(g.buf), dtype=bool)
    mark[:-1] = _STOP[g.buf[:-1]] & SPACE[g.buf[1:]]
    marks = np.concatenate([[0], np.cumsum(mark)])
    lines = np.concatenate([[0], np.cumsum(g.buf == 0x0A)])
    left, right = g.ends[:-1], g.starts[1:]
    initial = g.ends[:-1] - g.starts[:-1] == 1
    out[1:] = ((marks[right] > marks[left]) & ~initial) | (lines[right] - lines[left] > 1)
    return out


def _sentence_ends(g: Group) -> np.ndarray:
    """For each word the place of the first word after its sentence."""
    n = len(g.hashes)
    places = np.append(np.flatnonzero(breaks_before(g)), n)
    return places[np.searchsorted(places, np.arange(n), side="right")]


def _places(g: Group, doc: np.ndarray, phrase: str) -> np.ndarray:
    """Starts of all places of a phrase within one text."""
    words = [hash_bytes(w.encode()) for w in phrase.split()]
    n = len(g.hashes) - len(words) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(g.hashes[:n] == np.uint64(words[0]))
    for k, w in enumerate(words[1:], 1):
        at = at[g.hashes[at + k] == np.uint64(w)]
    return at[doc[at] == doc[at + len(words) - 1]]


def _scan_batches(batches: Iterator[pa.RecordBatch], columns: list[str], templates: dict[str, tuple[str, ...]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    compiled = [(label, Template(t)) for label, texts in templates.items() for t in texts]
    firsts = np.array(sorted({w for _, t in compiled for w in t.firsts}), dtype=np.uint64)
    for batch in batches:
        for g in groups(batch.column("_text"), PUNCT, fold=True):
            doc, n = g.doc_of_word(), g.size
            base: list[set[str]] = [set() for _ in range(n)]
            found: list[list[tuple[str, int, int]]] = [[] for _ in range(n)]
            starts = []
            for phrase, label in PHRASES.items():
                at = _places(g, doc, phrase)
                starts.append(at)
                for d in np.unique(doc[at]).tolist():
                    base[d].add(label)
            at = np.concatenate(starts)
            owner, own = doc[at], at - g.bounds[doc[at]]
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            np.minimum.at(first, owner, own)
            np.maximum.at(last, owner, own)
            count = np.bincount(owner, minlength=n)
            some = np.flatnonzero(np.isin(g.hashes, firsts))
            met = g.hashes[some]
            first_at = {int(w): some[met == w] for w in firsts}
            stops, sentence = g.bounds[1:][doc], _sentence_ends(g)
            for label, template in compiled:
                for i, end in template.matches(g.hashes, first_at, stops, sentence):
                    found[doc[i]].append((label, i - int(g.bounds[doc[i]]), end - i))
            none = count == 0
            labels = [sorted(base[k] | {x[0] for x in found[k]}) for k in range(n)]
            matches = [[{"label": a, "start": b, "n": c} for a, b, c in found[k]] for k in range(n)]
            score = [1.0 if found[k] else BASE_SCORE if base[k] else 0.0 for k in range(n)]
            part = batch.slice(g.first, n)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in columns),
                    pa.array(np.diff(g.bounds)),
                    pa.array(count),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array([",".join(sorted(b)) for b in base]),
                    pa.array([",".join(x) for x in labels]),
                    pa.array(score),
                    pa.array(matches, schema.field("matches").type),
                ],
                schema=schema,
            )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Counts, labels and template matches (label, first word, words) of each text."""
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    out = StructType([rows.schema[key]])
    for name in ("n_words", "n_base", "first_word", "last_word"):
        out = out.add(name, "long")
    out = out.add("base_labels", "string").add("labels", "string").add("score", "double")
    found = docs.sparkSession.createDataFrame([], "matches array<struct<label:string,start:long,n:long>>").schema["matches"]
    return map_batches(rows, _scan_batches, StructType([*out, found]), [key], templates)
