"""License scans beside regular expressions over word lists."""

import random
import re
import time

import pytest

from flowloom.llm import op7_license as op
from flowloom.llm.wordtable import hash_bytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pattern(template):
    """The template over words that each end in one space; ``|`` before a word begins a sentence."""
    out = ""
    for token in re.findall(r"\[\[|\]\]|\{\d*\}|[^\s\[\]{}]+", template):
        if token in ("[[", "]]"):
            out += {"[[": "(?:", "]]": ")?"}[token]
        elif token == "{}":
            out += r"\|?[^ |]+ (?:[^ |]+ )*?"
        else:
            out += rf"(?:\|?[^ |]+ ){{1,{token[1:-1]}}}" if token[0] == "{" else r"\|?" + re.escape(token) + " "
    return re.compile("(?<![^ |])" + out)


def sentences(text):
    """The words of a text, marked where a sentence begins."""
    out, last = "", None
    for m in WORD.finditer(text):
        gap = text[last.end() : m.start()] if last else ""
        stop = re.search(r"[.!?][ \t-\r]", gap) and len(last[0].encode()) > 1
        out += ("|" if stop or gap.count("\n") > 1 else "") + m[0] + " "
        last = m
    return out


def plain(text):
    words = WORD.findall((text or "").translate(FOLD))
    at, base, labels = [], set(), set()
    for phrase, label in op.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += hits
        base |= {label} if hits else set()
    joined = sentences((text or "").translate(FOLD))
    for label, texts in op.TEMPLATES.items():
        if any(pattern(t).search(joined) for t in texts):
            labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = [None, "", "...", "CC-BY", "cc by cc by-nc 4.0", "All rights\nreserved. all RIGHTS reserved", "general public", "x " * 100_000 + "General Public License"]
    pool = [t for v in op.TEMPLATES.values() for t in v]
    for _ in range(400):
        t = rng.choice(pool)
        t = re.sub(r"\{\}", lambda m: rng.choice(["q", "2020 the holders", "2020 a. b. and others " * 3, "one. two", "x\n\ny"]), t)
        t = re.sub(r"\{\d+\}", lambda m: " ".join("qz"[: rng.randrange(3)]), t)
        t = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: rng.choice(["", m[1]]), t).replace("[[", "").replace("]]", "")
        w = t.split(" ")
        if rng.random() < 0.4 and w:
            w.insert(rng.randrange(len(w)), "stray")
        out.append(rng.choice(["", "text "]) + rng.choice([" ", ", ", "-"]).join(w).upper() + rng.choice(["", " more é"]))
    return out


def test_matches_plain_scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(3)
    got = {r.doc_id: tuple(r)[1:7] for r in op.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
    assert all(0 <= r.score <= 1 for r in op.scan(docs).collect())
    assert op.scan(docs.limit(0)).count() == 0


def test_mandatory_wording_is_exact():
    a = op.Automaton("one [[ two ]] {2} three".split())
    words = lambda t: [hash_bytes(w.encode()) for w in t.split()]
    tried = {t: max(a.ends(words(t), 0, len(t.split())), default=0) for t in ("one x three", "one two x y three z", "one two three", "one three", "one x y z three", "one two x y z three")}
    assert tried == {"one x three": 3, "one two x y three z": 5, "one two three": 3, "one three": 0, "one x y z three": 0, "one two x y z three": 0}
    for bad in ("[[all]] {1} rights", "{} all rights", "copyright {} [[all]]", "copyright [[ {} all ]]"):
        with pytest.raises((ValueError, IndexError)):
            op.Template(bad)


MIT = """MIT License

Copyright (c) 2020 The Regents of the University of California. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def labels_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in op.scan(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_whole_licenses_and_open_regions(spark):
    wrong = MIT.replace("sublicense, ", "")
    texts = [
        MIT,
        wrong,
        "Copyright (c) 2020 The Regents of the University of California. All rights reserved.",
        "Copyright 1999 J. Q. Public and many others at some institute. All rights reserved.",
        "Copyright is a right. It is old. All rights reserved.",
        "Copyright 2020 by us\n\nand others, all rights reserved.",
        "It is released under the terms of the MIT License.",
        "GNU GPL v3; SPDX-License-Identifier: Apache-2.0",
        "This program comes WITHOUT WARRANTY OF ANY KIND.",
    ]
    assert labels_of(spark, texts) == ["copyright,mit,mit-text,reserved,warranty", "copyright,mit,reserved,warranty", "copyright,reserved", "copyright,reserved", "reserved", "reserved", "mit", "apache,gpl,spdx", "warranty"]


def test_many_beginnings_in_one_sentence_are_linear(spark):
    texts = ["copyright x all rights " * 50_000, "copyright x " * 100_000 + "all rights reserved", "copyright " * 5 + "all all rights reserved " * 50_000]
    began = time.time()
    assert labels_of(spark, texts) == ["", "copyright,reserved", "copyright,reserved"]
    assert time.time() - began < 60
