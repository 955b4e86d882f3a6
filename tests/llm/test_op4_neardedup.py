"""Near-duplicate classes beside exact set similarity of all pairs."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from flowloom.llm import op4_neardedup as op
from flowloom.llm.wordtable import mix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    w = WORD.findall((text or "").translate(FOLD))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def classes(texts):
    """Row number -> least row number of its class."""
    sets, root = [runs(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by_run = defaultdict(set)
    for i, s in enumerate(sets):
        for r in s:
            by_run[r].add(i)
    pairs = {p for rows in by_run.values() for p in combinations(sorted(rows), 2)}
    for i, j in pairs:
        common = len(sets[i] & sets[j])
        if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out = [None, "", "...", "one two", "One, two!", "one two three", "x " * 5000, "y " * 9 + "z"]
    base = [word() for _ in range(120)]
    for _ in range(90):  # one large group of near copies, over SMALL_BUCKET
        copy = list(base)
        copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    for _ in range(25):
        own = [word() for _ in range(rng.randrange(6, 300))]
        out.append(" ".join(own))
        for _ in range(rng.randrange(4)):
            copy = list(own)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        out.append(" ".join(own).upper())
    chain = [word() for _ in range(400)]  # ends differ, neighbours are alike
    out += [" ".join(chain[i : i + 200]) for i in range(0, 120, 12)]
    rng.shuffle(out)
    return out


def test_classes_match_all_pairs(spark, texts):
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(4)
    got = {r.doc_id: r for r in op.near_duplicates(docs).collect()}
    assert [got[i].class_id for i in range(len(texts))] == classes(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    left = op.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(classes(texts)))


def test_repeated_rows_and_ids(spark):
    a, b = "one two three four five six seven", "a completely different text of some words"
    rows = [(1, a, 1), (1, a, 2), (1, b, 3), (None, a, 4), (2, None, 5), (2, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    assert op.near_duplicates(docs).count() == 6
    left = [(r.doc_id, r.text) for r in op.drop_near_duplicates(docs).collect()]
    assert sorted(left, key=str) == sorted([(1, a), (1, b), (2, None)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_duplicates(docs).count() == 0
    assert op.drop_near_duplicates(docs).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    names = mix(np.arange(300, dtype=np.uint64))
    x, y = rng.uniform(0, 3, 300), rng.uniform(0, 3, 300)
    y[:200] = x[:200]
    t = 4096
    doc = np.repeat([0, 1], 300)
    sig = op.dart_signatures(doc, np.concatenate([names, names]), 2, t, weight=np.concatenate([x, y]))
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert (sig != 0).all()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_signature_does_not_depend_on_neighbours():
    names = mix(np.arange(50, dtype=np.uint64))
    alone = op.dart_signatures(np.zeros(50, np.int64), names, 1)
    both = op.dart_signatures(np.repeat([0, 1], [50, 3]), np.concatenate([names, names[:3]]), 2)
    assert (alone[0] == both[0]).all()


def matrix_classes(sets):
    """Row number -> least row number of its class, for one large family."""
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for r in s:
            held[r].append(i)
    shared = [rows for rows in held.values() if len(rows) > 1]
    m = np.zeros((len(sets), len(shared)), np.float32)
    for k, rows in enumerate(shared):
        m[rows, k] = 1
    common, size = (m @ m.T).astype(int), np.array([len(s) for s in sets])
    alike = 5 * common >= 4 * (size[:, None] + size[None] - common)
    root = np.arange(len(sets))
    while True:
        low = np.where(alike, root[None], len(sets)).min(axis=1)
        low = np.minimum(low, root)
        if (low == root).all():
            return root.tolist()
        root = low


def sparse_family(n, seed=5):
    """Texts of one page form, few of them near copies of each other."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(5))
    base, out = [word() for _ in range(150)], []
    for _ in range(n):
        near = out and rng.random() < 0.1
        copy = rng.choice(out).split() if near else list(base)
        for _ in range(1 if near else 3):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out


def test_sparse_family_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_RUNS", 40_000)  # several blocks
    texts = sparse_family(2000)
    want = matrix_classes([runs(t) for t in texts])
    assert 1000 < len(set(want)) < 2000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in op.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("cell, meetings", [(200, 50), (10**9, 50), (0, 1000)])
def test_block_links_match_all_pairs(monkeypatch, cell, meetings):
    for name, value in (("CELL", cell), ("MEETINGS", meetings), ("STEP", 7), ("COLUMNS", 5)):
        monkeypatch.setattr(op, name, value)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 60)
    sets = []
    for _ in range(80):
        kept = base[rng.random(60) < rng.choice([0.85, 0.9, 0.95])]
        sets.append(np.concatenate([kept, rng.integers(0, 1 << 60, rng.integers(0, 5))]))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for split in (None, 30):
        left = np.ones(80, bool) if split is None else np.arange(80) < split
        right = np.ones(80, bool) if split is None else ~left
        links = op.block_links(np.concatenate(sets), bounds, left, right, np.arange(80))
        alike = {(i, j) for i in np.flatnonzero(left) for j in np.flatnonzero(right) if i != j and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
        assert alike and set(links) <= alike

        def joined(pairs):
            root = list(range(80))
            for _ in range(80):
                for i, j in pairs:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        assert joined(links) == joined(alike)


def test_family_does_not_depend_on_other_texts(spark):
    texts = sparse_family(1000, seed=8)
    rng = random.Random(9)
    own = [" ".join(rng.choices("abcdefghij", k=40)) for _ in range(20)]
    others = [f"{t} {e}" for t in own for e in ("", "u", "v", "u v")]
    want = matrix_classes([runs(t) for t in texts])
    for more in ([], others):
        docs = spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.class_id for r in op.near_duplicates(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want
