"""N-gram Jaccard join: against all pairs, the bounds behind the lists, families, odd rows."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import op11_jaccard as op
from flowloom.operators.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def plain(rows):
    """``(id, n, component)`` of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_row = not a and not b and rows[i][0] == rows[j][0]  # rows without words go by id
            common = len(a & b)
            if same_row or a and b and 100 * common >= 85 * (len(a) + len(b) - common):
                root[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def joined(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, node string, n int").repartition(4)
    got = op.components(docs)
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r)[:3] for r in got.collect()), key=repr)


def corpus(seed, n, length, edits, passage=()):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    rows = []
    while len(rows) < n:
        base = rng.choices(vocab, k=rng.randrange(*length))
        if passage:
            base[5:5] = passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.randrange(*edits)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choices(vocab, k=rng.randrange(3))
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("small", [1, op.SMALL_LIST])
def test_like_all_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(op, "SMALL_LIST", small)
    rows = corpus(1, 150, (1, 90), (0, 5)) + [(k + 200, t) for k, t in corpus(2, 60, (4, 12), (0, 2))]
    odd = ["", " \t", None, "A b C", "a B c", "a b c d", "one", "One", "ONE two", "x " * 5000, "x " * 5001, "Été a b c", "été a b c"]
    rows += [(500 + k, t) for k, t in enumerate(odd)] + [(500, ""), (500, None), (3, rows[40][1]), (None, rows[40][1]), (None, None), (None, None), (None, "alone here"), (7, rows[7][1])]
    assert joined(spark, rows) == plain(rows)


def test_family_of_common_passages(spark, monkeypatch):
    """Texts of a few passages in any order share hot runs without being similar; some are."""
    monkeypatch.setattr(op, "BLOCK_RUNS", 900)
    rng = random.Random(5)
    passages = [rng.choices([f"p{k}" for k in range(900)], k=25) for _ in range(12)]
    rows = []
    for _ in range(70):
        text = [w for p in rng.sample(passages, rng.randrange(3, 8)) for w in p]
        for _ in range(rng.choice([1, 2])):
            words = list(text)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"q{rng.randrange(99)}"
            rows.append((len(rows), " ".join(words)))
    assert joined(spark, rows) == plain(rows)


def test_chain_family(spark, monkeypatch):
    """Near copies of near copies: one component whose ends have little in common."""
    monkeypatch.setattr(op, "BLOCK_RUNS", 2500)
    rng, words, rows = random.Random(6), [f"c{k}" for k in range(80)], []
    for k in range(90):
        rows.append((1000 - k, " ".join(words)))
        words[rng.randrange(80)] = f"d{k}"
    got = joined(spark, rows)
    assert got == plain(rows)


def test_empty_table(spark):
    assert joined(spark, []) == [] and joined(spark, [(1, None), (2, "a b")]) == [(1, 0, 1), (2, 1, 2)]


@given(st.integers(1, 400), st.integers(1, 400), st.integers(0, 400))
@settings(max_examples=400, deadline=None)
def test_bounds(s, t, common):
    s, t = min(s, t), max(s, t)
    common = min(common, s)
    if Fraction(common, s + t - common) < Fraction(85, 100):
        return
    assert s - common <= op.missing(s) and t - common <= op.spare(t) and op.probes(s) <= op.probes(t)
    assert s == t == common or s >= op.LEAST_RUNS
    assert s < op.LEAST_RUNS or common >= op.probes(s)


@given(st.lists(st.sets(st.integers(0, 40)), min_size=1, max_size=30), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_t_occurrence(sets, least):
    lists = [np.array(sorted(x)) for x in sets if x]
    member, count = op.t_occurrence(lists, least)
    want = {v: n for v in range(41) if (n := sum(v in x for x in sets)) >= least}
    assert dict(zip(member.tolist(), count.tolist())) == want


@given(st.lists(st.tuples(st.sets(st.integers(-9, 30)), st.sets(st.integers(-9, 30))), max_size=12))
@settings(max_examples=100, deadline=None)
def test_count_common(pairs):
    flat = lambda k: np.array([v for p in pairs for v in sorted(p[k])], np.int64)
    sizes = lambda k: np.array([len(p[k]) for p in pairs], np.int64)
    assert op.count_common(flat(0), sizes(0), flat(1), sizes(1)).tolist() == [len(a & b) for a, b in pairs]


def test_no_table_goes_through_the_driver(spark):
    """Joins were broadcasts of up to 10 MB shuffled, which the driver holds unpacked and several at a time."""
    rows = [(k, f"a b c d e f g h i j {k % 3} l m n o p q r s t") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    nodes = docs.selectExpr("doc_id AS node", "20 AS n", "array(doc_id % 5, 7L, 9L) AS first")
    lists = op.inverted_lists(nodes)
    asked = op.asked_runs(lists)
    for out in (op.components(docs), connected_components(links, "a", "b"), lists, op.candidate_pairs(lists, asked), op.long_lists(lists, asked)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
