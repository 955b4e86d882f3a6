"""Hard negatives: against brute force, packing, bounds, pruning, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import op13_negatives as op


def plain(rows, n_positives=op.N_POSITIVES, n_negatives=op.N_NEGATIVES):
    kept = []
    for i, v, lab in rows:
        if lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(x)) for x in v], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab))
    out = []
    for i, v, lab in kept:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m) for j, w, m in kept if len(w) == len(v))
        positives = [x for x in scored if x[3] == lab and (x[1] or x[2] != i)][:n_positives]
        for s, null, j, _ in positives:
            inside = [x for x in scored if x[3] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:n_negatives]
            out += [(i, None if null else j, r, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(inside, 1)]
    return sorted(out, key=repr)


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, rank int").repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = op.mine(op.quantized(frame, label), F.col("id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def table(seed, n=700, dim=6, coarse=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    rows = []
    for i in range(n):
        lab = int(rng.integers(0, 10))
        v = centres[lab] + rng.normal(size=dim)
        rows.append((i, [float(x) for x in (np.round(v) / 2 if coarse else v)], lab))
    return rows


@pytest.mark.parametrize("coarse", [False, True])
def test_like_brute_force(spark, coarse, monkeypatch):
    for name, size in (("TILE", 90), ("LEAF", 8), ("ANCHORS", 3), ("FAN", 3)):
        monkeypatch.setattr(op, name, size)
    rows = table(1, coarse=coarse)  # coarse: many equal scores
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = table(2, 230)
    extra = [(900, None, 1), (1000, [0.1] * 6, None), (1100, [0.1, None, 0.2, 0.1, 0.1, 0.1], 2), (1200, [float("nan")] * 6, 2), (1300, [float("inf")] * 6, 2)]
    extra += [(None, rows[3][1], rows[3][2]), (1400, [1.0, 2.0], 3), (1401, [1.0, 1.0], 3), (1402, [0.5, 0.5], 4), (1500, [], 3), (1501, [], 3), (1502, [], 5)]
    extra += [rows[5], rows[5], (200, rows[7][1], rows[200][2])] + [(2001 + k, rows[11][1], 8) for k in range(40)]
    assert mined(spark, rows + extra) == plain(rows + extra)


def test_empty_and_alone(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-2e5, 2e5) for _ in range(4)], rng.randrange(3)) for k in range(150)]
    assert mined(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(4))
def test_packing_keeps_all_rows_in_pure_leaves(seed):
    rng = np.random.default_rng(seed)
    values, labels = rng.integers(-99, 99, (500, 5)), rng.integers(0, [3, 40, 500, 1][seed], 500)
    order, cuts = op.str_order(values, labels, 16)
    assert sorted(order.tolist()) == list(range(500)) and cuts[0] == 0 and cuts[-1] == 500 and (np.diff(cuts) > 0).all() and (np.diff(cuts) <= 16).all()
    for a, b in zip(cuts, cuts[1:]):
        held, n = np.unique(labels[order[a:b]], return_counts=True)
        assert len(held) == 1 or all(np.count_nonzero(labels == k) < 16 for k in held)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_hold_all_products_and_prune(seed):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 6, 2000)
    values = (rng.normal(size=(6, 4))[labels] * 300 + rng.normal(size=(2000, 4)) * 20).astype(np.int64)
    tree = op.Tree(np.arange(2000), np.zeros(2000, bool), labels, values)
    queries = values[:20].astype(float)
    bounds = tree.intervals(queries, True)
    products = queries @ tree.float.T
    for n, (a, b) in enumerate(zip(tree.cuts, tree.cuts[1:])):
        assert (bounds[0][0][:, n] <= products[:, a:b].min(axis=1)).all() and (bounds[0][1][:, n] >= products[:, a:b].max(axis=1)).all()
    for level in range(1, len(bounds)):
        for n in range(bounds[level][0].shape[1]):
            below = slice(n * op.FAN, (n + 1) * op.FAN)
            assert (bounds[level][0][:, n] <= bounds[level - 1][0][:, below].min(axis=1)).all()
    opened = 0
    for q in range(20):
        w = op.Wanted(5, -(1 << 62), 1 << 62)
        opened += op.best_first(tree, bounds, q, queries[q], True, int(labels[q]), True, q, [w])
        same = [(-int(p), int(i)) for p, i, m in zip(products[q], tree.ids, tree.labels) if m == labels[q] and i != q]
        assert [(-s, i) for s, i in zip(w.score.tolist(), w.id.tolist())] == sorted(same)[:5]
    assert opened < 20 * len(tree.cuts) / 6
