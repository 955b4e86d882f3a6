"""Ranked search: against plain scoring, exact sums, ties, blocks, odd rows."""

import math
import random
import re

import numpy as np
import pytest

from flowloom.llm import op12_search as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, k=op.TOP):
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        rows = []
        for d, b in bags:
            score = 0
            for t in terms(text):
                if tf := b.count(t):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * tf) // (1000 * tf + 12 * (75 + (25 * len(b) * n_docs) // length)))
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def case(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "été", "Été", "a1", "x", "中文", "zz", *(f"w{k}" for k in range(40))]
    say = lambda most: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, most)))
    docs = [(k, say(60)) for k in range(n)]
    docs += [(k + n, docs[3][1]) for k in range(40)] + [(5, docs[5][1]), (None, docs[3][1]), (None, None), (n + 90, ""), (n + 91, "--- !!"), (n + 92, "w1 " * 5000)]
    items = [(k, say(12)) for k in range(9)] + [(3, "w1 w1 w1 w2"), (None, "x w3"), (20, None), (21, ""), (22, "nowhere"), (23, docs[3][1])]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, score int").repartition(5), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [op.BLOCK_BYTES, 60])
def test_like_plain_scoring(spark, block_bytes):
    docs, items = case(1)
    got = op.search(*frames(spark, docs, items), block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, items)


def test_ties_by_document_id_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(op, "MERGE", 2)
    docs = [(k, "one two") for k in range(300, 0, -1)] + [(1000 + k, "three") for k in range(300)]
    frame, items = frames(spark, docs, [(1, "one")])
    got = op.search(frame.repartition(16), items).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 21)) and [r["rank"] for r in got] == list(range(1, 21)) and len({r.score for r in got}) == 1


def test_empty_tables(spark):
    docs, items = frames(spark, *case(2, 20))
    assert op.search(docs.limit(0), items).count() == 0 and op.search(docs, items.limit(0)).count() == 0
    assert op.search(docs, items.filter("item_id > 19 and item_id < 23")).count() == 0


def test_tiles_are_exact_where_sums_are_large():
    rng = np.random.default_rng(3)
    block = op.Block.of([(k, " ".join(f"w{j}" for j in rng.integers(0, 50, 200))) for k in range(6)])
    weight = rng.integers(1, 10**6, len(block.terms)) | 1
    doc, term = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(len(weight)), indexing="ij"))
    impact = rng.integers(1, op.MOST_IMPACT, len(doc))
    want = np.zeros((6, 30), np.int64)
    for i, t, c in zip(block.item, block.term, block.times):
        want[i] += c * weight[t] * impact[term == t]
    for exact in (1 << 53, 10**13, 10**12, 10**6):  # one tile, several, integer products
        tiles = op.vocabulary_tiles(block, weight, exact=exact)
        assert [(a, b) for a, b, _ in tiles] == sorted((a, b) for a, b, _ in tiles) and sum(b - a for a, b, _ in tiles) == len(weight)
        assert (op._tile_scores(tiles, doc, term, impact, 30, 6) == want).all()
    assert len(op.vocabulary_tiles(block, weight)) == 1 and len(op.vocabulary_tiles(block, weight, terms=7)) == -(-len(weight) // 7)


@pytest.mark.parametrize("seed", range(3))
def test_best_keeps_the_same_rows_in_any_order(seed):
    rng = np.random.default_rng(seed)
    scores, ids = rng.integers(0, 6, (4, 200)), rng.permutation(200)
    unknown = rng.random(200) < 0.1
    best = op.Best(4, 10)
    for part in np.array_split(rng.permutation(200), 17):
        best.offer(scores[:, part], ids[part], unknown[part])
    for i, (s, d, u) in enumerate(best.held):
        at = np.flatnonzero(scores[i] > 0)
        order = at[np.lexsort((ids[at], unknown[at], -scores[i, at]))[:10]]
        assert (s == scores[i, order]).all() and (d == ids[order]).all() and (u == unknown[order]).all()
