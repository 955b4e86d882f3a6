"""Decontamination beside a plain window scan."""

import random
import re

import pytest

from flowloom.llm import op9_decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def plain(docs, bench):
    runs = {}
    for item, text in bench:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1) if n else ():
            runs.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if i + n <= len(w) and tuple(w[i : i + n]) in runs:
                    hit |= set(range(i, i + n))
                    items |= runs[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(items), sorted(items)))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    pick = lambda n, a: " ".join(rng.choice(a) for _ in range(n))
    bench = [(i, pick(rng.choice([12, 15, 30]), "abcdefgh")) for i in range(12)] + [(20, None), (21, "..."), (22, "Only Three wörds"), (23, "solo"), (9, "z " * 14)]
    docs = [(0, None), (1, ""), (2, "!?"), (3, "solo"), (3, "solo"), (4, "x Solo-y only THREE, wörds"), (5, "z " * 40), (None, "solo")]
    for i in range(6, 60):
        part = rng.choice(bench)[1] or ""
        docs.append((i, pick(rng.randrange(30), "abcdefghij") + ". " + rng.choice([part, part.upper(), part[4:40]]) + ",\n" + pick(rng.randrange(900), "abkl")))
    return docs, bench


@pytest.mark.parametrize("limit", [op.BROADCAST_BYTES, 0])
def test_hits_match_brute_force(spark, tables, limit):
    docs, bench = tables
    d = spark.createDataFrame([(*r, "e") for r in docs], "doc_id long, text string, item string").repartition(3)
    b = spark.createDataFrame([(*r, "e") for r in bench], "item_id long, text string, len string")
    hits = op.find_hits(d, b, broadcast_bytes=limit)
    got = op.digest(hits.withColumn("names", hits["items"])).collect()
    listed = [(r.doc_id, r.n_words, len(r.hits), len(r["items"]), r["items"]) for r in hits.collect() for _ in range(r.n_rows)]
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(listed, key=order) == sorted(plain(docs, bench), key=order)
    assert len(got) == len(docs) and all(r.contaminated == (r.n_hit > 0) for r in got)


def test_long_text_is_shuffled_by_windows(spark, capsys):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(50_000)}" for _ in range(20_000))
    w = text.split()
    bench = [(i, " ".join(w[i * 700 : i * 700 + 25])) for i in range(20)] + [(50, "w1 none such"), (51, w[-1])]
    docs = [(1, text), (2, text), (2, text), (3, "clean " * 2_000), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(bench, "item_id long, text string")
    near, far = (op.find_hits(d, b, broadcast_bytes=limit) for limit in (op.BROADCAST_BYTES, 0))
    rows = [sorted((r.doc_id, r.n_rows, r.n_words, tuple(sorted(r.hits)), tuple(r["items"])) for r in x.collect()) for x in (near, far)]
    assert rows[0] == rows[1]
    assert [(r[0], r[1], len(r[3]), list(r[4])) for r in rows[1]] == [(x[0], n, x[2], x[4]) for x, n in zip(plain(dict(docs).items(), bench), (1, 2, 1, 1))]
    far.explain("formatted")
    steps = capsys.readouterr().out.split("\n\n")
    sent = [x for x in steps if "Exchange" in x.strip().split("\n")[0] and "_run#" in x]
    assert sent and all("_words#" not in x for x in sent)


def test_removal_takes_all_windows_and_leaves_clean_rows(spark, tables):
    docs, bench = tables
    d = spark.createDataFrame([(i, t, "e") for i, t in docs], "doc_id long, text string, _row string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    left = op.remove_hits(d, b)
    assert left.columns == d.columns
    clean = {x[0] for x in plain(docs, bench) if not x[2]}
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert {k: t for k, t in kept if k in clean} == {i: t for i, t in docs if i in clean}
    assert [x for x in kept if x[0] is None] == []


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in op.digest(op.find_hits(d, b)).collect()] == [(1, 3, 0, 0)]
    assert op.find_hits(d.limit(0), b).count() == 0
    assert op.remove_hits(d, b).collect() == d.collect()
