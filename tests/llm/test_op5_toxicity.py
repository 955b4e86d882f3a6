"""Toxicity: held-out quality on labelled rows, features beside plain counts, odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.llm import op5_toxicity as op
from flowloom.llm.wordtable import PUNCT, SPACE, HashRows, groups, hash_bytes

SF = "/root/testdata/sf0.1"


def auc(pairs):
    order = sorted(pairs)
    ranks, i = {}, 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        ranks[order[i][0]] = (i + j + 1) / 2
        i = j
    pos = [s for s, y in pairs if y]
    return (sum(ranks[s] for s in pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (len(pairs) - len(pos)))


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = op.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("doc_id", "score", "toxic", "predicted").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert auc([(r.score, r.toxic) for r in rows]) > 0.9
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit > 0.8 * sum(r.toxic for r in rows) and hit > 0.85 * sum(r.predicted for r in rows)


def test_features_match_plain_counts():
    texts = ["you idiot, IDIOT! far far far far far far idiotic", "", "ID1OT s@@t aaaab Nice", "no list words here you"]
    words = HashRows(np.array([hash_bytes(b"idiot")], dtype=np.uint64))
    begin = {5: HashRows(np.array([hash_bytes(b"idiot")], dtype=np.uint64))}
    you = HashRows(np.array([hash_bytes(b"you")], dtype=np.uint64))
    column = pa.array(texts)
    got = [dict(zip(op.FEATURES, row)) for g, f in zip(groups(column, PUNCT, fold=True), groups(column, SPACE)) for row in np.concatenate([op._features(g, words, begin, you), op._form_features(f)], axis=1)]
    first = got[0]
    assert first["lexicon"] == pytest.approx(2 / 10) and first["prefix"] == pytest.approx(3 / 10)
    assert first["near_you"] == pytest.approx(2 / 10) and first["you"] == pytest.approx(1 / 10) and first["lexicon_kinds"] == 1
    assert set(got[1].values()) == {0.0}
    assert got[2]["leet"] == pytest.approx(1 / 4) and got[2]["marked"] == pytest.approx(1 / 4) and got[2]["stretched"] > 0
    assert got[3]["lexicon"] == 0 and got[3]["near_you"] == 0


def test_nothing_to_learn_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (2, "a b", 3.0), (None, "x", 4.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in op.toxicity(docs, none).collect()] == [(0.0, 0)] * 4
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    assert op.toxicity(docs, one).filter(F.col("score").between(0, 1)).count() == 4
    assert op.toxicity(docs.limit(0), one).count() == 0
