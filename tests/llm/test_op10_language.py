"""Language identification: held-out accuracy, and a plain word-first backoff beside it."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowloom.llm import op10_language as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"


def plain(train, texts):
    """The best language of each text, by dictionaries."""
    spoken = lambda t: [w for w in WORD.findall((t or "").translate(FOLD)) if not w[0].isdigit()]
    counts = [defaultdict(Counter) for _ in range(op.LONGEST + 1)]
    for text, lang in train:
        for w in spoken(text):
            counts[0][w][lang] += 1
            for n in range(1, op.LONGEST + 1):
                for i in range(len(w) + 3 - n):
                    counts[n][f" {w} "[i : i + n]][lang] += 1
    langs = sorted({x for _, x in train})
    tables = []
    for c in counts:
        c = {k: v for k, v in c.items() if sum(v.values()) >= 2}
        total = {x: sum(v[x] for v in c.values()) for x in langs}
        tables.append({k: [math.log((v[x] + 0.1) / (total[x] + 0.1 * (len(c) + 1))) for x in langs] for k, v in c.items()} | {None: total})
    words = tables[0].pop(None)
    prior = [math.log((words[x] + 1) / (sum(words.values()) + len(langs))) for x in langs]
    out = []
    for text in texts:
        score = list(prior)
        for w in spoken(text):
            if w in tables[0]:
                score = [a + b for a, b in zip(score, tables[0][w])]
                continue
            for i in range(len(w) + 2):
                for n in range(op.LONGEST, 0, -1):
                    gram = f" {w} "[i : i + n]
                    if len(gram) == n and gram in tables[n]:
                        score = [a + b for a, b in zip(score, tables[n][gram])]
                        break
        out.append(langs[max(range(len(langs)), key=lambda k: (round(score[k], 2), -k))] if any(c.isalpha() for c in text or "") else "und")
    return out


def test_matches_plain_backoff(spark):
    train = [("the cat sat on the mat the cat", "en"), ("the dog sat and the dog ran", "en"), ("der hund saß auf der matte", "de"), ("die katze saß auf dem hund der katze", "de"), ("le chien était sur le tapis élevé", "fr"), ("le chat était élevé", "fr")]
    texts = [None, "", "12 34", "...", "cat", "Katzen", "catsat hundes", "tapisserie chiens", "élevés", "中文", "sat sat der le 3d"]
    model = op.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, score int").repartition(3)
    got = {r.doc_id: r for r in op.predict(docs, model, keep={"doc_id": F.col("doc_id")}).collect()}
    assert [got[i].lang_pred for i in range(len(texts))] == plain(train, texts)
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("fold", [True, False])
def test_accuracy(spark, fold):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op.identify(docs).filter(F.col("held_out") == fold).join(docs, "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.98


def test_no_labels_and_kept_rows(spark):
    docs = spark.createDataFrame([(1, "words here", None, "a"), (2, None, "en", "b"), (None, "more words", None, "c")], "doc_id long, text string, lang string, lang_pred string")
    assert {r.lang_pred for r in op.identify(docs).collect()} == {"und"}
    docs = docs.union(spark.createDataFrame([*((i, "some words here here", "en", "d") for i in range(4)), (3, "!!", "en", "e")], docs.schema))
    left = op.known_language(docs)
    assert left.columns == docs.columns
    assert sorted(r.lang_pred for r in left.collect()) == ["a", "c", "d", "d", "d", "d"]
    assert op.known_language(docs.limit(0)).count() == 0
