"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density of lexicon words and of words with a lexicon prefix,
second-person words near them, capitals, punctuation, and rates of obfuscated words.
The lexicon is learned: words and word beginnings that stand in toxic rows far more
often than in the others, kept as hashes. Trees learn on two thirds of a sample of
labelled rows of about ``MAX_ROWS``, the calibration on the rest; counting, scoring and
everything else covers all rows and whole texts.

Defined results: null texts are empty and get a score like any other; without labelled
rows of both classes the score is the share of toxic ones (0 without any); a row that is labelled
twice counts twice; repeated rows are scored alike; a null key is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from flowloom.llm.arrow import map_batches
from flowloom.llm.sample import crc_fold, hash_share
from flowloom.llm.stored import stored
from flowloom.llm.wordtable import PUNCT, SPACE, Group, HashRows, byte_class, groups, hash_bytes, span_hashes

MAX_ROWS = 20_000
MAX_TERMS = 500
MIN_ROWS = 4
MIN_RATIO = 8.0
PREFIXES = (4, 5, 6)
NEAR = 5
THRESHOLD = 0.3
TREES, DEPTH, STEP = 20, 3, 0.3

#: Words of address in the languages at hand (fixed values).
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes vosotros ti tus".split()

_UPPER = byte_class((0x41, 0x5A))
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
_DIGIT = byte_class((0x30, 0x39))
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"@$!*#+|")] = True
_SHOUT = np.zeros(256, dtype=bool)
_SHOUT[list(b"!?")] = True
FEATURES = ("words", "lexicon", "lexicon_kinds", "prefix", "prefix_kinds", "near_you", "you", "capitals", "caps_words", "shouts", "punctuation", "leet", "marked", "stretched")


def _prefix_hashes(g: Group, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of k bytes or more, and the hashes of their first k bytes."""
    at = np.flatnonzero(g.ends - g.starts >= k)
    return at, span_hashes(g.buf, g.starts[at], g.starts[at] + k)


def _term_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each text with its label; kind 0 is a word, k a beginning of k bytes."""
    for batch in batches:
        label = np.asarray(batch.column("toxic"))
        for g in groups(batch.column("text"), PUNCT, fold=True):
            doc = g.doc_of_word()
            for kind, (at, hashes) in [(0, (np.arange(len(doc)), g.hashes)), *((k, _prefix_hashes(g, k)) for k in PREFIXES)]:
                pair = np.unique(np.stack([doc[at].astype(np.uint64), hashes]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                n = pair.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(pair[1].view(np.int64)), pa.array(label[g.first + pair[0].astype(np.int64)])], schema=schema)


def _by_text(doc: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def _kinds(doc: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    pair = np.unique(doc.astype(np.int64) * (MAX_TERMS + 1) + row)
    return np.bincount(pair // (MAX_TERMS + 1), minlength=n)


def _features(g: Group, words: HashRows, beginnings: dict[int, HashRows], you: HashRows) -> np.ndarray:
    doc, n = g.doc_of_word(), g.size
    count = np.maximum(np.diff(g.bounds), 1)
    row = words.find(g.hashes)
    bad = row >= 0
    listed_doc, listed_row = doc[bad], row[bad]
    begin = np.zeros(len(doc), dtype=bool)
    kinds = np.zeros(n)
    for k, table in beginnings.items():
        at, hashes = _prefix_hashes(g, k)
        found = table.find(hashes)
        begin[at[found >= 0]] = True
        kinds = np.maximum(kinds, _kinds(doc[at[found >= 0]], found[found >= 0], n))
    address = you.find(g.hashes) >= 0
    # words of address within NEAR words of a listed one, in the same text
    reach = np.concatenate([[0], np.cumsum(address)])
    any_bad = np.flatnonzero(bad | begin)
    low = np.maximum(any_bad - NEAR, g.bounds[doc[any_bad]])
    high = np.minimum(any_bad + NEAR + 1, g.bounds[doc[any_bad] + 1])
    near = reach[high] > reach[low]
    return np.stack(
        [
            np.log1p(np.diff(g.bounds)),
            _by_text(listed_doc, n) / count,
            _kinds(listed_doc, listed_row, n),
            _by_text(doc[begin], n) / count,
            kinds,
            _by_text(doc[any_bad[near]], n) / count,
            _by_text(doc[address], n) / count,
        ],
        axis=1,
    )


def _form_features(g: Group) -> np.ndarray:
    """Capitals, punctuation and disguised words, from words between spaces as written."""
    n, doc = g.size, g.doc_of_word()
    out = np.zeros((n, 7))
    for k in range(n):
        part = g.buf[g.offsets[k] : g.offsets[k + 1]]
        letters = max(1, int(np.count_nonzero(_LETTER[part])))
        out[k, 0] = np.count_nonzero(_UPPER[part]) / letters
        out[k, 2] = np.count_nonzero(_SHOUT[part]) / letters
        out[k, 3] = np.count_nonzero(PUNCT[part] & ~SPACE[part]) / max(1, len(part))
        same = (part[2:] == part[1:-1]) & (part[1:-1] == part[:-2]) & _LETTER[part[2:]] if len(part) > 2 else part[:0]
        out[k, 6] = np.count_nonzero(same) / letters
    if len(doc):
        count = np.maximum(np.diff(g.bounds), 1)
        inner = np.minimum(g.starts + 1, g.ends - 1), np.maximum(g.ends - 2, g.starts)
        first, last = g.buf[g.starts], g.buf[g.ends - 1]
        caps = _UPPER[first] & _UPPER[g.buf[inner[0]]] & (g.ends - g.starts > 2)
        out[:, 1] = _by_text(doc[caps], n) / count
        # a letter, then digits or marks, then a letter again
        middle = g.buf[(g.starts + g.ends) // 2], g.buf[inner[0]], g.buf[inner[1]]
        ends = _LETTER[first] & _LETTER[last]
        digit, mark = (_DIGIT[middle[0]] | _DIGIT[middle[1]] | _DIGIT[middle[2]]) & ends, (_MARK[middle[0]] | _MARK[middle[1]] | _MARK[middle[2]]) & ends
        out[:, 4] = _by_text(doc[digit], n) / count
        out[:, 5] = _by_text(doc[mark], n) / count
    return out


def _feature_batches(batches: Iterator[pa.RecordBatch], shared, columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    terms = shared.value
    words = HashRows(terms.get(0, np.zeros(0, np.uint64)))
    beginnings = {k: HashRows(terms[k]) for k in PREFIXES if k in terms}
    you = HashRows(np.array([hash_bytes(w.encode()) for w in SECOND_PERSON], dtype=np.uint64))
    for batch in batches:
        form = groups(batch.column("_text"), SPACE)
        for g in groups(batch.column("_text"), PUNCT, fold=True):
            both = np.concatenate([_features(g, words, beginnings, you), _form_features(next(form))], axis=1)
            width = both.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(g.size + 1, dtype=np.int32) * width), pa.array(both.ravel()))
            part = batch.slice(g.first, g.size)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists.cast(schema.field("_features").type)], schema=schema)


def learn_terms(rows: DataFrame) -> dict[int, np.ndarray]:
    """Lexicon hashes by kind from ``(text, toxic)``: at most ``MAX_TERMS`` in all."""
    out = StructType().add("kind", "integer").add("hash", "long").add("toxic", "integer")
    counts = map_batches(rows.select("text", F.col("toxic").cast("int").alias("toxic")), _term_batches, out).groupBy("kind", "hash").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    total = rows.agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    pos, neg = total.pos or 0, total.n - (total.pos or 0)
    ratio = ((F.col("pos") + 0.5) / (pos + 1)) / ((F.col("n") - F.col("pos") + 0.5) / (neg + 1))
    best = counts.filter(F.col("pos") >= MIN_ROWS).withColumn("gain", F.col("pos") * F.log(ratio)).filter(ratio >= MIN_RATIO)
    got = best.orderBy(F.desc("gain"), "kind", "hash").limit(MAX_TERMS).select("kind", "hash").collect()
    return {k: np.array([r.hash for r in got if r.kind == k], dtype=np.int64).view(np.uint64) for k in {r.kind for r in got}}


def with_features(rows: DataFrame, terms: dict[int, np.ndarray], text: str, keep: dict[str, Column]) -> DataFrame:
    rows = rows.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text"))
    out = StructType([*(rows.schema[n] for n in keep), StructField("_features", ArrayType(DoubleType(), False))])
    shared = rows.sparkSession.sparkContext.broadcast(terms)
    return map_batches(rows, _feature_batches, out, shared, list(keep)).withColumn("_vector", array_to_vector("_features")).drop("_features")


class ToxicityModel:
    """Lexicon, trees and calibration; ``constant`` replaces them where there is nothing to learn."""

    def __init__(self, terms: dict[int, np.ndarray], trees=None, calibration=None, constant: float = 0.0):
        self.terms, self.trees, self.calibration, self.constant = terms, trees, calibration, constant

    def score(self, rows: DataFrame, text: str, keep: dict[str, Column]) -> DataFrame:
        """``score`` beside the columns in ``keep``."""
        if self.trees is None:
            return rows.select(*[c.alias(n) for n, c in keep.items()], F.lit(self.constant).alias("score"))
        raw = self.trees.transform(with_features(rows, self.terms, text, keep))
        got = self.calibration.transform(raw.select(*keep, "rawPrediction"))
        return got.select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))


def fit(rows: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """A model from ``(key, text, toxic)`` rows."""
    sample = stored(hash_share(rows, "key", max_rows), "toxic")
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < pos < n:
        return ToxicityModel({}, constant=pos / n if n else 0.0)
    part = F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(3)) == 0
    split = all(r.k == 2 for r in sample.groupBy(part).agg(F.count_distinct("toxic").alias("k")).collect())
    learn = sample.filter(~part) if split else sample
    terms = learn_terms(learn)
    keep = {"toxic": F.col("toxic").cast("double"), "held": part}
    table = stored(with_features(sample, terms, "text", keep).repartition(8, "_vector"), "features")
    of = (lambda held: table.filter(F.col("held") == held)) if split else (lambda held: table)
    trees = GBTClassifier(featuresCol="_vector", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, maxBins=64).fit(of(False))
    margin = trees.transform(of(True)).select("toxic", "rawPrediction")
    calibration = IsotonicRegression(featuresCol="rawPrediction", featureIndex=1, labelCol="toxic", predictionCol="score").fit(margin)
    return ToxicityModel(terms, trees, calibration)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` with a model of the labelled rows not held out."""
    known = labels.filter(F.col("toxic").isNotNull()).select(F.col(key), F.col("toxic"))
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(known, key).filter(crc_fold(F.col(key), 4) != 2)
    model = fit(rows.select(F.col(key).alias("key"), "text", "toxic"))
    held = F.coalesce(crc_fold(F.col(key), 4) == 2, F.lit(False))
    got = model.score(docs, text, {key: F.col(key), "held_out": held})
    return got.select(key, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
