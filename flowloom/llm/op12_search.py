"""Ranked lexical search by dense blocked matrix products.

A block of items becomes a compact vocabulary: its distinct terms, each with a
weight from the document counts. Documents are walked in tiles; a tile's impacts of the
vocabulary's terms that it holds are a dense float64 matrix, the items' term weights
another, and BLAS multiplies them in vocabulary tiles. Weights and impacts are integers, and
a vocabulary tile is cut so that its largest possible sum stays below 2^53, so every
product is exact; the sums of tiles are added as 64-bit integers. Every task keeps the k
best documents of each item by score and then document id, whatever ties there are, and
these lists are merged in two steps.

The vocabulary and weights of a block are the only things sent to tasks. A block holds
items of about ``BLOCK_BYTES`` (one item at least); more items take more passes over the
documents. Terms are known by 64-bit hashes (see ``wordtable``).

Defined results: null and empty texts have no terms and count neither as documents nor as
items; repeated documents are ranked row by row; equal scores go by ascending document id,
null ids last; repeated items and items with one id are ranked one by one; empty tables
give no rows; very long texts are walked in slices; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from flowloom.llm.arrow import map_batches
from flowloom.llm.wordtable import PUNCT, Group, HashRows, groups

TOP = 20
BLOCK_BYTES = 1 << 20
#: Documents and terms of a tile.
DOCUMENTS, TERMS = 1024, 2048
#: Impacts stay below this, partial sums below the other.
MOST_IMPACT, EXACT = 10**6, 1 << 53
#: Task lists that are merged in the first step, and tasks that add up counts.
MERGE, ADDERS = 64, 8


@dataclass
class Block:
    """Items of one pass: their ids, and how often each holds which term."""

    ids: list[int | None]
    terms: np.ndarray  # ascending hashes
    item: np.ndarray  # one entry per item and term
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Block:
        ids, item, hashes = [k for k, _ in rows], [], []
        for g in groups(pa.array([t for _, t in rows], pa.string()), PUNCT, fold=True):
            item.append(g.first + g.doc_of_word())
            hashes.append(g.hashes)
        terms, term = np.unique(np.concatenate(hashes), return_inverse=True)
        pairs, times = np.unique(np.concatenate(item) * max(1, len(terms)) + term, return_counts=True)
        return cls(ids, terms, pairs // max(1, len(terms)), pairs % max(1, len(terms)), times)


@dataclass
class Weights:
    """What the whole table says about the terms of a block."""

    n_docs: int
    n_terms: int
    weight: np.ndarray

    @classmethod
    def of(cls, n_docs: int, n_terms: int, df: np.ndarray) -> Weights:
        return cls(n_docs, n_terms, np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))

    def impacts(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 75 + (25 * size * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def vocabulary_tiles(block: Block, weight: np.ndarray, terms: int = TERMS, exact: int = EXACT) -> list[tuple[int, int, np.ndarray]]:
    """``(from, to, weights)`` of runs of terms; the weights are a row per item and a column per term.

    No item's sum over a tile can reach ``exact``; one term that could alone has an
    integer matrix, which is multiplied without BLAS.
    """
    order = np.argsort(block.term, kind="stable")
    item, term = block.item[order], block.term[order]
    value = block.times[order] * weight[term]
    out, todo = [], [(a, min(a + terms, len(weight))) for a in range(0, len(weight), terms)][::-1]
    while todo:
        a, b = todo.pop()
        f, t = np.searchsorted(term, [a, b])
        # an item's sum in Python integers could not overflow; here its float is only compared
        largest = np.bincount(item[f:t], weights=value[f:t].astype(float) * MOST_IMPACT, minlength=1).max()
        if largest >= exact and b - a > 1:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
            continue
        tile = np.zeros((len(block.ids), b - a), np.int64 if largest >= exact else np.float64)
        tile[item[f:t], term[f:t] - a] = value[f:t]
        out.append((a, b, tile))
    return out


class Best:
    """The k best documents of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)  # what a document has to score to matter
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * n_items

    def offer(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        """A row of scores per item, a column per document; ``unknown`` marks null ids."""
        for i in np.flatnonzero((scores >= self.least[:, None]).any(axis=1)).tolist():
            at = np.flatnonzero(scores[i] >= self.least[i])
            s, d, u = (np.concatenate(x) for x in zip(self.held[i], (scores[i, at], ids[at], unknown[at])))
            first = np.lexsort((d, u, -s))[: self.k]
            self.held[i] = s[first], d[first], u[first]
            if len(first) == self.k:
                self.least[i] = s[first[-1]]


def _found(g: Group, terms: HashRows, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, term, times)`` of the vocabulary's terms in the texts of a group."""
    row = terms.find(g.hashes)
    at = np.flatnonzero(row >= 0)
    pairs, tf = np.unique(g.doc_of_word()[at] * n + row[at], return_counts=True)
    return pairs // n, pairs % n, tf


def _count_batches(batches: Iterator[pa.RecordBatch], block: Block, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    terms, n = HashRows(block.terms), len(block.terms)
    counts = np.zeros(n + 2, np.int64)
    for batch in batches:
        for g in groups(batch.column("text"), PUNCT, fold=True):
            counts[:n] += np.bincount(_found(g, terms, n)[1], minlength=n)
            counts[n:] += np.count_nonzero(np.diff(g.bounds)), len(g.hashes)
    yield _one_array(counts, schema)


def _add_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for k in range(batch.num_rows):
            counts = batch.column("counts")[k].values.to_numpy()
            total = counts.copy() if total is None else total + counts
    if total is not None:
        yield _one_array(total, schema)


def _one_array(counts: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    ends = pa.array(np.array([0, len(counts)], np.int32))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(counts)).cast(schema.field("counts").type)], schema=schema)


def _score_batches(batches: Iterator[pa.RecordBatch], block: Block, weights: Weights, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    terms, n = HashRows(block.terms), len(block.terms)
    tiles = vocabulary_tiles(block, weights.weight)
    best = Best(len(block.ids), k)
    for batch in batches:
        key = batch.column("id")
        ids, unknown = key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False)
        for g in groups(batch.column("text"), PUNCT, fold=True):
            size = np.diff(g.bounds)
            doc, term, tf = _found(g, terms, n)
            impact = weights.impacts(tf, size[doc])
            for first in range(0, g.size, DOCUMENTS):
                to = min(first + DOCUMENTS, g.size)
                a, b = np.searchsorted(doc, [first, to])
                if a == b:
                    continue
                scores = _tile_scores(tiles, doc[a:b] - first, term[a:b], impact[a:b], to - first, len(block.ids))
                best.offer(scores, ids[g.first + first : g.first + to], unknown[g.first + first : g.first + to])
    part = TaskContext.get().partitionId()
    for i, (s, d, u) in enumerate(best.held):
        if len(s):
            columns = [pa.array(np.full(len(s), i)), pa.array([block.ids[i]] * len(s), pa.int64()), pa.array(np.full(len(s), part)), pa.array(d, mask=u), pa.array(s)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _tile_scores(tiles: list[tuple[int, int, np.ndarray]], doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_items: int) -> np.ndarray:
    """Scores of some documents, which are numbered from 0, for all items."""
    scores = np.zeros((n_items, n_docs), np.int64)
    order = np.argsort(term, kind="stable")
    doc, term, impact = doc[order], term[order], impact[order]
    for a, b, weight in tiles:
        f, t = np.searchsorted(term, [a, b])
        if f == t:
            continue
        held, column = np.unique(term[f:t], return_inverse=True)
        dense = np.zeros((len(held), n_docs), weight.dtype)
        dense[column, doc[f:t]] = impact[f:t]
        scores += (weight[:, held - a] @ dense).astype(np.int64)
    return scores


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _one_block(docs: DataFrame, rows: list[tuple[int | None, str | None]], k: int) -> DataFrame | None:
    block = Block.of(rows)
    if not len(block.terms):
        return None
    counts = StructType().add("counts", ArrayType(LongType(), False))
    counted = map_batches(docs, _count_batches, counts, block)
    added = map_batches(counted.repartition(ADDERS), _add_batches, counts).collect()  # ADDERS arrays of the block's terms
    total = np.sum([np.array(r.counts, np.int64) for r in added], axis=0) if added else np.zeros(len(block.terms) + 2, np.int64)
    if not total[-1]:
        return None
    weights = Weights.of(int(total[-2]), int(total[-1]), total[:-2])
    out = StructType().add("item", LongType()).add("item_id", LongType()).add("part", LongType()).add("doc", LongType()).add("score", LongType())
    lists = map_batches(docs, _score_batches, out, block, weights, k)
    merged = _ranked(lists.withColumn("part", F.floor(F.col("part") / MERGE)), ["item", "part"], k)
    return _ranked(merged.drop("rank"), ["item"], k).select("item_id", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item, rank, key, score`` of the ``k`` best documents of each item, best first."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    number = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    found = []
    for b in range(n_blocks):
        block = [tuple(r) for r in rows.filter(number == b).collect()]  # about block_bytes
        if block and (got := _one_block(docs, block, k)) is not None:
            found.append(got)
    if not found:
        empty = StructType().add("item_id", LongType()).add("rank", "integer").add("doc", LongType()).add("score", LongType())
        found = [docs.sparkSession.createDataFrame([], empty)]
    return reduce(DataFrame.unionAll, found).select(F.col("item_id").alias(item), "rank", F.col("doc").alias(key), "score")
