"""Near-duplicate classes by DartMinHash signatures and banded joining.

After Christiani, "DartMinHash: Fast Sketching for Weighted Sets" (2020): a hash
throws darts at the plane of weight and rank over every element. Darts inside the
element's weight count, each falls on one coordinate, and the dart of least rank
stays there; two sets agree on a coordinate with the probability of their weighted
Jaccard similarity. Darts are thrown only up to a rank that fills all
coordinates, so a signature costs about ``t ln t`` darts whatever the set holds.

Elements are runs of five words (words of letters and digits, A-Z lower-cased); a
shorter text is one element. With the production weight of one per distinct run
the measure is plain Jaccard. Equal word sequences are one node from the start.
Each node is compared exactly with the least node it shares a band with. Then, in
buckets that still hold several classes, all pairs of different classes of buckets of up to
``SMALL_BUCKET`` nodes are compared, and in larger ones each node with ``LEADERS`` nodes of
the largest class, which only makes classes grow. Large buckets that after that still hold
several classes are put together to families where they share nodes, and all pairs of
different classes of a family are compared (``_settled``), in blocks of bounded size that
are dealt to tasks. So a bucket ends when its pairs of different classes are compared or
ruled out, whatever other buckets bring. Rows stay linear in a family times its number of
blocks, links in its nodes; the comparisons outside its largest class are as many as its
pairs.

Defined results: null texts and texts without words are classes of their own, row
by row with equal ids together; rows with one id may hold different texts; the class id is the
least document id of the class (a null id counts last); extra columns are
ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``; empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from flowloom.llm.arrow import map_batches
from flowloom.llm.stored import stored
from flowloom.llm.wordtable import PUNCT, Group, groups, mix, window_hashes
from flowloom.operators.components import connected_components

SHINGLE = 5
SIMILARITY = (4, 5)  # 0.8 as a ratio, so the test is exact
COORDINATES = 256
ROWS = 7  # 36 bands: a pair at 0.8 is met with probability 0.9998
SMALL_BUCKET = 16
#: Leaders of a large bucket before all its pairs are compared.
LEADERS = 8
#: Links that one task takes when classes are found.
LINKS_PER_TASK = 250_000
#: Runs in a block of a family; a text counts for at least ``TEXT_COST`` of them.
BLOCK_RUNS = 500_000
TEXT_COST = 50
#: Texts of a block that are counted at once, run columns of one matrix, and meetings listed at once.
STEP, COLUMNS, MEETINGS = 256, 1024, 2_000_000
#: A matrix cell costs this small part of a listed meeting.
CELL = 200

_U = np.uint64
_POISSON = np.array([int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * (1 << 53)) for k in range(18)], dtype=np.int64)


def _fraction(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.int64)


def dart_signatures(doc: np.ndarray, element: np.ndarray, n_docs: int, t: int = COORDINATES, weight: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """``(n_docs, t)`` signatures of weighted sets; ``t`` is a power of two.

    ``doc`` and ``element`` (hashes) list the members, ``weight`` their weights (1 if
    None, and then repeated members change nothing). Sets without weight get zeros.
    """
    best = np.full(n_docs * t, np.inf)
    signature = np.zeros(n_docs * t, dtype=_U)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    limit = (t * math.log(t) + 2 * t) / np.maximum(total, 1e-300)
    todo = np.flatnonzero(total > 0)
    salt = mix(np.array([seed], dtype=_U))[0]
    while len(todo):
        chosen = np.zeros(n_docs, dtype=bool)
        chosen[todo] = True
        rows = np.flatnonzero(chosen[doc])
        cells = np.ones(len(rows), np.int64) if weight is None else np.ceil(weight[rows]).astype(np.int64)
        bands = np.ceil(limit[doc[rows]]).astype(np.int64)
        # one region per unit of weight and unit of rank
        at = np.repeat(np.arange(len(rows)), cells * bands)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(cells * bands) - cells * bands, cells * bands)
        cell, band = inner // bands[at], inner % bands[at]
        region = mix(element[rows[at]] ^ salt ^ (cell.astype(_U) * _U(0x9E3779B97F4A7C15)) ^ (band.astype(_U) * _U(0xC2B2AE3D27D4EB4F)))
        n_darts = np.searchsorted(_POISSON, _fraction(region), side="right")
        hit = np.repeat(np.arange(len(at)), n_darts)
        number = np.arange(len(hit)) - np.repeat(np.cumsum(n_darts) - n_darts, n_darts)
        dart = mix(region[hit] + (number.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
        rank = band[hit] + _fraction(mix(dart ^ _U(0xA0761D6478BD642F))) * 2.0**-53
        own = doc[rows[at[hit]]]
        keep = rank <= limit[own]
        if weight is not None:
            keep &= cell[hit] + _fraction(mix(dart ^ _U(0xE7037ED1A0B428DB))) * 2.0**-53 <= weight[rows[at[hit]]]
        dart, rank, own = dart[keep], rank[keep], own[keep]
        slot = own * t + (mix(dart ^ _U(0x8EBC6AF09C88C6E3)) & _U(t - 1)).astype(np.int64)
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        signature[slot[first]] = dart[first]
        todo = todo[np.isinf(best.reshape(n_docs, t)[todo]).any(axis=1)]
        limit[todo] *= 2
    return signature.reshape(n_docs, t)


def shingles(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of the runs of five words, or of all words of a shorter text."""
    doc, words = group.doc_of_word(), np.diff(group.bounds)
    parts = []
    for n, runs in window_hashes(group.hashes, tuple(range(1, SHINGLE + 1))).items():
        whole = doc[: len(runs)] == doc[n - 1 :] if len(runs) else np.zeros(0, bool)
        if n < SHINGLE:
            whole = whole & (words[doc[: len(runs)]] == n)
        at = np.flatnonzero(whole)
        parts.append((doc[at], runs[at]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _node(group: Group, k: int) -> bytes | None:
    words = group.hashes[group.bounds[k] : group.bounds[k + 1]]
    return hashlib.md5(words.tobytes(), usedforsecurity=False).digest() if len(words) else None


def _sketch_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n_bands = COORDINATES // ROWS
    number = np.arange(n_bands, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for batch in batches:
        for g in groups(batch.column("text"), PUNCT, fold=True):
            doc, runs = shingles(g)
            sig = dart_signatures(doc, runs, g.size)[:, : n_bands * ROWS].reshape(g.size, n_bands, ROWS)
            key = np.repeat(number[None], g.size, axis=0)
            for r in range(ROWS):
                key = mix(key * _U(0x2545F4914F6CDD1D) ^ sig[:, :, r])
            full = np.diff(g.bounds) > 0
            ends = np.concatenate([[0], np.cumsum(full * n_bands)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[full].ravel().view(np.int64)))
            nodes = pa.array([_node(g, k) for k in range(g.size)], pa.binary())
            part = batch.slice(g.first, g.size)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), nodes, bands.cast(schema.field("bands").type)], schema=schema)


def _shingle_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g in groups(batch.column("text"), PUNCT, fold=True):
            doc, runs = shingles(g)
            order = np.lexsort((runs, doc))
            doc, runs = doc[order], runs[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (runs[1:] != runs[:-1])
            doc, runs = doc[new], runs[new]
            ends = np.searchsorted(doc, np.arange(g.size + 1)).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(runs.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_node(g, k) for k in range(g.size)], pa.binary()), sets.cast(schema.field("runs").type)], schema=schema)


def _longs(name: str) -> StructField:
    return StructField(name, ArrayType(LongType(), False), True)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text_hash, node, bands)`` per row; ``node`` is null for a text without words."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    out = StructType([rows.schema["id"], StructField("text_hash", LongType()), StructField("node", BinaryType()), _longs("bands")])
    return map_batches(rows, _sketch_batches, out)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are as similar as asked for."""
    over, under = SIMILARITY
    left = sets.select(F.col("node").alias("a"), F.col("runs").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("runs").alias("_b"))
    met = pairs.join(right, "b").join(left, "a")
    # sizes alone rule out most false candidates
    met = met.filter((F.size("_a") * under >= F.size("_b") * over) & (F.size("_b") * under >= F.size("_a") * over))
    common = F.size(F.array_intersect("_a", "_b"))
    return met.filter(common * under >= (F.size("_a") + F.size("_b") - common) * over).select("a", "b")


def _open_pairs(buckets: DataFrame, classes: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs still to compare, from buckets that hold several classes; linear in their rows."""
    member = buckets.join(classes, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    # buckets share leaders, so a node meets few of them
    rank = F.xxhash64("node")
    ranked = F.struct(rank.alias("rank"), "node")
    chosen = F.array_compact(F.array(*[F.min(F.when(F.pmod(rank, F.lit(LEADERS)) == i, ranked))["node"] for i in range(LEADERS)]))
    heads = member.groupBy("bucket", "component").agg(chosen.alias("heads"), F.count("*").alias("n"))
    mixed = heads.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max(F.struct("n", "component", "heads")).alias("lead")).filter("k > 1")
    small = member.join(mixed.filter(F.col("n") <= SMALL_BUCKET).select("bucket"), "bucket")
    listed = small.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "component"))).alias("m"))  # SMALL_BUCKET at most
    each = listed.select("m", F.posexplode("m").alias("i", "x"))
    within = each.select(F.explode(F.filter(F.slice("m", F.col("i") + 2, F.lit(SMALL_BUCKET)), lambda y: y["component"] != F.col("x.component"))["node"]).alias("a"), F.col("x.node").alias("b"))
    large = member.join(mixed.filter(F.col("n") > SMALL_BUCKET).select("bucket", "lead"), "bucket").filter(F.col("component") != F.col("lead.component"))
    across = large.select("node", F.explode("lead.heads").alias("head")).select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))
    return within.union(across).distinct().join(done, ["a", "b"], "left_anti")


def _common(row: np.ndarray, col: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of common columns of ``left`` rows, some at a time, with all ``right`` rows.

    Columns of many rows are counted by matrix products, others by listing where they meet.
    """
    n_cols = int(col.max(initial=-1)) + 1
    place = np.full(int(row.max(initial=-1)) + 1, -1)
    place[right] = np.arange(len(right))
    own = place[row] >= 0
    by_col = np.argsort(col[own], kind="stable")
    r_row, r_col = place[row[own]][by_col], col[own][by_col]
    n_right = np.bincount(r_col, minlength=n_cols)
    start = np.concatenate([[0], np.cumsum(n_right)])
    place[:] = -1
    place[left] = np.arange(len(left))
    own = place[row] >= 0
    by_row = np.argsort(place[row[own]], kind="stable")
    l_row, l_col = place[row[own]][by_row], col[own][by_row]
    dense = np.bincount(l_col, minlength=n_cols) * n_right * CELL >= len(left) * len(right)
    number = np.cumsum(dense) - 1
    for first in range(0, len(left), STEP):
        m = min(STEP, len(left) - first)
        a, b = np.searchsorted(l_row, [first, first + m])
        x, c = l_row[a:b] - first, l_col[a:b]
        common = np.zeros((m, len(right)))
        for low in range(0, int(dense.sum()), COLUMNS):
            now = dense & (number >= low) & (number < low + COLUMNS)
            here, (f, t) = now[c], np.searchsorted(r_col, np.flatnonzero(now)[[0, -1]] + [0, 1])
            there = f + np.flatnonzero(now[r_col[f:t]])
            one, other = np.zeros((m, COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
            one[x[here], number[c[here]] - low] = 1
            other[r_row[there], number[r_col[there]] - low] = 1
            common += one @ other.T
        x, c = x[~dense[c]], c[~dense[c]]
        ends = np.cumsum(n_right[c])
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, MEETINGS), side="right")
        for f, t in zip(cuts, [*cuts[1:], len(c)]):
            n = n_right[c[f:t]]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            meets = np.repeat(x[f:t], n) * len(right) + r_row[np.repeat(start[c[f:t]], n) + inner]
            common += np.bincount(meets, minlength=common.size).reshape(common.shape)
        yield np.arange(first, first + m), common.astype(np.int64)


def block_links(runs: np.ndarray, bounds: np.ndarray, is_left: np.ndarray, is_right: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs of a left and a right set that join all components which such pairs join.

    Set k holds the distinct ``runs[bounds[k] : bounds[k + 1]]``. All pairs count but
    those in which runs that only one side holds rule a set out.
    """
    over, under = SIMILARITY
    size, both = np.diff(bounds), bool((is_left & is_right).any())
    row = np.repeat(np.arange(len(size)), size)
    col = np.unique(runs, return_inverse=True)[1]
    while True:
        n_left, n_right = (np.bincount(col, weights=side[row], minlength=int(col.max(initial=0)) + 1) for side in (is_left, is_right))
        met = (n_left >= 2 if both else (n_left > 0) & (n_right > 0))[col]
        able = np.bincount(row[met], minlength=len(size)) * under >= size * over
        keep = met & able[row]
        if keep.all():
            break
        row, col = row[keep], np.unique(col[keep], return_inverse=True)[1]
    have = np.bincount(row, minlength=len(size)) > 0
    left, right = np.flatnonzero(have & is_left), np.flatnonzero(have & is_right)
    root = {}

    def top(k: int) -> int:
        while k in root:
            k = root[k]
        return k

    links, now = [], component.copy()
    for part, common in _common(row, col, left, right):
        i = left[part]
        open_ = (common * (under + over) >= (size[i][:, None] + size[right][None]) * over) & (now[i][:, None] != now[right][None])
        for p, q in zip(*(k.tolist() for k in np.nonzero(open_))):
            a, b = top(int(component[i[p]])), top(int(component[right[q]]))
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(i[p]), int(right[q])))
        now = np.array([top(int(k)) for k in component])
    return links


def _block_table(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    at = {name: table.column(name).combine_chunks() for name in table.column_names}
    block, sets = at["block"].to_numpy(), at["runs"]
    bounds = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
    component = at["component"].dictionary_encode().indices.to_numpy()
    links = block_links(sets.flatten().to_numpy(), bounds, block == at["low"][0].as_py(), block == at["high"][0].as_py(), component)
    a, b = (at["node"].take(pa.array([x[k] for x in links], pa.int64())) for k in (0, 1))
    return pa.table({"a": a, "b": b})


def _settled(buckets: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links that join what can be joined in large buckets of several classes; None without such buckets."""
    member = buckets.join(classes, "node", "left").select("bucket", "head", "node", F.coalesce("component", "node").alias("component"))
    mixed = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("c"), F.max("component").alias("d"))
    rows = stored(member.join(mixed.filter((F.col("n") > SMALL_BUCKET) & (F.col("c") != F.col("d"))).select("bucket"), "bucket").select("head", "node", "component").distinct(), "mixed")
    n = rows.count()
    if n == 0:
        return None
    family = connected_components(rows.select("head", "node"), "head", "node", 1 + n // LINKS_PER_TASK).withColumnRenamed("component", "family")
    cost = sets.select("node", F.greatest(F.size("runs"), F.lit(TEXT_COST)).cast("long").alias("cost"))
    nodes = stored(rows.select("node", "component").distinct().join(family, "node").join(cost, "node"), "families")
    # the largest class of a family is not compared within itself
    by_class = nodes.groupBy("family", "component").agg(F.sum("cost").alias("cost"))
    by_family = by_class.groupBy("family").agg(F.sum("cost").alias("cost"), F.max(F.struct("cost", "component")).alias("lead"))
    blocks = lambda cost: F.ceil(cost / BLOCK_RUNS).cast("int")
    dealt = by_family.select("family", F.col("lead.component").alias("lead"), blocks(F.col("cost") - F.col("lead.cost")).alias("rest"), blocks(F.col("lead.cost")).alias("leads"))
    turn, led = F.xxhash64("node"), F.col("component") == F.col("lead")
    placed = nodes.join(dealt, "family").select("family", "node", "component", F.when(led, F.col("rest") + F.pmod(turn, "leads")).otherwise(F.pmod(turn, "rest")).cast("int").alias("block"), (F.when(led, F.col("rest")).otherwise(F.col("rest") + F.col("leads")) - 1).alias("last"))
    full = placed.join(sets, "node").select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    pairs = full.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component", "runs")
    out = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])
    return stored(pairs.groupBy("family", "low", "high").applyInArrow(_block_table, out), "links")


def _classes(links: DataFrame) -> DataFrame:
    return stored(connected_components(links, "a", "b", 1 + links.count() // LINKS_PER_TASK), "classes")


def near_classes(sketch: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(node, component)`` of the nodes with a verified link."""
    nodes = sketch.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("r"), F.first("bands").alias("bands"))
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
    buckets = stored(rows.join(shared.select("bucket", "head"), "bucket"), "buckets")
    members = buckets.select("node").distinct()
    chosen = sketch.select("id", "text_hash", "node").join(members, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("r")).select("r.*")
    texts = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text")).join(chosen, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash")), "left_semi")
    sets = map_batches(texts.select("text"), _shingle_batches, StructType([StructField("node", BinaryType()), _longs("runs")]))
    sets = stored(sets.dropDuplicates(["node"]), "sets")

    first = buckets.groupBy("node").agg(F.min("head").alias("b")).filter("node <> b").select(F.col("node").alias("a"), "b")
    tried = stored(first, "pairs")
    links = stored(_similar(tried, sets), "links")
    classes = _classes(links)
    found = stored(_similar(stored(_open_pairs(buckets.select("bucket", "node"), classes, tried), "pairs"), sets), "links")
    if not found.isEmpty():
        links = links.union(found)
        classes = _classes(links)
    settled = _settled(buckets, classes, sets)
    return classes if settled is None or settled.isEmpty() else _classes(links.union(settled))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, ``class_id``, ``n_texts`` and ``n_docs`` of the class, ``kept``.

    ``kept`` is true for the row of the least id of each class.
    """
    got = _classified(docs, key, text)
    return got.select(F.col("id").alias(key), "class_id", "n_texts", "n_docs", "kept")


def _classified(docs: DataFrame, key: str, text: str) -> DataFrame:
    sketch = stored(sketches(docs, key, text), "sketch")
    classes = near_classes(sketch, docs, key, text)
    rows = sketch.drop("bands").join(classes, "node", "left")
    # a text without words stands for itself
    rows = rows.withColumn("class", F.coalesce(F.hex("component"), F.hex("node"), F.concat(F.lit("row "), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    one = rows.groupBy("class").agg(F.min(rank).alias("r"), F.count("*").alias("n_docs"), F.count_distinct(F.coalesce("node", F.lit(b""))).alias("n_texts"))
    met = rows.join(one, "class")
    kept = F.col("id").eqNullSafe(F.col("r.id")) & (F.col("text_hash") == F.col("r.text_hash"))
    return met.select("id", "text_hash", F.col("r.id").alias("class_id"), "n_texts", "n_docs", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with its columns as they were."""
    kept = _classified(docs, key, text).filter("kept").groupBy("id", "text_hash").agg(F.count("*").alias("_n"))
    kept = stored(kept, "kept")
    named = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"))
    met = named.join(kept, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash")))
    if not kept.filter("_n > 1").isEmpty():  # rows that agree in id and text
        again = met.filter("_n > 1").dropDuplicates(["_id", "_hash"])
        met = met.filter("_n = 1").unionAll(again)
    return met.select("_row.*")
