"""Hard-negative mining over STR-packed R-trees.

Rows are dealt out by ranges of label and leading components and packed, tile by tile,
sort-tile-recursively: rows of one label are sorted and cut by the components that spread
most, so that leaves hold near rows of one label wherever a label fills a leaf. A node's
box is the least and largest value of each component; with an anchor's vector it gives
an interval that holds every inner product below it, the sum of one interval per component.
A best-first queue opens nodes by the upper end of their interval. A node is dropped if no row
of it can have a wanted label, if its interval misses all score windows, or if its
upper end lies strictly below the k-th score found so far, so ties are never lost.

Two searches use the same tiles: the nearest rows of an anchor's own label, then, within a score
window per such positive, the nearest rows of other labels. The tiles are dealt to
parts, and every part gets all anchors in blocks (a stated query set against all rows); the
lists of a part are merged in a window per anchor and positive. No anchor, list or tile
passes through the driver.

Scores are exact: sums that fit 53 bits are taken in float64, larger ones as 64-bit
integers without pruning. Only rows of as many components as the anchor meet it.

Defined results: rows with a null label or vector, or a null or non-finite component take no part;
a null id is never an anchor and comes last among ties; repeated rows are ranked one by one,
and a row with the anchor's id is none of its positives; an anchor without positives, or a
positive without rows in its window, gives no rows; empty tables give none; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from flowloom.llm.arrow import map_batches
from flowloom.llm.stored import stored

N_POSITIVES, N_NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
WINDOW = (30, 90)
SCALE = 256
#: Rows of a leaf, of a tile, nodes under a node, anchors of a block, components that rows are sorted by.
LEAF, TILE, FAN, ANCHORS, SORTED = 64, 4096, 8, 1024, 3
#: Tiles of a part on a large table.
PART_TILES = 64
EXACT = 1 << 53

_PLACES = ArrayType(StructType().add("id", "long").add("score", "long"))
_TILES = StructType().add("dim", "integer").add("ids", ArrayType(LongType())).add("labels", ArrayType(LongType())).add("width", "integer").add("values", "binary")
_BLOCKS = StructType().add("dim", "integer")
for _name, _kind in (("keys", LongType()), ("ids", LongType()), ("labels", LongType()), ("positives", _PLACES)):
    _BLOCKS = _BLOCKS.add(_name, ArrayType(_kind))
_BLOCKS = _BLOCKS.add("width", "integer").add("values", "binary")
_FOUND = StructType().add("key", "long").add("anchor_id", "long").add("place", "integer").add("positive_id", "long").add("positive_score", "long").add("id", "long").add("score", "long")


def quantized(vectors: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, label, dim, values)`` of the rows that take part."""
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), numbers.alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select("id", "label", F.size("x").alias("dim"), F.transform("x", lambda x: F.floor(x * scale)).alias("values"))


# --- packing


def str_order(values: np.ndarray, labels: np.ndarray, leaf: int = LEAF, dims: int = SORTED) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and the cuts between leaves in it.

    Labels that fill a leaf are tiled one by one; rows of the others stand together by label.
    """
    by_label = np.argsort(labels, kind="stable")
    _, first, size = np.unique(labels[by_label], return_index=True, return_counts=True)
    order, cuts, rest = [], [0], []
    for at, n in zip(first.tolist(), size.tolist()):
        rows = by_label[at : at + n]
        if n < leaf:
            rest.append(rows)
            continue
        spread = np.argsort(-np.var(values[rows].astype(float), axis=0), kind="stable")[:dims]
        order.append(_tiled(values, rows, spread.tolist(), leaf))
        cuts += [cuts[-1] + k for k in [*range(leaf, n, leaf), n]]
    if rest:
        order.append(np.concatenate(rest))
        n = len(order[-1])
        cuts += [cuts[-1] + k for k in [*range(leaf, n, leaf), n]]
    return np.concatenate(order) if order else by_label, np.array(cuts)


def _tiled(values: np.ndarray, rows: np.ndarray, dims: list[int], leaf: int) -> np.ndarray:
    """Sort-tile-recursive order: slabs of whole leaves along the first component, each tiled by the others."""
    if not dims or len(rows) <= leaf:
        return rows
    rows = rows[np.argsort(values[rows, dims[0]], kind="stable")]
    leaves = -(-len(rows) // leaf)
    slabs = int(np.ceil(leaves ** (1 / len(dims))))
    size = -(-leaves // slabs) * leaf
    return np.concatenate([_tiled(values, rows[k : k + size], dims[1:], leaf) for k in range(0, len(rows), size)])


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    for width in (2, 4):
        limit = 1 << (8 * width - 1)
        if not values.size or (values.min() >= -limit and values.max() < limit):
            return width, values.astype(f"<i{width}").tobytes()
    return 8, values.astype("<i8").tobytes()


def _wide(width: int, data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(n, dim).astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Consecutive rows of one ``dim``, up to ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        at = 0
        while at < batch.num_rows:
            n = sum(b.num_rows for b in held)
            if held and held[0].column("dim")[0].as_py() != dims[at]:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            other = np.flatnonzero(dims[at:] != dims[at])
            to = min(at + (int(other[0]) if len(other) else batch.num_rows), batch.num_rows, at + size - n)
            held.append(batch.slice(at, to - at))
            at = to
            if n + held[-1].num_rows == size:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _flat(table: pa.Table) -> tuple[int, np.ndarray]:
    dim = table.column("dim")[0].as_py()
    return dim, np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("values").chunks]).astype(np.int64).reshape(table.num_rows, dim)


def _tile_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches, TILE):
        dim, values = _flat(table)
        order = pa.array(str_order(values, table.column("label").to_numpy())[0])
        width, data = _narrow(values[order.to_numpy()])
        rows = table.take(order)
        row = {"dim": dim, "ids": rows.column("id").to_pylist(), "labels": rows.column("label").to_pylist(), "width": width, "values": data}
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def _block_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches, ANCHORS):
        dim, values = _flat(table)
        width, data = _narrow(values)
        lists = {name: table.column(column).to_pylist() for name, column in (("keys", "key"), ("ids", "id"), ("labels", "label"), ("positives", "positives"))}
        yield pa.RecordBatch.from_pylist([{"dim": dim, "width": width, "values": data} | lists], schema=schema)


# --- searching


class Tree:
    """The packed rows of a tile under levels of boxes."""

    def __init__(self, ids: np.ndarray, unknown: np.ndarray, labels: np.ndarray, values: np.ndarray):
        order, cuts = str_order(values, labels)
        self.ids, self.unknown, self.labels, self.values = ids[order], unknown[order], labels[order], values[order]
        self.float = self.values.astype(np.float64)
        self.cuts = cuts
        self.largest = int(np.abs(self.values).max(initial=0))
        first = cuts[:-1]
        level = [np.minimum.reduceat(self.values, first), np.maximum.reduceat(self.values, first), np.minimum.reduceat(self.labels, first), np.maximum.reduceat(self.labels, first)]
        self.levels = [level]  # leaves first
        while len(level[0]) > 1:
            first = np.arange(0, len(level[0]), FAN)
            level = [f.reduceat(x, first) for f, x in zip((np.minimum, np.maximum) * 2, level)]
            self.levels.append(level)

    def intervals(self, queries: np.ndarray, exact: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level the least and largest inner product each query can have in each node."""
        if not exact:
            shapes = [(len(queries), len(level[0])) for level in self.levels]
            return [(np.full(s, -np.inf), np.full(s, np.inf)) for s in shapes]
        up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
        return [(up @ lo.T.astype(float) + down @ hi.T.astype(float), up @ hi.T.astype(float) + down @ lo.T.astype(float)) for lo, hi, _, _ in self.levels]


@dataclass
class Wanted:
    """A list to fill: the ``k`` best scores from ``low`` to ``high``."""

    k: int
    low: int
    high: int

    def __post_init__(self):
        self.score = self.id = np.zeros(0, np.int64)
        self.unknown = np.zeros(0, bool)
        self.least = self.low  # what a score must reach to matter

    def open(self, lower: float, upper: float) -> bool:
        return upper >= self.least and lower <= self.high

    def offer(self, score: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        at = np.flatnonzero((score >= self.least) & (score <= self.high))
        if not len(at):
            return
        s, d, u = np.concatenate([self.score, score[at]]), np.concatenate([self.id, ids[at]]), np.concatenate([self.unknown, unknown[at]])
        best = np.lexsort((d, u, -s))[: self.k]
        self.score, self.id, self.unknown = s[best], d[best], u[best]
        if len(best) == self.k:
            self.least = max(self.low, int(s[best[-1]]))


def best_first(tree: Tree, bounds: list[tuple[np.ndarray, np.ndarray]], q: int, query: np.ndarray, exact: bool, label: int, same: bool, own: int | None, wanted: list[Wanted]) -> int:
    """Fill the lists of query ``q`` from a tree; the number of leaves opened."""
    opened = 0
    top = len(tree.levels) - 1
    queue: list[tuple[float, int, int]] = []

    def push(level: int, node: int) -> None:
        lo, hi = tree.levels[level][2][node], tree.levels[level][3][node]
        if not (lo <= label <= hi if same else not lo == hi == label):
            return
        lower, upper = bounds[level][0][q, node], bounds[level][1][q, node]
        if any(w.open(lower, upper) for w in wanted):
            heapq.heappush(queue, (-upper, level, node))

    for node in range(len(tree.levels[top][0])):
        push(top, node)
    while queue:
        upper, level, node = heapq.heappop(queue)
        if not any(w.open(bounds[level][0][q, node], -upper) for w in wanted):
            if all(-upper < w.least for w in wanted):
                break  # what follows lies lower still
            continue
        if level:
            for child in range(node * FAN, min((node + 1) * FAN, len(tree.levels[level - 1][0]))):
                push(level - 1, child)
            continue
        opened += 1
        rows = slice(tree.cuts[node], tree.cuts[node + 1])
        score = (tree.float[rows] @ query).astype(np.int64) if exact else tree.values[rows] @ query
        fits = (tree.labels[rows] == label) if same else (tree.labels[rows] != label)
        if same:
            fits &= tree.unknown[rows] | (tree.ids[rows] != own)
        at = np.flatnonzero(fits)
        for w in wanted:
            w.offer(score[at], tree.ids[rows][at], tree.unknown[rows][at])
    return opened


def _wanted(positives: list[dict] | None, same: bool, k: int, low: int, high: int) -> list[tuple[dict, Wanted]]:
    if same:
        return [({"id": None, "score": None}, Wanted(k, -(1 << 62), 1 << 62))]
    windows = [(p, Wanted(k, -(-low * p["score"] // 100), high * p["score"] // 100)) for p in positives or []]
    return [(p, w) for p, w in windows if w.low <= w.high]


def _search_batches(batches: Iterator[pa.RecordBatch], same: bool, k: int, low: int, high: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a block of anchors and a tile each; lists go on while the block stays the same."""
    now, block, lists = None, None, []

    def results() -> Iterator[pa.RecordBatch]:
        rows = []
        for a, held in enumerate(lists):
            for place, (p, w) in enumerate(held):
                for i, s, u in zip(w.id.tolist(), w.score.tolist(), w.unknown.tolist()):
                    rows.append((block["keys"][a], block["ids"][a], place, p["id"], p["score"], None if u else i, s))
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 10_000]), schema)], schema=schema)

    for batch in batches:
        for row in range(batch.num_rows):
            keys = batch.column("keys")[row].values.to_numpy()
            if now is None or len(now) != len(keys) or (now != keys).any():
                if block is not None:
                    yield from results()
                now = keys
                block = {c: batch.column(c)[row].as_py() for c in ("keys", "ids", "labels", "positives", "width", "values", "dim")}
                queries = _wide(block["width"], block["values"], block["dim"], len(keys))
                as_float, largest = queries.astype(np.float64), int(np.abs(queries).max(initial=0))
                lists = [_wanted(p, same, k, low, high) for p in block["positives"]]
            tile = {c: batch.column(c)[row] for c in ("tile_ids", "tile_labels", "tile_width", "tile_values")}
            ids = tile["tile_ids"].values
            values = _wide(tile["tile_width"].as_py(), tile["tile_values"].as_py(), block["dim"], len(ids))
            tree = Tree(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), tile["tile_labels"].values.to_numpy(), values)
            exact = largest * tree.largest * max(1, block["dim"]) < EXACT
            bounds = tree.intervals(as_float, exact)
            for a, held in enumerate(lists):
                if held:
                    best_first(tree, bounds, a, as_float[a] if exact else queries[a], exact, block["labels"][a], same, block["ids"][a], [w for _, w in held])
    if block is not None:
        yield from results()


# --- the job


def tiles(rows: DataFrame) -> DataFrame:
    """The packed tiles of all rows, stored."""
    lead = [F.coalesce(F.get("values", F.lit(k)), F.lit(0)).alias(f"_{k}") for k in range(2)]
    dealt = rows.select("id", "label", "dim", "values", *lead).repartitionByRange("dim", "label", "_0", "_1", "id").sortWithinPartitions("dim", "label", "_0", "_1")
    return stored(map_batches(dealt.select("id", "label", "dim", "values"), _tile_batches, _TILES).withColumn("tile", F.monotonically_increasing_id()), "tiles")


def _lists(packed: DataFrame, anchors: DataFrame, parts: int, same: bool, k: int, window: tuple[int, int]) -> DataFrame:
    """Merged lists of all anchors: ``rank`` 1 to ``k`` per anchor and place."""
    blocks = map_batches(anchors.select("key", "id", "label", "dim", "values", "positives").repartitionByRange("dim", "key").sortWithinPartitions("dim", "key"), _block_batches, _BLOCKS)
    sent = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(parts, "part")
    named = packed.select(F.pmod("tile", F.lit(parts)).cast("int").alias("part"), F.col("dim").alias("tile_dim"), *[F.col(c).alias(f"tile_{c}") for c in ("ids", "labels", "width", "values")])
    met = sent.join(named.repartition(parts, "part").hint("shuffle_merge"), "part").filter("dim = tile_dim").drop("tile_dim")
    found = map_batches(met, _search_batches, _FOUND, same, k, *window)
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows of ``quantized``."""
    packed = tiles(rows)
    n_tiles = packed.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n_tiles, max(4 * cores, -(-n_tiles // PART_TILES))))
    # the tile's place in its file is no number from 0 on
    packed = packed.withColumn("tile", F.xxhash64("tile"))
    anchors = stored(rows.filter(F.coalesce(is_anchor, F.lit(False))).withColumn("key", F.monotonically_increasing_id()), "anchors")
    none = F.array().cast(_PLACES).alias("positives")
    near = _lists(packed, anchors.select("*", none), parts, True, n_positives, window)
    held = near.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))), lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    held = stored(anchors.join(held, "key"), "positives")
    far = _lists(packed, held, parts, False, n_negatives, window)
    return far.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
