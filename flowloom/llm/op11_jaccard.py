"""N-gram Jaccard join by T-occurrence search (DivideSkip).

After Li, Lu and Lu, "Efficient Merging and Filtering Algorithms for Approximate String
Searches" (2008): sets that share enough elements with a query occur in at least T
of the inverted lists of its elements. The long lists are set aside, the short ones
merged, and what occurs there often enough is looked up in the long ones by binary search.

A set is the distinct runs of four words of a text (all words of a shorter one), by
64-bit hashes; equal sets are one node from the start. Say a set of ``s`` runs asks
for sets at least as large. At most ``missing(s)`` of its runs are not in a linked set, so
of the first ``missing(s) + probes(s)`` runs in hash order at least ``probes(s)`` are among
the first ``spare(t) + probes(t)`` runs of a linked set of ``t`` runs. These first
runs make the inverted lists, which are dealt out by run. With T = ``probes(s)`` the lists
of all but the ``missing(s) + 1`` rarest runs are set aside; only the short ones are merged, and
every candidate is looked up in the rest, then in the whole set.

Short lists of up to ``SMALL_LIST`` nodes give all their pairs. In longer ones (families of near
copies, texts of common passages only) a node first meets the largest of its list.
Long lists that then still hold several classes are put together to families where
they share nodes; askers and members of a family are dealt in blocks of bounded size,
and each pair of blocks is searched by the same method with the inverted lists of its
whole sets. Members of a family's largest class are not compared with each other. So no
link between different classes is left out, and no step lists all pairs of a group.

Defined results: null texts and texts without words have no runs and are components of
their own, row by row with equal ids together; rows with one id may hold different texts; the
component id is the least document id of the component (null ids count last); very
long texts are walked in slices; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from flowloom.llm.arrow import map_batches
from flowloom.llm.stored import stored
from flowloom.llm.wordtable import SPACE, Group, groups, window_hashes
from flowloom.operators.components import connected_components

SHINGLE = 4
#: Least similarity, in hundredths.
SIMILARITY = 85
SMALL_LIST = 16
#: Sets below this have no partner but their equals.
LEAST_RUNS = next(s for s in range(1, 1000) if 100 * s >= SIMILARITY * (s + 1))
#: Links that one task takes when components are found.
LINKS_PER_TASK = 250_000
#: Runs in a block of a family; a set counts for at least ``SET_COST`` of them.
BLOCK_RUNS, SET_COST = 400_000, 50
#: The weight of a binary search in the number of lists set aside.
MU = 0.1


def missing(s):
    """How many of ``s`` runs a linked set of as many runs or more may lack; for columns and arrays too."""
    return _div(s * (100 - SIMILARITY), 100 + SIMILARITY)


def spare(s):
    """How many of ``s`` runs a linked set of as many runs or fewer may lack."""
    return _div(s * (100 - SIMILARITY), 100)


def probes(s):
    """How many first runs two linked sets have in common at least; grows with the set."""
    return _div(s, 14) + 4


def _div(a, b: int):
    return F.floor(a / F.lit(b)).cast("int") if isinstance(a, Column) else a // b


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that sends neither side through the driver: what a broadcast holds there grows with the texts."""
    return left.join(right.hint("merge"), on, how)


# --- sets of texts


def sets_of(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """``(runs, bounds)``: text k has the sorted distinct ``runs[bounds[k] : bounds[k + 1]]``."""
    doc, words = group.doc_of_word(), np.diff(group.bounds)
    owners, hashes = [], []
    for n, runs in window_hashes(group.hashes, tuple(range(1, SHINGLE + 1))).items():
        whole = doc[: len(runs)] == doc[n - 1 :] if len(runs) else np.zeros(0, bool)
        if n < SHINGLE:
            whole = whole & (words[doc[: len(runs)]] == n)
        at = np.flatnonzero(whole)
        owners.append(doc[at])
        hashes.append(runs[at])
    doc, runs = np.concatenate(owners), np.concatenate(hashes).view(np.int64)
    order = np.lexsort((runs, doc))
    doc, runs = doc[order], runs[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (runs[1:] != runs[:-1])
    return runs[new], np.searchsorted(doc[new], np.arange(group.size + 1))


def _node(runs: np.ndarray) -> bytes | None:
    return hashlib.md5(runs.tobytes(), usedforsecurity=False).digest() if len(runs) else None


def _lists_of(runs: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(runs)).cast(kind)


def _sketch_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g in groups(batch.column("text"), SPACE, fold=True):
            runs, bounds = sets_of(g)
            size = np.diff(bounds)
            held = np.where(size >= LEAST_RUNS, np.minimum(size, spare(size) + probes(size)), 0)
            ends = np.concatenate([[0], np.cumsum(held)])
            first = runs[np.repeat(bounds[:-1] - ends[:-1], held) + np.arange(ends[-1])]
            nodes = pa.array([_node(runs[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary())
            part = batch.slice(g.first, g.size)
            columns = [part.column("id"), part.column("text_hash"), nodes, pa.array(size.astype(np.int32)), _lists_of(first, ends, schema.field("first").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _set_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g in groups(batch.column("text"), SPACE, fold=True):
            runs, bounds = sets_of(g)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(g.first, g.size), _lists_of(runs, bounds, schema.field("runs").type)], schema=schema)


def _longs(name: str) -> StructField:
    return StructField(name, ArrayType(LongType(), False), True)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, text_hash, node, n, first)`` per row: the set's name and size, and its first runs."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    out = StructType([rows.schema["id"], StructField("text_hash", LongType()), StructField("node", BinaryType())]).add("n", "integer").add(_longs("first"))
    return map_batches(rows, _sketch_batches, out)


# --- looking up


def count_common(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Common elements of row pairs of sorted sets, the sets of each side one after the other, by binary search."""
    row = np.repeat(np.arange(len(a_size)), a_size)
    stop = np.cumsum(b_size)[row]
    low, high = stop - b_size[row], stop
    while (open_ := low < high).any():
        mid = (low + high) // 2
        less = open_ & (b[np.minimum(mid, len(b) - 1)] < a)
        low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
    hit = low < stop
    hit[hit] = b[low[hit]] == a[hit]
    return np.bincount(row[hit], minlength=len(a_size))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * common >= SIMILARITY * (a + b - common)


def _probe_batches(batches: Iterator[pa.RecordBatch], whole: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs that pass: on first runs the T of the asking side, on whole sets the similarity."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            (a, a_size), (b, b_size) = _flat(part.column("a_runs")), _flat(part.column("b_runs"))
            common = count_common(a, a_size, b, b_size)
            passed = linked(common, a_size, b_size) if whole else common >= part.column("least").to_numpy()
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], schema=schema).filter(pa.array(passed))


def _probed(pairs: DataFrame, sets: DataFrame, whole: bool) -> DataFrame:
    """The pairs ``(a, b)`` that pass; ``a`` is the asking side. ``sets`` has ``node, runs`` and, for first runs, ``n``."""
    scope = F.col("runs") if whole else F.slice("runs", F.lit(1), F.least(F.size("runs"), missing(F.col("n")) + probes(F.col("n"))))
    left = sets.select(F.col("node").alias("a"), scope.alias("a_runs"), *([] if whole else [probes(F.col("n")).alias("least")]))
    met = _joined(_joined(pairs, left, "a"), sets.select(F.col("node").alias("b"), F.col("runs").alias("b_runs")), "b")
    return map_batches(met, _probe_batches, StructType([met.schema["a"], met.schema["b"]]), whole)


# --- inverted lists


def fits(asking: Column, other: Column) -> Column:
    """Sizes of a set that asks and of one that may be linked with it."""
    return (asking <= other) & (other * SIMILARITY <= asking * 100)


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """``(run, node, n, place, df)`` of the first runs that several nodes have."""
    rows = nodes.select("node", "n", F.posexplode("first").alias("place", "run"))
    often = rows.groupBy("run").agg(F.count("*").alias("df")).filter("df > 1")
    return _joined(rows, often, "run")


def long_lists(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """``(run, node, n)`` of the long lists that are asked for, without sets too small or too large for those that ask."""
    sizes = asked.filter(F.col("df") > SMALL_LIST).groupBy("run").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    met = _joined(lists.filter(F.col("df") > SMALL_LIST).select("run", "node", "n"), sizes, "run")
    return met.filter((F.col("n") >= F.col("low")) & (F.col("n") * SIMILARITY <= F.col("high") * 100)).select("run", "node", "n")


def asked_runs(lists: DataFrame) -> DataFrame:
    """``(run, node, n, df)``: the short lists of each node, those of its ``missing + 1`` rarest runs.

    Runs that only one node has are the rarest of all, and their lists have nothing to merge.
    """
    n = F.col("n")
    scope = F.least(n, missing(n) + probes(n))
    held = lists.filter(F.col("place") < scope).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "run"))).alias("held"))  # no more than a text has
    need = missing(n) + 1 - (scope - F.size("held"))
    return held.select("node", "n", F.explode(F.slice("held", F.lit(1), F.greatest(need, F.lit(0)))).alias("x")).select("x.run", "node", "n", "x.df")


def candidate_pairs(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct ``(a, b)``: all pairs of small lists, and each asking node with the largest set of its long lists."""
    a = asked.select("run", F.col("node").alias("a"), F.col("n").alias("a_n"))
    small = lists.filter(F.col("df") <= SMALL_LIST).select("run", F.col("node").alias("b"), F.col("n").alias("b_n"))
    within = _joined(a, small, "run").filter(fits(F.col("a_n"), F.col("b_n")) & (F.col("a") != F.col("b")) & ((F.col("a_n") < F.col("b_n")) | (F.col("a") < F.col("b"))))
    heads = lists.filter(F.col("df") > SMALL_LIST).groupBy("run").agg(F.max(F.struct("n", "node")).alias("head"))
    met = _joined(a, heads, "run").select("a", "a_n", F.col("head.node").alias("b"), F.col("head.n").alias("b_n"))
    first = met.filter(fits(F.col("a_n"), F.col("b_n")) & (F.col("a") != F.col("b"))).groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y"))
    return within.select("a", "b").unionAll(first.select("a", F.explode(F.array("x", "y")).alias("b"))).distinct()


# --- families


class Inverted:
    """Inverted lists of some sets: the members that hold a run, in ascending order."""

    def __init__(self, runs: np.ndarray, sizes: np.ndarray):
        order = np.argsort(runs, kind="stable")
        self.members = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.runs, first = np.unique(runs[order], return_index=True)
        self.ends = np.append(first, len(runs))

    def of(self, runs: np.ndarray) -> list[np.ndarray]:
        """The lists of those of these runs that any member holds."""
        at = np.searchsorted(self.runs, runs)
        here = at < len(self.runs)
        here[here] = self.runs[at[here]] == runs[here]
        return [self.members[self.ends[k] : self.ends[k + 1]] for k in at[here].tolist()]


def t_occurrence(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of ``least`` lists or more, and in how many they are.

    The longest lists are set aside; the sorted short ones are merged (numpy's sort of
    presorted runs), and the members left are looked up in the long ones, shortest first.
    """
    none = np.zeros(0, np.int64)
    if len(lists) < least:
        return none, none
    lists = sorted(lists, key=len)
    aside = min(least - 1, int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    merged = np.sort(np.concatenate(short), kind="stable")
    first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
    count = np.diff(np.append(first, len(merged)))
    member = merged[first]
    for k, found in enumerate(long):
        left = count + (len(long) - k) >= least
        member, count = member[left], count[left]
        if not len(member):
            break
        at = np.minimum(np.searchsorted(found, member), len(found) - 1)
        count = count + (found[at] == member)
    left = count >= least
    return member[left], count[left]


def block_links(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Links of left sets with right sets of their size or larger that join all classes which such links join.

    A side is ``(runs, sizes, class numbers)``, its sets sorted and one after the other.
    """
    (a_runs, a_size, a_class), (b_runs, b_size, b_class) = left, right
    index = Inverted(b_runs, b_size)
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while k in root:
            k = root[k]
        return k

    links, ends, now = [], np.cumsum(a_size), b_class.copy()
    for q in range(len(a_size)):
        own, n = top(int(a_class[q])), int(a_size[q])
        if (now == own).all():
            continue
        member, common = t_occurrence(index.of(a_runs[ends[q] - n : ends[q]]), n - missing(n))
        hit = (b_size[member] >= n) & linked(common, n, b_size[member]) & (now[member] != own)
        for m in member[hit].tolist():
            a, b = top(int(a_class[q])), top(int(b_class[m]))
            if a != b:
                root[max(a, b)] = min(a, b)
                now[now == max(a, b)] = min(a, b)
                links.append((q, m))
    return links


def _side(table: pa.Table, left: bool) -> tuple[pa.Table, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    side = table.filter(pa.compute.equal(table.column("asks"), left)).combine_chunks()
    runs, sizes = _flat(side.column("runs").combine_chunks()) if side.num_rows else (np.zeros(0, np.int64),) * 2
    return side, (runs, sizes, side.column("component").to_numpy())


def _block_table(table: pa.Table) -> pa.Table:
    (left, a), (right, b) = _side(table, True), _side(table, False)
    links = block_links(a, b) if left.num_rows and right.num_rows else []
    pick = lambda side, k: side.column("node").take(pa.array([x[k] for x in links], pa.int64()))
    return pa.table({"a": pick(left, 0), "b": pick(right, 1)})


def family_links(long: DataFrame, asked: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links that join what can be joined in long lists of several classes; None without such lists."""
    member = _joined(long, classes, "node", "left").select("run", "node", F.coalesce("component", "node").alias("component"))
    mixed = member.groupBy("run").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.min("node").alias("head")).filter("c <> d")
    asking = asked.select("run", "node", F.lit(True).alias("asks"))
    rows = stored(_joined(_joined(member, mixed.select("run", "head"), "run"), asking, ["run", "node"], "left").select("head", "node", "component", F.coalesce("asks", F.lit(False)).alias("asks")).distinct(), "mixed")
    n = rows.count()
    if n == 0:
        return None
    family = connected_components(rows.select("head", "node"), "head", "node", 1 + n // LINKS_PER_TASK).withColumnRenamed("component", "family")
    cost = sets.select("node", F.greatest(F.size("runs"), F.lit(SET_COST)).cast("long").alias("cost"))
    nodes = stored(_joined(_joined(rows.groupBy("node", "component").agg(F.max("asks").alias("asks")), family, "node"), cost, "node"), "families")
    by_class = nodes.groupBy("family", "component").agg(F.sum("cost").alias("cost"), F.sum(F.when(F.col("asks"), F.col("cost")).otherwise(0)).alias("asking"))
    total = by_class.groupBy("family").agg(F.sum("cost").alias("cost"), F.sum("asking").alias("asking"), F.max(F.struct("cost", "asking", "component")).alias("lead"))
    blocks = lambda c: F.ceil(c / BLOCK_RUNS).cast("int")
    lead = F.col("lead")
    dealt = total.select("family", lead["component"].alias("lead"), blocks(F.col("asking") - lead["asking"]).alias("ask_rest"), blocks(lead["asking"]).alias("ask_lead"), blocks(F.col("cost") - lead["cost"]).alias("rest"), blocks(lead["cost"]).alias("leads"))
    placed = _joined(nodes, dealt, "family").withColumn("led", F.col("component") == F.col("lead"))
    turn = F.xxhash64("node")
    deal = lambda led, rest: F.when(F.col("led"), F.col(rest) + F.pmod(turn, F.col(led))).otherwise(F.pmod(turn, F.col(rest))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))  # noqa: E731  null, and so no rows, where there are none
    # the largest class is not compared within itself: its askers meet the blocks of the rest only, and the other way round
    left = placed.filter("asks").select("family", "node", "component", F.lit(True).alias("asks"), deal("ask_lead", "ask_rest").alias("low"), F.explode(upto(F.when(F.col("led"), F.col("rest")).otherwise(F.col("rest") + F.col("leads")))).alias("high"))
    right = placed.select("family", "node", "component", F.lit(False).alias("asks"), F.explode(upto(F.when(F.col("led"), F.col("ask_rest")).otherwise(F.col("ask_rest") + F.col("ask_lead")))).alias("low"), deal("leads", "rest").alias("high"))
    full = _joined(left.unionByName(right), sets, "node")
    kind = nodes.schema["node"].dataType
    return stored(full.groupBy("family", "low", "high").applyInArrow(_block_table, StructType().add("a", kind).add("b", kind)), "links")


def _classes(links: DataFrame) -> DataFrame:
    return stored(connected_components(links, "a", "b", 1 + links.count() // LINKS_PER_TASK), "classes")


# --- the join


def link_classes(nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(node, component)`` of the nodes with a link, from ``(node, n, first, r)``."""
    able = nodes.filter(F.col("n") >= LEAST_RUNS)
    lists = stored(inverted_lists(able), "lists")
    asked = stored(asked_runs(lists), "asked")
    firsts = able.select("node", "n", F.col("first").alias("runs"))
    tried = stored(_probed(candidate_pairs(lists, asked), firsts, whole=False), "tried")
    long = stored(long_lists(lists, asked), "long")
    wanted = tried.select(F.explode(F.array("a", "b")).alias("node")).unionAll(long.select("node")).distinct()
    chosen = _joined(nodes, wanted, "node", "left_semi").select("node", "r.id", "r.text_hash")
    named = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
    texts = _joined(named, chosen, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash"))).select("node", "text")
    sets = map_batches(texts, _set_batches, StructType([nodes.schema["node"], _longs("runs")]))
    sets = stored(sets.dropDuplicates(["node"]), "sets")  # rows that agree in id and text

    links = stored(_probed(tried, sets, whole=True), "links")
    classes = _classes(links)
    more = family_links(long, asked, classes, sets)
    return classes if more is None or more.isEmpty() else _classes(links.unionAll(more))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key, n_shingles, component_id`` and the rows of the component."""
    sketch = stored(sketches(docs, key, text), "sketch")
    known = sketch.filter(F.col("node").isNotNull())
    named = known.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("r"), F.first("n").alias("n"), F.first("first").alias("first"))
    nodes = stored(named.withColumnRenamed("node", "name").withColumn("node", F.monotonically_increasing_id()), "nodes")
    classes = link_classes(nodes, docs, key, text)
    of_name = _joined(nodes.select("name", "node"), classes, "node", "left").select(F.col("name"), F.coalesce("component", "node").cast("string").alias("class"))
    rows = _joined(sketch.select("id", "n", "node"), of_name, F.col("node") == F.col("name"), "left")
    # a text without words stands for itself
    rows = rows.select("id", "n", F.coalesce("class", F.concat(F.lit("row "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).alias("class"))
    least = rows.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("n_docs"))
    return _joined(rows, least, "class").select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"), "n_docs")
