"""Order-dependent work that stays balanced when one key is hot.

A window partitioned by key alone puts a whole key into one task. Here a key is
cut into chunks (time slices, id ranges, hash buckets): rows are only windowed
inside ``(key, chunk)``, and what crosses a chunk border is carried through a
table with one row per chunk.

``Slices`` cut only keys that hold many rows, at quantiles of their own times, so a slice
holds about as many rows as any other however the rows lie in time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.parsing import micros

_FOLD = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def time_chunk(ts: Column | str, seconds: int) -> Column:
    """Number of the time slice a timestamp falls into."""
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


@dataclass(frozen=True)
class Slices:
    """How keys are cut along time.

    One row in ``every``, chosen by a hash, places the cuts; where they lie changes the
    balance, never a result. A key of more than ``rows`` rows is cut into parts of about
    that size, ``most`` at the most. Only the ``keys`` keys with most rows are cut: one
    beyond them holds less than that share of the table. So the table of cuts has a fixed
    bound and is broadcast.
    """

    rows: int = 1_000_000
    every: int = 64
    most: int = 256
    keys: int = 1000


def cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: Slices) -> DataFrame:
    """``(keys, _cuts)``: ascending first times of the second and later slices of the keys that are cut.

    ``order`` starts with the time in microseconds.
    """
    t, n = order[0], F.col("_n") * slices.every
    sampled = df.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(slices.every)) == 0)
    steps = [k / slices.most for k in range(1, slices.most)]
    known = sampled.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(t, steps, 10 * slices.most).alias("_q")).filter(n > slices.rows)
    parts = F.least(F.lit(slices.most), F.ceil(n / slices.rows)).cast("int")
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), parts - 1), lambda j: F.get("_q", F.floor(j * slices.most / parts).cast("int") - 1)))
    return known.orderBy(F.desc("_n"), *keys).limit(slices.keys).select(*keys, cuts.alias("_cuts"))


def with_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: Slices) -> DataFrame:
    """Add ``_slice``, the number of a row's slice within its key, and ``_cut``: the key has several.

    Rows that have them keep them: what is cut for some keys is cut for finer ones, too.
    """
    if "_cut" in df.columns:
        return df
    met = df.join(F.broadcast(cut_points(df, keys, order, slices)), list(keys), "left")
    number = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col(order[0]))))
    return met.withColumns({"_slice": number, "_cut": F.col("_cuts").isNotNull()}).drop("_cuts")


def id_chunk(key: Column | str, width: int = 1 << 16) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.floor(key / F.lit(width)).cast("long")


def value_chunk(value: Column | str, per_octave: int = 4096) -> Column:
    """Order-preserving slice number of a double, equally fine at every magnitude."""
    v = F.col(value) if isinstance(value, str) else value
    depth = F.floor(F.log2(F.abs(v)) * per_octave) + F.lit(1100 * per_octave)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * depth).cast("long")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | str | None, values: dict[str, str]
) -> DataFrame:
    """Add the previous row's values within ``keys`` along ``order``.

    ``chunk`` (a column or the name of one) must not decrease along ``order``.
    ``values`` maps new column names to the columns they lag. Without a chunk the
    key itself is the window, for keys known to be small.
    """
    keys, order = list(keys), list(order)
    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: F.lag(source).over(whole) for name, source in values.items()})
    slot = chunk if isinstance(chunk, str) else "_chunk"
    packed = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    cut = (df if isinstance(chunk, str) else df.withColumn(slot, chunk)).withColumn("_packed", packed)
    local = Window.partitionBy(*keys, slot).orderBy(*order)
    inner = cut.withColumn("_before", F.lag("_packed").over(local))
    carried = (
        cut.groupBy(*keys, slot)
        .agg(F.max_by("_packed", F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(slot)))
        .select(*keys, slot, "_carry")
    )
    joined = inner.join(carried, [*keys, slot], "left")
    before = F.coalesce("_before", "_carry")
    return joined.select(*df.columns, *[before[name].alias(name) for name in values])


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | str | Slices | None,
    aggregates: dict[str, tuple[str, str | None]],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add aggregates over all earlier rows of the same key (own row excluded).

    ``aggregates`` maps a new name to ``(kind, column)`` with kind ``count``,
    ``sum``, ``min`` or ``max``; counts start at 0, the others at NULL.
    ``totals`` maps a new name to an aggregate whose whole-key total is wanted.
    ``chunk`` may name a column of ``df``: it is kept, and so is the partitioning
    by key and chunk for a following step. With ``Slices`` (``order`` then starts with
    the time in microseconds) what comes before a slice is only computed for the keys that
    are cut, and the table of it is broadcast within its bound. Without a chunk the key
    itself is the window, for keys known to be small.
    """
    keys, order = list(keys), list(order)

    def measure(kind: str, column: str | None) -> Column:
        return F.count(F.lit(1)) if kind == "count" else _FOLD[kind](column)

    if chunk is None:
        ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        added = {n: measure(k, c).over(ahead) for n, (k, c) in aggregates.items()}
        added |= {n: measure(*aggregates[source]).over(whole) for n, source in (totals or {}).items()}
        return df.withColumns(added)

    sliced = isinstance(chunk, Slices)
    slot = "_slice" if sliced else chunk if isinstance(chunk, str) else "_chunk"
    cut = with_slices(df, keys, order, chunk) if sliced else df if isinstance(chunk, str) else df.withColumn(slot, chunk)
    local = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumns({f"_in_{n}": measure(k, c).over(local) for n, (k, c) in aggregates.items()})
    if sliced:  # a key that is not cut is its only slice
        inner = inner.withColumns({f"_own_{n}": measure(*aggregates[source]).over(Window.partitionBy(*keys, slot)) for n, source in (totals or {}).items()})
        cut = cut.filter("_cut")
    per_chunk = cut.groupBy(*keys, slot).agg(*[measure(k, c).alias(f"_all_{n}") for n, (k, c) in aggregates.items()])
    along = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    wanted = {f"_pre_{n}": _FOLD[k](f"_all_{n}").over(along) for n, (k, _) in aggregates.items()}
    for name, source in (totals or {}).items():
        wanted[name] = _FOLD[aggregates[source][0]](f"_all_{source}").over(whole)
    carried = per_chunk.withColumns(wanted).select(*keys, slot, *wanted)
    joined = inner.join(F.broadcast(carried) if sliced else carried, [*keys, slot], "left")

    def combined(name: str, kind: str) -> Column:
        before, inside = F.col(f"_pre_{name}"), F.col(f"_in_{name}")
        if kind == "count":
            return (F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))).cast("long")
        if kind == "sum":
            both = F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
            return F.when(before.isNotNull() | inside.isNotNull(), both)
        return F.least(before, inside) if kind == "min" else F.greatest(before, inside)

    return joined.select(
        *df.columns,
        *[combined(n, k).alias(n) for n, (k, _) in aggregates.items()],
        *[F.coalesce(n, f"_own_{n}").alias(n) if sliced else F.col(n) for n in (totals or {})],
    )


def shuffled_rank(df: DataFrame, groups: Sequence[str], key: Column, seed: int = 42) -> DataFrame:
    """Rank rows of each group in a fixed pseudo-random order.

    Adds ``rank`` (1-based) and ``group_rows``. The order is that of the md5 of
    seed and key; its leading digits are the chunk, so a group of any size is
    ranked by up to 4096 tasks.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))))
    chunk = F.conv(F.substring("_hash", 1, 3), 16, 10).cast("long")
    ranked = running_before(
        hashed, groups, ["_hash"], chunk, {"_ahead": ("count", None)}, totals={"group_rows": "_ahead"}
    )
    return ranked.withColumn("rank", F.col("_ahead") + 1).drop("_ahead", "_hash")


def exact_percentiles(
    df: DataFrame, value: str, points: Sequence[float], groups: Sequence[str] = (), margin: float = 1e-4
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group and point.

    Output: ``groups``, ``point``, ``n``, ``percentile``. An approximate sketch
    brackets each wanted rank; only rows inside the bracket (a share of about
    ``2 * margin``, or the whole group when it is small) are counted by distinct
    value and walked in order. ``groups`` are meant to be columns with few
    distinct values (labels, classes): one bracket row per group meets the rows. It is broadcast: a shuffle
    by group would put every row of a class into one task.
    """
    groups = list(groups)
    rows = df.select(*groups, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    small = F.col("_n") < F.lit(int(2 / margin))
    accuracy = int(10 / margin)
    edges = []
    for i, p in enumerate(points):
        low, high = max(0.0, p - margin), min(1.0, p + margin)
        edges += [
            F.percentile_approx("_v", F.lit(low), F.lit(accuracy)).alias(f"_lo{i}"),
            F.percentile_approx("_v", F.lit(high), F.lit(accuracy)).alias(f"_hi{i}"),
        ]
    sketch = rows.groupBy(*groups).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), *edges)
    brackets = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("point"),
                F.when(small, F.col("_min")).otherwise(F.col(f"_lo{i}")).alias("low"),
                F.when(small, F.col("_max")).otherwise(F.col(f"_hi{i}")).alias("high"),
            )
            for i, p in enumerate(points)
        ]
    )
    sketch = sketch.select(*groups, "_n", brackets.alias("_brackets"))
    if groups:
        met = rows.join(F.broadcast(sketch), groups)
    else:
        one = sketch.select(F.struct("_n", "_brackets").alias("s"))
        met = rows.withColumn("_s", one.scalar()).select("_v", "_s._n", "_s._brackets")
    # Rows below a bracket are only counted; rows inside keep their value.
    split = met.select(*groups, "_n", "_v", F.explode("_brackets").alias("b")).filter(F.col("_v") <= F.col("b.high"))
    kept = F.when(F.col("_v") >= F.col("b.low"), F.col("_v"))
    counted = split.groupBy(*groups, "_n", F.col("b.point").alias("point"), kept.alias("_v")).agg(F.count("*").alias("_c"))
    walk = Window.partitionBy(*groups, "point").orderBy(F.col("_v").asc_nulls_first())
    placed = counted.withColumn("_upto", F.sum("_c").over(walk))
    position = (F.col("_n") - 1) * F.col("point")
    lower, upper = F.floor(position), F.ceil(position)

    def at(rank: Column) -> Column:
        hit = F.col("_v").isNotNull() & (F.col("_upto") > rank)
        return F.min(F.when(hit, F.col("_v")))

    share = F.max(position - lower)
    return placed.groupBy(*groups, "point").agg(
        F.max("_n").alias("n"), (at(lower) + (at(upper) - at(lower)) * share).alias("percentile")
    )


def percentile_columns(
    df: DataFrame, value: str, points: dict[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """``exact_percentiles`` as one row per group with a named column per point."""
    groups = list(groups)
    long = exact_percentiles(df, value, list(points.values()), groups)
    return long.groupBy(*groups).agg(
        *[F.max(F.when(F.col("point") == F.lit(float(p)), F.col("percentile"))).alias(n) for n, p in points.items()]
    )
