"""Weakly connected components by alternating star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): the
large-star step hooks bigger neighbours onto the smallest one, the small-star
step does so for smaller neighbours; the edge set shrinks to one star per
component in O(log^2 n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import ensure_checkpoint_dir


def _large_star(pairs: DataFrame) -> DataFrame:
    """Hook every bigger neighbour of u onto u's smallest neighbour."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("p"))
    both = both.select("p.u", "p.v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    hooked = both.filter("v > u").join(least.hint("merge"), "u")
    return hooked.select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Hook u and its smaller neighbours onto the smallest of them."""
    down = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hooked = down.join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hooked.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _within(df: DataFrame, tasks: int | None) -> DataFrame:
    return df if tasks is None else df.coalesce(tasks)


def connected_components(edges: DataFrame, src: str = "src_ip", dst: str = "dst_ip", tasks: int | None = None) -> DataFrame:
    """``(node, component)`` with the smallest node name as component name.

    ``tasks`` bounds the tasks of a step, for callers that know how many edges there
    are; without it the session's shuffle partitions hold.

    The minimum per node is a partial aggregate, so a hub costs one row per
    task; joining it back is an equi-join on the hub with one row on the small
    side, which the adaptive skew join splits. Lineage is cut every round in the
    shared checkpoint folder. Two numbers per round reach the driver, and no table is broadcast from it.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    nodes = edges.select(F.explode(F.array(src, dst)).alias("node")).distinct()
    pairs = edges.filter(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct()
    seen = None
    while True:
        large = _within(_large_star(pairs).filter("a <> b"), tasks)
        pairs = _within(_small_star(large).filter("a <> b").distinct(), tasks).checkpoint()
        mark = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    hooks = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(hooks.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def component_sizes(edges: DataFrame, src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    return connected_components(edges, src, dst).groupBy("component").agg(F.count("*").alias("size"))
