"""Deterministic splits and samples with exact per-class counts."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.ordered import shuffled_rank


def stratified_split(
    df: DataFrame,
    label: str,
    key: Column,
    fractions: Sequence[tuple[str, float]] = (("train", 0.70), ("val", 0.15), ("test", 0.15)),
    least: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: disjoint, covering, with exact per-class proportions.

    Rows of a class are ranked in a fixed pseudo-random order and cut at the
    cumulative shares, rounded half up in decimals (in doubles 0.7 * 45 is below 31.5). Classes below ``least`` rows go to the first
    split whole.
    """
    if abs(sum(f for _, f in fractions) - 1.0) > 1e-9:
        raise ValueError("split fractions must sum to 1")
    ranked = shuffled_rank(df, [label], key, seed)
    chosen, share = None, 0.0
    first = fractions[0][0]
    chosen = F.when(F.col("group_rows") < least, first)
    for name, fraction in fractions[:-1]:
        share += fraction
        upto = F.round(F.col("group_rows").cast("decimal(20,0)") * F.lit(Decimal(str(round(share, 9)))))
        chosen = chosen.when(F.col("rank") <= upto, name)
    return ranked.withColumn("split", chosen.otherwise(fractions[-1][0])).drop("rank", "group_rows")


def half_split(df: DataFrame, label: str, key: Column, seed: int = 42) -> DataFrame:
    """Fresh stratified halves of scored flows."""
    return stratified_split(df, label, key, (("validation", 0.5), ("test", 0.5)), least=2, seed=seed)


def per_class_sample(df: DataFrame, label: str, key: Column, per_class: int = 20, total: int = 300, seed: int = 42) -> DataFrame:
    """Up to ``per_class`` rows of every class, then at most ``total`` rows.

    The rank limit is pushed below the shuffle, so each task forwards no more
    than ``per_class`` rows of a class.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))))
    order = Window.partitionBy(label).orderBy("_hash")
    few = hashed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_class)
    return few.orderBy("_hash").limit(total).drop("_r", "_hash")
