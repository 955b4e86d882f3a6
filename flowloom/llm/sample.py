"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1_000_000


def crc_fold(key: Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def hash_share(rows: DataFrame, key: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` of the rows, chosen by a hash of their key; all if there are no more.

    The choice needs one count of the key column and no sort, and does not depend on
    partitions. The expected size is the bound.
    """
    n = rows.count()
    if n <= max_rows:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(_STEPS)) < int(_STEPS * max_rows / n))
