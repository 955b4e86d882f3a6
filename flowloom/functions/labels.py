"""Label canonicalisation and the binary traffic class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.schemas import (
    ATTACK,
    BENIGN,
    CANONICAL_LABELS,
    CLEAN_LABELS,
    CONTROL_CHAR_LABELS,
    REPLACEMENT_CHAR_LABELS,
)


def _mapping(topology: bool) -> dict[str, str]:
    known = {label: label for label in CLEAN_LABELS} | REPLACEMENT_CHAR_LABELS
    return known | CONTROL_CHAR_LABELS if topology else known


def canonical_label(label: Column | str, topology: bool = True, strict: bool = True) -> Column:
    """Canonical spelling of a raw label.

    Unknown labels (NULL included) raise when ``strict``, else give NULL. With
    ``topology`` the U+0096 spellings are known too.
    """
    label = F.col(label) if isinstance(label, str) else label
    table = F.create_map(*[F.lit(x) for pair in _mapping(topology).items() for x in pair])
    found = F.try_element_at(table, label)
    if not strict:
        return found
    message = F.concat(F.lit("unrecognised label: "), F.coalesce(label, F.lit("NULL")))
    return F.coalesce(found, F.raise_error(message).cast("string"))


def unknown_labels(df: DataFrame, label: str, topology: bool = True) -> DataFrame:
    """Distinct labels outside the known set, sorted, with their row counts."""
    return (
        df.filter(canonical_label(label, topology, strict=False).isNull())
        .groupBy(F.col(label).alias("label"))
        .agg(F.count("*").alias("rows"))
        .orderBy("label")
    )


def traffic_class(canonical: Column | str) -> Column:
    canonical = F.col(canonical) if isinstance(canonical, str) else canonical
    return F.when(canonical == BENIGN, BENIGN).otherwise(ATTACK)


# Sets of labels and protocols are kept as bit masks while aggregating: a fixed
# width buffer stays in the hash aggregate, where collect_set would not.
ATTACK_LABELS = tuple(sorted(label for label in CANONICAL_LABELS if label != BENIGN))


def attack_label_bit(canonical: Column | str) -> Column:
    canonical = F.col(canonical) if isinstance(canonical, str) else canonical
    table = F.create_map(*[x for i, name in enumerate(ATTACK_LABELS) for x in (F.lit(name), F.lit(1 << i))])
    return F.coalesce(F.try_element_at(table, canonical), F.lit(0))


def labels_from_bits(bits: Column) -> Column:
    """Sorted label array behind a mask."""
    members = F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, name) for i, name in enumerate(ATTACK_LABELS)])
    return F.array_compact(members)
