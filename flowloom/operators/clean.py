"""Cleaning of raw flow tables: validation, coercion, deduplication, Inf/NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.labels import canonical_label, traffic_class
from flowloom.functions.net import is_valid_ip, is_valid_port
from flowloom.functions.parsing import bind, finite, number, timestamp
from flowloom.schemas import INF_DROP_LIMIT, TOPOLOGY_COLUMNS

REJECT_REASONS = ("blank", "ip", "port", "timestamp")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail at analysis time when a column is missing; else the columns in order."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def is_blank(columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for name in columns:
        test = test & F.col(f"`{name}`").isNull()
    return test


def drop_blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(~is_blank(columns))


def mark_rejects(raw: DataFrame, columns: Sequence[str] = TOPOLOGY_COLUMNS) -> DataFrame:
    """Add ``reject_reason``: the first failed check, NULL for a valid row."""
    missing = [n for n in columns if n not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    # the filter and the projection both use the time: it is parsed before them
    parsed = bind(raw, _ts=timestamp("Timestamp"))
    return parsed.withColumn(
        "reject_reason",
        F.when(is_blank(columns), "blank")
        .when(~(is_valid_ip("Source IP") & is_valid_ip("Destination IP")), "ip")
        .when(~(is_valid_port("Source Port") & is_valid_port("Destination Port")), "port")
        .when(F.col("_ts").isNull(), "timestamp"),
    )


def clean_flows(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Valid rows of a raw topology table in the flow schema.

    An unparseable protocol and an unknown label raise; byte totals that do not
    parse count as 0. Survivor counts come from ``reject_accounting``.
    """
    good = mark_rejects(raw).filter(F.col("reject_reason").isNull())
    protocol = number("Protocol")
    bad_protocol = F.raise_error(F.lit("protocol is not numeric")).cast("int")
    carried = [c for c in ("source_file",) if c in raw.columns]
    flows = good.select(
        F.col("Source IP").alias("src_ip"),
        number("Source Port").cast("int").alias("src_port"),
        F.col("Destination IP").alias("dst_ip"),
        number("Destination Port").cast("int").alias("dst_port"),
        F.when(protocol.isNull(), bad_protocol).otherwise(protocol.cast("int")).alias("protocol"),
        F.col("_ts").alias("ts"),
        F.coalesce(number("Total Length of Fwd Packets"), F.lit(0.0)).alias("fwd_bytes"),
        F.coalesce(number("Total Length of Bwd Packets"), F.lit(0.0)).alias("bwd_bytes"),
        F.col("Label").alias("original_label"),
        canonical_label("Label").alias("canonical_label"),
        *carried,
        *[F.col(f"`{c}`") for c in extra],
    )
    return flows.withColumn("traffic_class", traffic_class("canonical_label"))


def reject_accounting(raw: DataFrame, by: Sequence[str] = ("source_file",)) -> DataFrame:
    """Row counts per file and first failed check; one pass, one shuffle."""
    reason = F.col("reject_reason")
    return (
        mark_rejects(raw)
        .groupBy(*by)
        .agg(
            F.count("*").alias("raw_rows"),
            F.count_if(reason == "blank").alias("blank_rows"),
            F.count_if(reason == "ip").alias("invalid_ip_rows"),
            F.count_if(reason == "port").alias("invalid_port_rows"),
            F.count_if(reason == "timestamp").alias("invalid_timestamp_rows"),
            F.count_if(reason.isNull()).alias("valid_rows"),
        )
    )


def total_accounting(per_file: DataFrame) -> DataFrame:
    """Sum of per-file accounts, with the number of files."""
    counts = [c for c in per_file.columns if c.endswith("_rows")]
    return per_file.agg(F.count("*").alias("files_processed"), *[F.sum(c).alias(c) for c in counts])


def within_window(ts: Column | str, start: str, end: str, closed: str = "both") -> Column:
    """Time filter, inclusive at both ends; ``closed='left'`` is half-open."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return (ts >= low) & ((ts <= high) if closed == "both" else (ts < high))


def drop_exact_duplicates(df: DataFrame, file_column: str = "source_file") -> DataFrame:
    """One row per distinct content, carrying the first file name it came from.

    Copies collapse in the map-side aggregate, so a much-copied row costs one
    shuffled row per task. ``copies`` tells how many rows stood behind it.
    """
    content = [c for c in df.columns if c != file_column]
    kept = df.groupBy(*[F.col(f"`{c}`") for c in content]).agg(
        F.min(file_column).alias(file_column), F.count("*").alias("copies")
    )
    return kept.select(*[F.col(f"`{c}`") for c in df.columns], "copies")


def duplicate_row_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows that repeat an earlier row, per ``by`` (typically the file)."""
    sizes = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    return sizes.groupBy(*by).agg(F.sum(F.col("_n") - 1).alias("duplicate_rows"), F.sum("_n").alias("rows"))


def infinite_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(f"`{c}`")) for c in columns})


def infinite_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: infinities per column, affected rows, share in percent."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | finite(F.col(f"`{c}`")).isNull()
    affected = F.count_if(missing)
    return df.agg(
        *[F.count_if(F.abs(F.col(f"`{c}`")) == float("inf")).alias(f"inf {c}") for c in columns],
        F.count("*").alias("total_rows"),
        affected.alias("affected_rows"),
        F.round(100.0 * affected / F.count("*"), 6).alias("affected_pct"),
    )


def infinite_breakdown(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Affected rows per value of ``by`` (label or file), most first."""
    test = F.lit(False)
    for c in columns:
        test = test | finite(F.col(f"`{c}`")).isNull()
    return df.filter(test).groupBy(by).agg(F.count("*").alias("affected_rows")).orderBy(F.desc("affected_rows"), by)


def split_infinite(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(kept, quarantined)``: rows whose columns are all finite, and the others as they came.

    What becomes of the others is the caller's choice; ``infinite_stats`` gives their
    share and ``stop_if_infinite`` is the rule that ends a run over it.
    """
    bad = F.lit(False)
    for c in columns:
        bad = bad | finite(F.col(f"`{c}`")).isNull()
    return df.filter(~bad), df.filter(bad)


def stop_if_infinite(df: DataFrame, columns: Sequence[str], limit: float = INF_DROP_LIMIT) -> None:
    """Raise when the affected share is above the limit (one aggregate job)."""
    row = infinite_stats(df, columns).first()
    if row["total_rows"] and row["affected_rows"] / row["total_rows"] > limit:
        raise RuntimeError(f"non-finite share {row['affected_pct']}% is above {100 * limit}%: stopping")


def finite_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coerce the feature columns; keep rows where all of them are finite."""
    coerced = df.withColumns({c: finite(number(F.col(f"`{c}`"))) for c in columns})
    return coerced.na.drop("any", subset=[f"`{c}`" for c in columns])


def assert_clean(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail when a feature matrix still holds NaN, Inf or NULL."""
    if non_finite_count(df, columns).first()["bad_cells"]:
        raise AssertionError("feature matrix holds NaN or Inf after cleaning")


def non_finite_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    total = F.lit(0)
    for c in columns:
        total = total + F.count_if(finite(F.col(f"`{c}`")).isNull())
    return df.agg(F.count("*").alias("rows"), total.cast("long").alias("bad_cells"))


def benign_training_rows(df: DataFrame, label: str = "canonical_label") -> DataFrame:
    return df.filter(F.col(label) == "BENIGN")


def benign_training_counts(df: DataFrame, n_features: int, label: str = "canonical_label") -> DataFrame:
    benign = F.count_if(F.col(label) == "BENIGN")
    return df.agg(
        F.count("*").alias("total_training_rows"),
        benign.alias("benign_training_rows"),
        (F.count("*") - benign).alias("attack_rows_excluded"),
        F.lit(n_features).cast("long").alias("matrix_columns"),
    )
