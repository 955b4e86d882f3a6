"""Profiling, column redundancy, scaling and schema checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowloom.functions.net import is_valid_ip, is_valid_port
from flowloom.functions.parsing import finite, number, timestamp
from flowloom.operators.ordered import shuffled_rank
from flowloom.schemas import LABEL_NAME_HINTS, METADATA_ONLY_COLUMNS, PLAUSIBLE_PROTOCOLS, REQUIRED_TOPOLOGY_FIELDS


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def cell_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n)``: every distinct cell text with its count.

    One unpivot and one partially aggregated shuffle serve all per-column
    measures; constants, sentinels and NULLs collapse before the shuffle.
    """
    names = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in names])
    return df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, stray blanks, missing, infinite, distinct, constant,
    and how many texts of a text column do not parse as numbers."""
    names = list(columns or df.columns)
    types = dict(df.dtypes)
    numeric = {c: types[c] not in ("string", "timestamp", "timestamp_ntz", "date", "boolean") for c in names}
    meta = F.create_map(
        *[
            x
            for c in names
            for x in (
                F.lit(c),
                F.struct(
                    F.lit(types[c]).alias("dtype"),
                    F.lit(c != c.strip()).alias("has_stray_whitespace"),
                    F.lit(numeric[c]).alias("numeric"),
                ),
            )
        ]
    )
    missing = F.col("value").isNull() | (F.element_at(meta, F.col("column"))["numeric"] & (F.col("value") == "NaN"))
    infinite = F.element_at(meta, F.col("column"))["numeric"] & F.col("value").isin("Infinity", "-Infinity")
    odd = ~F.element_at(meta, F.col("column"))["numeric"] & ~missing & number("value").isNull()
    rolled = (
        cell_counts(df, names)
        .groupBy("column")
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("missing_count"),
            F.coalesce(F.sum(F.when(infinite, F.col("n"))), F.lit(0)).alias("infinite_count"),
            F.count_if(~missing).alias("unique_count"),
            F.coalesce(F.sum(F.when(odd, F.col("n"))), F.lit(0)).alias("unparseable_count"),
        )
    )
    info = F.element_at(meta, F.col("column"))
    return rolled.select(
        "column",
        info["dtype"].alias("dtype"),
        info["has_stray_whitespace"].alias("has_stray_whitespace"),
        "missing_count",
        F.round(100.0 * F.col("missing_count") / F.col("rows"), 4).alias("missing_pct"),
        "infinite_count",
        "unique_count",
        (F.col("unique_count") <= 1).alias("is_constant"),
        "unparseable_count",
        (F.col("unparseable_count").between(1, F.col("rows") - 1) & ~info["numeric"]).alias("mixed_numeric"),
    )


def mixed_numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns that mostly parse as numbers: the count that does not."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).alias("value")) for c in columns])
    bad = F.col("c.value").isNotNull() & number(F.col("c.value")).isNull()
    return (
        df.select(F.explode(cells).alias("c"))
        .groupBy("c.column")
        .agg(F.count("*").alias("rows"), F.count_if(bad).alias("unparseable_count"))
        .withColumn("mixed_numeric", F.col("unparseable_count").between(1, F.col("rows") - 1))
    )


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, only columns that have some."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(_q(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count")) for i, c in enumerate(names)])
    return counts.select(F.inline(cells)).filter("missing_count > 0")


def label_column(columns: Sequence[str]) -> str | None:
    """The label column by name: exactly ``label``, else one hinting at it."""
    tidy = {c: c.strip().lower() for c in columns}
    exact = [c for c, t in tidy.items() if t == "label"]
    hinted = [c for c, t in tidy.items() if any(h in t for h in LABEL_NAME_HINTS)]
    return (exact or hinted or [None])[0]


def label_distribution(df: DataFrame, label: str | None = None) -> DataFrame:
    """Rows per label, NULL counted, most first."""
    name = label or label_column(df.columns)
    if name is None:
        raise ValueError("no label column found")
    return df.groupBy(_q(name).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def topology_issues(raw: DataFrame, file_column: str = "source_file", examples: int = 5) -> DataFrame:
    """Validation issues per file and check with up to five example values.

    Timestamps are read month-first here, and only non-NULL ones can fail.
    Examples are the smallest distinct bad texts; the rank filter is pushed
    below the shuffle, so a check that fails on every row stays cheap.
    """
    bad_protocol = ~F.coalesce(number("Protocol").isin(*[float(p) for p in PLAUSIBLE_PROTOCOLS]), F.lit(False))
    checks = {
        "Source IP: malformed IP address": ("Source IP", ~is_valid_ip("Source IP")),
        "Destination IP: malformed IP address": ("Destination IP", ~is_valid_ip("Destination IP")),
        "invalid Source Port (outside 0-65535 or non-integer)": ("Source Port", ~is_valid_port("Source Port")),
        "invalid Destination Port (outside 0-65535 or non-integer)": ("Destination Port", ~is_valid_port("Destination Port")),
        "unexpected protocol value (not in {0,1,2,6,17,41,47,50,51,58,132})": ("Protocol", bad_protocol),
        "unparseable timestamp": (
            "Timestamp",
            F.col("Timestamp").isNotNull() & timestamp("Timestamp", day_first=False).isNull(),
        ),
    }
    sizes = raw.groupBy(file_column).agg(F.count("*").alias("rows"))
    # only rows that fail something leave values, so every check is made once
    fails = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(name).alias("check"), F.coalesce(_q(c), F.lit("nan")).alias("value"))) for name, (c, bad) in checks.items()]))
    failed = raw.select(file_column, F.explode(fails).alias("f")).select(file_column, "f.check", "f.value")
    found = failed.groupBy(file_column, "check", "value").agg(F.count("*").alias("_n"))
    issues = found.groupBy(file_column, "check").agg(F.sum("_n").alias("issue_count"))
    order = Window.partitionBy(file_column, "check").orderBy("value")
    sample = (
        found.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= examples)
        .groupBy(file_column, "check")
        # the count is carried along, so that both branches read one exchange of the values
        .agg(F.array_sort(F.collect_list(F.struct("value", "_n"))).alias("_held"))
        .withColumn("examples", F.col("_held.value"))
        .drop("_held")
    )
    issues = issues.join(sample, [file_column, "check"])
    data = [c for c in raw.columns if c != file_column]
    repeats = (
        raw.groupBy(file_column, *[_q(c) for c in data])
        .agg(F.count("*").alias("_n"))
        .groupBy(file_column)
        .agg(F.sum(F.col("_n") - 1).alias("issue_count"))
        .filter("issue_count > 0")
        .select(
            file_column,
            F.lit("fully duplicate rows").alias("check"),
            "issue_count",
            F.array().cast("array<string>").alias("examples"),
        )
    )
    both = issues.select(file_column, "check", "issue_count", "examples").unionByName(repeats)
    return both.join(sizes, file_column).select(
        file_column,
        "check",
        "issue_count",
        F.round(100.0 * F.col("issue_count") / F.col("rows"), 4).alias("pct"),
        "examples",
    )


def variance_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population variance per column; equal minimum and maximum is the zero test."""
    wide = df.agg(
        *[x for i, c in enumerate(columns) for x in (F.var_pop(_q(c)).alias(f"v{i}"), F.min(_q(c)).alias(f"a{i}"), F.max(_q(c)).alias(f"z{i}"))]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"v{i}").cast("double").alias("variance"),
                (F.col(f"a{i}") == F.col(f"z{i}")).alias("zero_variance"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))


def column_roles(df: DataFrame, columns: Sequence[str], label: str = "Label") -> tuple[list[str], list[str]]:
    """Model columns (zero variance removed) and metadata columns."""
    flat = {r["column"] for r in variance_profile(df, columns).filter("zero_variance").collect()}
    return [c for c in columns if c not in flat], [label, "canonical_label", "source_file", "Destination Port"]


_CO = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType(), False)) for c in ("n", "mean", "var", "co")])
#: Tasks that merge the sums of all others.
MERGERS = 8


def _co_moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matrices over column pairs (i, j), from the rows that have both: count, mean of i, squared deviations of i, co-deviations.

    Columns are shifted by their first value, so a constant column deviates by exactly 0.
    """
    here = ~np.isnan(x)
    shift = np.array([c[h][0] if h.any() else 0.0 for c, h in zip(x.T, here.T)])
    z, m = np.where(here, x - shift, 0.0), here.astype(np.float64)
    n, total = m.T @ m, z.T @ m
    mean = total / np.maximum(n, 1)
    return n, np.where(n > 0, mean + shift[:, None], 0.0), (z * z).T @ m - total * mean, z.T @ z - total * mean.T


def _merged(a: tuple[np.ndarray, ...] | None, b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    if a is None:
        return b
    n = a[0] + b[0]
    off, weight = b[1] - a[1], a[0] * b[0] / np.maximum(n, 1)
    mean = np.where(a[0] == 0, b[1], np.where(b[0] == 0, a[1], a[1] + off * b[0] / np.maximum(n, 1)))
    return n, mean, a[2] + b[2] + off * off * weight, a[3] + b[3] + off * off.T * weight


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, from the rows that have both, in one scan.

    Every task sums products of its rows as matrices and leaves one row of them, and a few
    tasks merge these; nothing grows with the rows. Constant columns give NULL where the
    built-in ``corr`` would divide by zero.
    """
    k, arrow = len(columns), to_arrow_schema(_CO)
    pairs = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType()), T.StructField("correlation", T.DoubleType())])

    def one(sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_CO.names, (m.ravel().tolist() for m in sums)))], schema=arrow)

    def add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                sums = _merged(sums, _co_moments(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])))
        if sums is not None:
            yield one(sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
        sums = None
        for batch in batches:
            for row in range(batch.num_rows):
                sums = _merged(sums, tuple(batch.column(c)[row].values.to_numpy().reshape(k, k) for c in range(4)))
        return sums

    def merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = merge(batches)
        if sums is not None:
            yield one(sums)

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = merge(batches)
        i, j = np.triu_indices(k, 1)
        if sums is None:
            values = [None] * len(i)
        else:
            bottom = np.sqrt(np.maximum(sums[2], 0.0) * np.maximum(sums[2].T, 0.0))
            values = [float(c / d) if d > 0 else None for c, d in zip(sums[3][i, j].tolist(), bottom[i, j].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([columns[x] for x in i]), pa.array([columns[x] for x in j]), pa.array(values, pa.float64())], names=pairs.names)

    clean = df.select(*[finite(_q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    partial = clean.mapInArrow(add_rows, _CO).repartition(MERGERS).mapInArrow(merge_rows, _CO)
    return partial.repartition(1).mapInArrow(correlate, pairs)


def redundant_pairs(
    df: DataFrame, columns: Sequence[str], least: float = 0.999
) -> DataFrame:
    """Near and exact copies among columns, found and proved on all rows.

    Only strong positive correlation makes a candidate. Equality is null-safe
    after NaN became NULL; the few candidate pairs are checked in one aggregate.
    """
    candidates = [tuple(r) for r in correlation_pairs(df, columns).filter(F.col("correlation") >= least).collect()]
    schema = T.StructType(
        [
            T.StructField("left", T.StringType()),
            T.StructField("right", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("correlation", T.DoubleType()),
            T.StructField("mismatch_count", T.LongType()),
            T.StructField("mismatch_pct", T.DoubleType()),
        ]
    )
    if not candidates:
        return df.sparkSession.createDataFrame([], schema)
    differs = [
        F.count_if(~finite(_q(a)).eqNullSafe(finite(_q(b)))).alias(f"d{i}") for i, (a, b, _) in enumerate(candidates)
    ]
    wide = df.agg(F.count("*").alias("rows"), *differs)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("left"),
                F.lit(b).alias("right"),
                F.when(F.col(f"d{i}") == 0, "exact").otherwise("near").alias("kind"),
                F.lit(round(r, 8)).alias("correlation"),
                F.col(f"d{i}").alias("mismatch_count"),
                F.round(100.0 * F.col(f"d{i}") / F.col("rows"), 6).alias("mismatch_pct"),
            )
            for i, (a, b, r) in enumerate(candidates)
        ]
    )
    return wide.select(F.inline(rows))


def fixed_sample(df: DataFrame, key: Column, rows: int, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows (or all, if fewer) in a fixed pseudo-random order."""
    ranked = shuffled_rank(df, [], key, seed)
    return ranked.filter(F.col("rank") <= rows).drop("rank", "group_rows")


def scaler_table(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, mean, scale)``: population deviation, 0 replaced by 1."""
    wide = train.agg(
        *[x for i, c in enumerate(columns) for x in (F.avg(_q(c)).alias(f"m{i}"), F.stddev_pop(_q(c)).alias(f"s{i}"))]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("feature"),
                F.col(f"m{i}").alias("mean"),
                F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("scale"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))


def scale_columns(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise the columns with a fitted scaler table.

    The table has one row per feature; it enters the plan as one scalar
    subquery, so nothing is collected and no join is made.
    """
    entry = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale"))))
    fitted = scaler.agg(entry.alias("fit")).scalar()
    staged = df.withColumn("_fit", fitted)
    scaled = {c: (_q(c) - F.element_at("_fit", F.lit(c))["mean"]) / F.element_at("_fit", F.lit(c))["scale"] for c in columns}
    return staged.withColumns(scaled).drop("_fit")


def class_distribution(df: DataFrame, label: str = "canonical_label") -> DataFrame:
    benign = F.count_if(F.col(label) == "BENIGN")
    attack = F.count_if(F.col(label) != "BENIGN")
    total = F.count(label)
    return df.agg(
        benign.alias("benign_count"),
        attack.alias("attack_count"),
        total.alias("total_count"),
        F.coalesce(F.round(F.try_divide(100.0 * benign, total), 4), F.lit(0.0)).alias("benign_pct"),
        F.coalesce(F.round(F.try_divide(100.0 * attack, total), 4), F.lit(0.0)).alias("attack_pct"),
    )


# --- schemas -----------------------------------------------------------------
def header_table(files: DataFrame) -> DataFrame:
    """``(file, position, column)`` of the headers of several files (``source_path, header``)."""
    return files.select(F.col("source_path").alias("file"), F.posexplode("header").alias("position", "column"))


def schema_consistency(headers: DataFrame) -> DataFrame:
    """Per file: does its ordered header equal that of the first file?"""
    per_file = headers.groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda s: s["column"]).alias("columns")
    )
    first = per_file.agg(F.min_by("columns", "file").alias("c")).scalar()
    return per_file.select(
        "file", F.size("columns").cast("long").alias("column_count"), (F.col("columns") == first).alias("consistent")
    )


def filled_columns(df: DataFrame) -> DataFrame:
    """``(column, filled)``: stripped names of all columns and how many rows hold a value."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c.strip()).alias("column"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(df.columns)])))


def schema_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Stripped column names as shared, only left or only right, with the filled rows of each side."""
    a, b = filled_columns(left).withColumnRenamed("filled", "left_filled"), filled_columns(right).withColumnRenamed("filled", "right_filled")
    side = F.when(F.col("right_filled").isNull(), "only_left").when(F.col("left_filled").isNull(), "only_right").otherwise("shared")
    return a.join(b, "column", "full").select("column", side.alias("side"), "left_filled", "right_filled")


def required_field_presence(headers: DataFrame, required: Sequence[str] = REQUIRED_TOPOLOGY_FIELDS) -> DataFrame:
    """Per file and required field: the header matching after stripping, if any."""
    wanted = F.array(*[F.lit(r) for r in required])
    files = headers.select("file").distinct().select("file", F.explode(wanted).alias("field"))
    found = headers.groupBy("file", F.trim("column").alias("field")).agg(F.min_by("column", "position").alias("found_column"))
    return files.join(found, ["file", "field"], "left").withColumn("present", F.col("found_column").isNotNull())


# --- leakage -----------------------------------------------------------------
def forbidden_features(features: Sequence[str]) -> list[str]:
    return sorted(set(METADATA_ONLY_COLUMNS) & set(features))


def scaler_difference(original: DataFrame, copy: DataFrame) -> DataFrame:
    """Features whose fitted parameters differ between two scaler tables."""
    a, b = original.alias("a"), copy.alias("b")
    joined = a.join(b, F.col("a.feature") == F.col("b.feature"), "full")
    same = F.col("a.mean").eqNullSafe(F.col("b.mean")) & F.col("a.scale").eqNullSafe(F.col("b.scale"))
    return joined.filter(~same).select(F.coalesce("a.feature", "b.feature").alias("feature"))


def leakage_report(
    features: Sequence[str], benign_train: DataFrame, train: DataFrame, test: DataFrame, key: Sequence[str],
    original_scaler: DataFrame, copied_scaler: DataFrame,
) -> DataFrame:
    """Violation count per leakage check (0 everywhere means passed)."""
    spark = train.sparkSession

    def check(name: str, counted: DataFrame) -> DataFrame:
        return counted.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    names = spark.createDataFrame([(n,) for n in forbidden_features(features)], "name string")
    return (
        check("metadata_columns_in_features", names)
        .unionAll(check("attack_rows_in_benign_set", benign_train.filter(F.col("canonical_label") != "BENIGN")))
        .unionAll(check("scaler_refit", scaler_difference(original_scaler, copied_scaler)))
        .unionAll(check("train_keys_in_test", test.join(train.select(*key).distinct(), list(key), "left_semi")))
    )
