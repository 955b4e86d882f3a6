"""Deduplication, profiling, redundancy, scaling, splits, schema and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import clean, profile, split
from flowloom.plans import views
from flowloom.plans.oracle import big, month_first, n, r, valid_ip, valid_port
from flowloom.plans.q_sources import SPLIT_CTE, written_layouts
from flowloom.plans.registry import query
from flowloom.plans.views import plain

CONTENT = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, canonical_label, bytes_s, packets_s"


@query("d8", f"SELECT source_file, {n('', 'rows')}, {big('sum(c)', 'copies')} FROM (SELECT {CONTENT}, min(source_file) AS source_file, count(*) AS c FROM stat_flows GROUP BY ALL) GROUP BY 1", "stat_flows")
def d8(spark, sf):
    """Exact deduplication across files, first file kept, copies counted."""
    kept = clean.drop_exact_duplicates(views.statistics_flows(spark, sf))
    return plain(kept.groupBy("source_file").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")))


def _profile_sql() -> str:
    cols = {
        "l_orderkey": ("bigint", "l_orderkey"),
        "l_quantity": ("double", "l_quantity"),
        "Flow Bytes/s": ("double", "bytes_s"),
        "Flow Packets/s": ("double", "packets_s"),
        " Label": ("string", "canonical_label"),
        "flat": ("int", "7"),
    }
    parts = []
    for name, (kind, e) in cols.items():
        number = kind == "double"
        missing = f"({e} IS NULL OR isnan({e}))" if number else f"({e} IS NULL)"
        inf = f"isinf({e})" if number else "false"
        odd = f"(NOT {missing} AND try_cast({e} AS DOUBLE) IS NULL)" if kind == "string" else "false"
        value = f"nullif({e}, CAST('nan' AS DOUBLE))" if number else e
        parts.append(
            f"""SELECT '{name}' AS "column", '{kind}' AS dtype, {'true' if name != name.strip() else 'false'} AS has_stray_whitespace, {n(missing, 'missing_count')},
              round(100.0 * count(*) FILTER (WHERE {missing}) / count(*), 4) + 0.0 AS missing_pct, {n(inf, 'infinite_count')},
              CAST(count(DISTINCT {value}) AS BIGINT) AS unique_count, count(DISTINCT {value}) <= 1 AS is_constant, {n(odd, 'unparseable_count')},
              {'count(*) FILTER (WHERE ' + odd + ') BETWEEN 1 AND count(*) - 1' if kind == 'string' else 'false'} AS mixed_numeric FROM stat_flows"""
        )
    return "\nUNION ALL ".join(parts)


@query("d9", _profile_sql(), "stat_flows")
def d9(spark, sf):
    """Per-column profile from one unpivot."""
    s = views.statistics_flows(spark, sf)
    shown = s.select("l_orderkey", "l_quantity", "Flow Bytes/s", "Flow Packets/s", F.col("canonical_label").alias(" Label"), F.lit(7).alias("flat"))
    return plain(profile.column_profile(shown))


@query("d10", f"SELECT {big('sum(c - 1)', 'duplicate_rows')}, {big('sum(c)', 'rows')} FROM (SELECT {CONTENT}, count(*) AS c FROM stat_flows GROUP BY ALL)", "stat_flows")
def d10(spark, sf):
    """Fully duplicate rows."""
    return plain(clean.duplicate_row_count(views.statistics_flows(spark, sf).drop("source_file")))


RAW_COLS = ("Source Port", "Total Length of Fwd Packets", "Label")


@query(
    "d11",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", {n('', 'rows')}, {n(f'"{c}" IS NOT NULL AND try_cast("{c}" AS DOUBLE) IS NULL', 'unparseable_count')},
          count(*) FILTER (WHERE "{c}" IS NOT NULL AND try_cast("{c}" AS DOUBLE) IS NULL) BETWEEN 1 AND count(*) - 1 AS mixed_numeric FROM raw_flows"""
        for c in RAW_COLS
    ),
    "raw_flows",
)
def d11(spark, sf):
    """Text columns that mostly parse as numbers."""
    return plain(profile.mixed_numeric_columns(views.raw_flows(spark, sf), RAW_COLS))


@query("d12", f"""SELECT "Label" AS label, {n()} FROM raw_flows GROUP BY 1""", "raw_flows")
def d12(spark, sf):
    """Label distribution, NULL counted, the column found by name."""
    return plain(profile.label_distribution(views.raw_flows(spark, sf)))


def _issue(check: str, column: str, bad: str) -> str:
    return f"""SELECT source_file, '{check}' AS "check", coalesce("{column}", 'nan') AS value FROM raw_flows WHERE {bad}"""


@query(
    "d13",
    f"""WITH bad AS ({_issue('Source IP: malformed IP address', 'Source IP', 'NOT ' + valid_ip('"Source IP"'))}
      UNION ALL {_issue('Destination IP: malformed IP address', 'Destination IP', 'NOT ' + valid_ip('"Destination IP"'))}
      UNION ALL {_issue('invalid Source Port (outside 0-65535 or non-integer)', 'Source Port', 'NOT ' + valid_port('"Source Port"'))}
      UNION ALL {_issue('invalid Destination Port (outside 0-65535 or non-integer)', 'Destination Port', 'NOT ' + valid_port('"Destination Port"'))}
      UNION ALL {_issue('unexpected protocol value (not in {0,1,2,6,17,41,47,50,51,58,132})', 'Protocol',
                        'NOT coalesce(try_cast("Protocol" AS DOUBLE) IN (0,1,2,6,17,41,47,50,51,58,132), false)')}
      UNION ALL {_issue('unparseable timestamp', 'Timestamp', '"Timestamp" IS NOT NULL AND ' + month_first('"Timestamp"') + ' IS NULL')}),
    sizes AS (SELECT source_file, count(*) AS rows FROM raw_flows GROUP BY 1),
    dup AS (SELECT source_file, sum(c - 1) AS issue_count FROM (SELECT *, count(*) AS c FROM raw_flows GROUP BY ALL) GROUP BY 1)
    SELECT b.source_file, b."check", {n('', 'issue_count')}, round(100.0 * count(*) / any_value(s.rows), 4) + 0.0 AS pct,
      array_to_string(list_sort(list(DISTINCT b.value))[1:5], ',') AS examples FROM bad b JOIN sizes s ON s.source_file = b.source_file GROUP BY 1, 2
    UNION ALL SELECT d.source_file, 'fully duplicate rows', CAST(d.issue_count AS BIGINT), round(100.0 * d.issue_count / s.rows, 4) + 0.0, ''
      FROM dup d JOIN sizes s ON s.source_file = d.source_file WHERE d.issue_count > 0""",
    "raw_flows",
)
def d13(spark, sf):
    """Validation issues per file with up to five examples."""
    return plain(profile.topology_issues(views.raw_flows(spark, sf)))


@query(
    "d14",
    "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", {n(f'"{c}" IS NULL', 'missing_count')} FROM raw_flows""" for c in clean.TOPOLOGY_COLUMNS),
    "raw_flows",
)
def d14(spark, sf):
    """Missing values by column, only columns that have some."""
    return plain(profile.missing_by_column(views.raw_flows(spark, sf)))


NUMERIC = (*views.FEATURES, "flat")


def _variance(c: str, e: str) -> str:
    return f"""SELECT '{c}' AS "column", {r(f'var_pop({e})', 'variance', 3)}, min({e}) = max({e}) AS zero_variance FROM s WHERE split = 'train'"""


@query("d15", f"WITH s AS ({SPLIT_CTE}) " + "\nUNION ALL ".join(_variance(c, "7" if c == "flat" else c) for c in NUMERIC), "flows")
def d15(spark, sf):
    """Zero-variance columns of the training split."""
    f = split.stratified_split(views.flows(spark, sf).withColumn("flat", F.lit(7)), "canonical_label", F.col("event_id"))
    return plain(profile.variance_profile(f.filter("split = 'train'"), NUMERIC), 3)


@query(
    "d16",
    f"""SELECT 'l_quantity' AS "left", 'copy' AS "right", 'exact' AS kind, 1.0 AS correlation, {big('0', 'mismatch_count')}, 0.0 AS mismatch_pct
    UNION ALL SELECT p, 'near', 'near', round(corr(l_quantity, near), 6), CAST(count(*) FILTER (WHERE l_quantity <> near) AS BIGINT),
      round(100.0 * count(*) FILTER (WHERE l_quantity <> near) / count(*), 6)
    FROM (SELECT l_quantity, l_quantity + CASE WHEN l_orderkey % 1000 = 0 THEN 1.0 ELSE 0.0 END AS near FROM lineitem), (SELECT unnest(['l_quantity', 'copy']) AS p) GROUP BY p""",
)
def d16(spark, sf):
    """Redundant column pairs: candidates by correlation, proof on every row."""
    f = views.flows(spark, sf)
    q = F.col("l_quantity")
    wide = f.select("event_id", "l_quantity", q.alias("copy"), (q + F.when(F.col("l_orderkey") % 1000 == 0, 1.0).otherwise(0.0)).alias("near"), "l_tax", F.lit(7.0).alias("flat"))
    return plain(profile.redundant_pairs(wide, ["l_quantity", "copy", "near", "l_tax", "flat"]))


@query(
    "d18",
    f"WITH s AS ({SPLIT_CTE}) "
    + "\nUNION ALL ".join(f"SELECT {big(str(i), 'position')}, '{c}' AS feature, {r(f'avg({c})', 'mean', 4)}, {r(f'stddev_pop({c})', 'scale', 4)} FROM s WHERE split = 'train'" for i, c in enumerate(views.FEATURES)),
    "flows",
)
def d18(spark, sf):
    """Scaler fitted on the training split only."""
    f = split.stratified_split(views.flows(spark, sf), "canonical_label", F.col("event_id"))
    return plain(profile.scaler_table(f.filter("split = 'train'"), views.FEATURES), 4)


@query(
    "d18_scaled",
    f"""WITH s AS ({SPLIT_CTE}), p AS (SELECT {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS d{i}' for i, c in enumerate(views.FEATURES))} FROM s WHERE split = 'train')
    SELECT event_id, split, {', '.join(r(f'(s.{c} - p.m{i}) / p.d{i}', c) for i, c in enumerate(views.FEATURES))} FROM s, p""",
    "flows",
)
def d18_scaled(spark, sf):
    """All splits transformed with the training scaler."""
    f = split.stratified_split(views.flows(spark, sf), "canonical_label", F.col("event_id"))
    scaler = profile.scaler_table(f.filter("split = 'train'"), views.FEATURES)
    return plain(profile.scale_columns(f, scaler, views.FEATURES).select("event_id", "split", *views.FEATURES))


@query("d19", f"SELECT {n('', 'rows')}, {big('count(*) FILTER (WHERE isinf(bytes_s) OR isnan(bytes_s)) + count(*) FILTER (WHERE isinf(packets_s))', 'bad_cells')} FROM stat_flows", "stat_flows")
def d19(spark, sf):
    """Non-finite cells of a feature matrix (0 is what the assertion wants)."""
    return plain(clean.non_finite_count(views.statistics_flows(spark, sf), ("Flow Bytes/s", "Flow Packets/s")))


@query(
    "d20",
    f"""SELECT {n("canonical_label = 'BENIGN'", 'benign_count')}, {n("canonical_label <> 'BENIGN'", 'attack_count')}, {n('', 'total_count')},
      round(100.0 * count(*) FILTER (WHERE canonical_label = 'BENIGN') / count(*), 4) AS benign_pct,
      round(100.0 * count(*) FILTER (WHERE canonical_label <> 'BENIGN') / count(*), 4) AS attack_pct FROM flows""",
    "flows",
)
def d20(spark, sf):
    return plain(profile.class_distribution(views.flows(spark, sf)))


# --- splits and samples ------------------------------------------------------
@query("i1", f"SELECT event_id, split FROM ({SPLIT_CTE})", "flows")
def i1(spark, sf):
    """Stratified 70/15/15 split, exact per class."""
    return split.stratified_split(views.flows(spark, sf), "canonical_label", F.col("event_id")).select("event_id", "split")


@query(
    "i2",
    f"""SELECT canonical_label, split, {n()} FROM (SELECT canonical_label, CASE WHEN c < 2 OR rk <= round(c * 0.5) THEN 'validation' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY canonical_label ORDER BY md5('7|' || event_id)) AS rk, count(*) OVER (PARTITION BY canonical_label) AS c FROM flows)) GROUP BY 1, 2""",
    "flows",
)
def i2(spark, sf):
    """Fresh stratified halves."""
    h = split.half_split(views.flows(spark, sf), "canonical_label", F.col("event_id"), seed=7)
    return plain(h.groupBy("canonical_label", "split").agg(F.count("*").alias("n")))


@query(
    "i3",
    """SELECT event_id, canonical_label FROM (SELECT *, row_number() OVER (PARTITION BY canonical_label ORDER BY md5('42|' || event_id)) AS rk FROM flows)
    WHERE rk <= 20 ORDER BY md5('42|' || event_id) LIMIT 100""",
    "flows",
)
def i3(spark, sf):
    """Up to 20 rows per class, then at most 100 in all."""
    return split.per_class_sample(views.flows(spark, sf), "canonical_label", F.col("event_id"), 20, 100).select("event_id", "canonical_label")


@query("i4", "SELECT event_id FROM flows ORDER BY md5('42|' || event_id) LIMIT 2000", "flows")
def i4(spark, sf):
    """Fixed-size sample in a fixed pseudo-random order."""
    return profile.fixed_sample(views.flows(spark, sf), F.col("event_id"), 2000).select("event_id")


# --- schemas and leakage -----------------------------------------------------
@query("g1", "SELECT true AS consistent, CAST(12 AS BIGINT) AS column_count UNION ALL SELECT false, 11")
def g1(spark, sf):
    """Cross-file schema consistency of written files, some of which lack a column."""
    headers = written_layouts(spark, sf, "g1")
    return profile.schema_consistency(headers).groupBy("column_count").agg(F.bool_and("consistent").alias("consistent"))


LEFT_COLUMNS = {c: c for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "canonical_label", "source_file")} | {"Flow Bytes/s": "bytes_s", "Flow Packets/s": "packets_s"}
RIGHT_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _filled(columns: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS c, count({c}) AS filled FROM {source}" for name, c in columns.items())


@query(
    "g2",
    f"""SELECT coalesce(a.c, b.c) AS "column", CASE WHEN a.c IS NULL THEN 'only_right' WHEN b.c IS NULL THEN 'only_left' ELSE 'shared' END AS side,
      a.filled AS left_filled, b.filled AS right_filled
    FROM ({_filled(LEFT_COLUMNS, 'stat_flows')}) a FULL JOIN ({_filled({c: c for c in RIGHT_COLUMNS}, 'lineitem')}) b ON a.c = b.c""",
    "stat_flows",
)
def g2(spark, sf):
    """Shared and one-sided columns of two tables, and how far each is filled."""
    return plain(profile.schema_difference(views.statistics_flows(spark, sf), views.table(spark, sf, "lineitem")))


@query(
    "g3",
    """SELECT unnest(['metadata_columns_in_features', 'attack_rows_in_benign_set', 'scaler_refit', 'train_keys_in_test']) AS "check", CAST(0 AS BIGINT) AS violations""",
)
def g3(spark, sf):
    """Leakage checks over a real split; all counts must be 0."""
    f = split.stratified_split(views.flows(spark, sf), "canonical_label", F.col("event_id"))
    train, test = f.filter("split = 'train'"), f.filter("split = 'test'")
    scaler = profile.scaler_table(train, views.FEATURES)
    return profile.leakage_report(views.FEATURES, clean.benign_training_rows(train), train, test, ["event_id"], scaler, scaler)
