"""Scans, sinks and their round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import clean, graph, profile
from flowloom.operators.split import stratified_split
from flowloom.operators.validate import explode_connections
from flowloom.plans import views
from flowloom.plans.oracle import EDGE_OUT, big, n, r, ts
from flowloom.plans.registry import query
from flowloom.plans.views import plain
from flowloom.schemas import TOPOLOGY_COLUMNS
from flowloom.session import freed_shuffles, shared_dir
from flowloom.sources import tables


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _with_raw_header(raw: DataFrame) -> DataFrame:
    """Header quirks of the export: leading blanks and a name that occurs twice."""
    named = {c: f" {c}" for c in ("Source IP", "Source Port", "Destination IP", "Destination Port", "Protocol", "Label")}
    twice = raw.withColumns({"Fwd Header Length": F.lit("20"), " Fwd Header Length": F.lit("20")})
    return twice.withColumnsRenamed(named).drop("source_file")


def raw_csv_writer(df: DataFrame):
    return df.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false")


def written_csvs(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = scratch(spark, name)
    raw_csv_writer(_with_raw_header(views.raw_flows(spark, sf_dir))).csv(path)
    return path


def written_layouts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Headers of files of two layouts: those of the last capture lack the label."""
    path, raw = scratch(spark, name), _with_raw_header(views.raw_flows(spark, sf_dir))
    raw_csv_writer(raw).csv(f"{path}/a")
    raw_csv_writer(raw.drop(" Label").limit(1000)).csv(f"{path}/b")
    return profile.header_table(tables.csv_files(spark, path, recursive=True))


LABEL_COUNTS = f"""SELECT "Label" AS label, "Protocol" AS protocol, {n()}, {n('"Source IP" IS NULL', 'blank')} FROM raw_flows GROUP BY 1, 2"""


def _label_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy(F.col("Label").alias("label"), F.col("Protocol").alias("protocol")).agg(
        F.count("*").alias("n"), F.count_if(F.col("`Source IP`").isNull()).alias("blank")
    )


@query("a1", LABEL_COUNTS, "raw_flows")
def a1(spark, sf):
    """Multi-file CSV scan: headers stripped, repeated header dropped, file tagged."""
    raw = tables.read_flow_csvs(spark, written_csvs(spark, sf, "a1"))
    assert "Fwd Header Length.1" not in raw.columns and "source_file" in raw.columns
    return plain(_label_counts(raw))


@query(
    "a2",
    f"""SELECT canonical_label, encoding, {n()} FROM (
      SELECT canonical_label, CASE WHEN source_file = 'capture_1.csv' THEN 'latin1' ELSE 'utf-8' END AS encoding FROM flows) GROUP BY 1, 2""",
    "flows",
)
def a2(spark, sf):
    """Per-file encoding: UTF-8 if the whole file decodes, else Latin-1."""
    path = scratch(spark, "a2")
    raw = views.raw_flows(spark, sf).filter(~clean.is_blank(TOPOLOGY_COLUMNS))
    old = raw.filter("source_file = 'capture_1.csv'").withColumn("Label", F.translate("Label", "�", "\x96"))
    raw_csv_writer(_with_raw_header(old)).option("encoding", tables.LATIN1).csv(f"{path}/old")
    raw_csv_writer(_with_raw_header(raw.filter("source_file <> 'capture_1.csv'"))).csv(f"{path}/new")
    seen = tables.csv_files(spark, path, recursive=True).select("source_path", "encoding")
    rows = tables.read_flow_csvs(spark, path, recursive=True, columns=["Label"], with_path=True)
    labelled = rows.withColumn("canonical_label", clean.canonical_label("Label"))
    return plain(labelled.join(seen, "source_path").groupBy("canonical_label", "encoding").agg(F.count("*").alias("n")))


@query(
    "a3",
    'SELECT "Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port", "Protocol", "Timestamp", '
    '"Total Length of Fwd Packets", "Total Length of Bwd Packets", "Label" FROM raw_flows',
    "raw_flows",
)
def a3(spark, sf):
    """Column-pruned scan by stripped name."""
    return clean.require_columns(views.raw_flows(spark, sf), TOPOLOGY_COLUMNS)


def packet_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Packets as JSON lines, some cut short, incomplete or of another type."""
    p = views.packets(spark, sf)
    k = F.col("seq")
    fields = [c for c in p.columns if c not in ("ts", "seq", "dst_ip")]
    record = F.struct(
        F.when(k % 47 == 0, "ready").when(k % 53 == 0, "parse_error").otherwise("packet").alias("type"),
        (F.unix_micros("ts") / 1e6).alias("timestamp"),
        F.when(k % 43 != 0, F.col("dst_ip")).alias("dst_ip"),
        F.lit(20).alias("ip_header_length"),
        *fields,
    )
    text = F.to_json(record)
    return p.select(F.when(k % 41 == 0, F.substring(text, 1, 15)).otherwise(text).alias("value"), "seq")


@query(
    "a5",
    f"""SELECT {n('', 'lines')}, {n("kind = 'packet'", 'packets_received')}, {n("kind = 'malformed_line'", 'malformed_lines')},
      {n("kind = 'malformed_packet'", 'malformed_packets')}, {n("kind IN ('malformed_line', 'malformed_packet', 'parse_error')", 'parse_errors')}
    FROM (SELECT CASE WHEN seq % 41 = 0 THEN 'malformed_line' WHEN seq % 47 = 0 THEN 'other' WHEN seq % 53 = 0 THEN 'parse_error'
                      WHEN seq % 43 = 0 THEN 'malformed_packet' ELSE 'packet' END AS kind FROM packets)""",
    "packets",
)
def a5(spark, sf):
    """Packet JSON lines: parsed, malformed and other records counted."""
    return plain(tables.packet_line_counts(tables.parse_packet_lines(packet_lines(spark, sf))))


@query("a7_nodes", "SELECT * FROM nodes", "nodes")
def a7_nodes(spark, sf):
    return plain(tables.node_export(graph.build_nodes(views.edges(spark, sf))))


@query("a7", f"SELECT {EDGE_OUT.replace(chr(39) + ',' + chr(39), chr(39) + ';' + chr(39))} FROM edges", "edges")
def a7(spark, sf):
    """Edge table export with list fields joined by ``;``."""
    return plain(tables.edge_export(views.edges(spark, sf)))


SPLIT_CASE = """CASE WHEN c < 4 THEN 'train' WHEN rk <= round(c * 0.7) THEN 'train' WHEN rk <= round(c * 0.85) THEN 'val' ELSE 'test' END"""
SPLIT_CTE = f"""SELECT *, {SPLIT_CASE} AS split FROM (SELECT *, row_number() OVER (PARTITION BY canonical_label ORDER BY md5('42|' || event_id)) AS rk,
    count(*) OVER (PARTITION BY canonical_label) AS c FROM flows)"""


@query(
    "a8",
    f"""WITH s AS ({SPLIT_CTE}), fit AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM s WHERE split = 'train')
    SELECT split, {n()}, {r('sum((l_quantity - m) / d)', 'total', 4)} FROM s, fit GROUP BY split""",
    "flows",
)
def a8(spark, sf):
    """Processed split sink: scaled features with metadata per row, read back per split."""
    rows = stratified_split(views.flows(spark, sf), "canonical_label", F.col("event_id"))
    rows = rows.select("split", "canonical_label", "source_file", "dst_port", *[F.col(c).cast("double").alias(c) for c in views.FEATURES])
    scaler = profile.scaler_table(rows.filter("split = 'train'"), views.FEATURES)
    path = scratch(spark, "a8")
    tables.write_split(profile.scale_columns(rows, scaler, views.FEATURES), scaler, path)
    stored = tables.read_split(spark, path, "train")
    for name in ("val", "test"):
        stored = stored.unionByName(tables.read_split(spark, path, name))
    return plain(stored.groupBy("split").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total")), 4)


@query(
    "a9",
    f"""WITH acc AS (SELECT source_file, {n('', 'raw_rows')}, {n("reject_reason = 'blank'", 'blank_rows')}, {n("reject_reason = 'ip'", 'invalid_ip_rows')},
        {n("reject_reason = 'port'", 'invalid_port_rows')}, {n("reject_reason = 'timestamp'", 'invalid_timestamp_rows')}, {n('reject_reason IS NULL', 'valid_rows')}
      FROM marked GROUP BY source_file)
    SELECT 'cleaning' AS section, source_file AS key, metric, CAST(value AS VARCHAR) AS value
      FROM (UNPIVOT acc ON raw_rows, blank_rows, invalid_ip_rows, invalid_port_rows, invalid_timestamp_rows, valid_rows INTO NAME metric VALUE value)
    UNION ALL SELECT 'labels', canonical_label, 'n', CAST(count(*) AS VARCHAR) FROM clean GROUP BY canonical_label""",
    "marked clean",
)
def a9(spark, sf):
    """Run metrics as one table of (section, key, metric, value)."""
    from flowloom.operators.dashboard import metric_rows

    raw = views.raw_flows(spark, sf)
    labels = clean.clean_flows(raw).groupBy("canonical_label").agg(F.count("*").alias("n"))
    return metric_rows("cleaning", clean.reject_accounting(raw), "source_file").unionByName(
        metric_rows("labels", labels, "canonical_label")
    )


STATISTICS = f"""SELECT {big('(SELECT count(*) FROM stat_flows)', 'rows_before_dedup')},
      {big('(SELECT count(*) FROM stat_flows) - (SELECT count(*) FROM d)', 'exact_duplicate_rows')}, {big('(SELECT count(*) FROM d)', 'rows_after_dedup')},
      {big('(SELECT count(*) FROM d WHERE NOT isinf(bytes_s) AND NOT isnan(bytes_s) AND NOT isinf(packets_s))', 'rows_after_inf_nan')}
""".replace("FROM d", "FROM (SELECT DISTINCT * EXCLUDE (source_file) FROM stat_flows)")


@query("a9_stats", STATISTICS, "stat_flows")
def a9_stats(spark, sf):
    """Dataset statistics roll-up of the cleaning job."""
    s = views.statistics_flows(spark, sf)
    dedup = clean.drop_exact_duplicates(s)
    rows = dedup.agg(F.sum("copies").alias("rows_before_dedup"), F.count("*").alias("rows_after_dedup"))
    kept = clean.infinite_to_null(dedup, ("Flow Bytes/s", "Flow Packets/s")).na.drop("any", subset=["`Flow Bytes/s`", "`Flow Packets/s`"])
    out = rows.select(
        "rows_before_dedup",
        (F.col("rows_before_dedup") - F.col("rows_after_dedup")).alias("exact_duplicate_rows"),
        "rows_after_dedup",
        kept.agg(F.count("*")).scalar().alias("rows_after_inf_nan"),
    )
    return plain(out)


@query(
    "a10",
    f"""SELECT 'v1' AS graph_version, {n('', 'edges')}, {big('sum(flow_count)', 'flows')} FROM edges
    UNION ALL SELECT 'v2', count(*), CAST(sum(flow_count) AS BIGINT) FROM edges WHERE attack_flow_count > 0""",
    "edges",
)
def a10(spark, sf):
    """Versioned graph snapshot: replacing one version leaves the other."""
    path, stored = scratch(spark, "a10"), scratch(spark, "a10-edges")
    # six tables are written from the edges: the flows are aggregated once
    views.edges(spark, sf).write.parquet(stored)
    edges = spark.read.parquet(stored)
    nodes = graph.build_nodes(edges)
    attack_nodes, attack_edges = graph.min_attack_threshold(nodes, edges, 1)
    tables.replace_graph(attack_nodes, attack_edges, path, "v1")
    tables.replace_graph(attack_nodes, attack_edges, path, "v2")
    tables.replace_graph(nodes, edges, path, "v1")
    stored = tables.read_graph(spark, path, "edges")
    return plain(stored.groupBy("graph_version").agg(F.count("*").alias("edges"), F.sum("flow_count").alias("flows")))


@query(
    "a11",
    f"""SELECT e.event_uid, {r('t.anomaly_score', 'anomaly_score')}, t.is_anomaly, {r('x.risk_score', 'risk_score')}, x.risk_level
    FROM ev e JOIN tagged t ON t.event_id = e.id JOIN explained x ON x.event_id = e.id""",
    "ev explained",
)
def a11(spark, sf):
    """Scored events fan out to three stored tables under one key."""
    path, once = scratch(spark, "a11"), scratch(spark, "a11-scored")
    with freed_shuffles(spark):
        views.scored(spark, sf).select(*views.EVENT_COLUMNS, "factors", "reason", "config_version").write.option("compression", "zstd").parquet(once)
    tables.write_scored(spark.read.parquet(once), path, "batch-1")  # three sinks read what is scored once
    return plain(tables.read_scored(spark, path))


@query(
    "a12",
    f"""SELECT 'events' AS part, {n()} FROM ev WHERE source <> 'offline_demo'
    UNION ALL SELECT 'detections', count(*) FROM det WHERE event_id NOT IN (SELECT id FROM ev WHERE source = 'offline_demo')
    UNION ALL SELECT 'risks', count(*) FROM risk WHERE event_id NOT IN (SELECT id FROM ev WHERE source = 'offline_demo')""",
    "ev det risk",
)
def a12(spark, sf):
    """Clearing one source before re-ingestion, children included."""
    events, detections, risks = views.relational(spark, sf)
    kept = tables.without_source(events, [detections, risks])
    out = None
    for name, t in zip(("events", "detections", "risks"), kept):
        c = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = c if out is None else out.unionAll(c)
    return plain(out)


CONN = "agent_id, " + ts("collected_at") + ", hostname, local_ip, local_port, coalesce(remote_ip, '') AS remote_ip, coalesce(remote_port, -1) AS remote_port, protocol, coalesce(status, '') AS status"


def _shown_connections(c: DataFrame) -> DataFrame:
    return plain(c.fillna("", ["remote_ip", "status"]).fillna(-1, ["remote_port"]))


@query("a13", f"SELECT {CONN} FROM conns", "conns")
def a13(spark, sf):
    """Telemetry batches to one row per connection."""
    return _shown_connections(explode_connections(views.telemetry_batches(spark, sf)))


EVENT_OUT = f"id, event_uid, {ts('timestamp')}, source_ip, source_port, destination_ip, destination_port, protocol, canonical_attack_label, traffic_class, source, status, {ts('created_at')}"


@query("a14", f"SELECT {EVENT_OUT} FROM ev", "ev")
def a14(spark, sf):
    events, _, _ = views.relational(spark, sf)
    return plain(events.orderBy(F.desc("timestamp"), F.desc("id")))


@query("a15", f"SELECT id, event_id, detection_id, {r('risk_score', 'risk_score')}, risk_level, reason, {ts('created_at')} FROM risk", "risk")
def a15(spark, sf):
    _, _, risks = views.relational(spark, sf)
    cols = ["id", "event_id", "detection_id", "risk_score", "risk_level", "reason", "created_at"]
    return plain(risks.select(*cols).orderBy(F.desc("risk_score"), F.desc("id")))


ACT_OUT = f"id, event_id, source_ip, {r('risk_score', 'risk_score')}, risk_level, requested_action, actual_action, dry_run, success, reason, adapter, target_scope, {ts('created_at')}"


@query("a16", f"SELECT {ACT_OUT} FROM act", "act")
def a16(spark, sf):
    return plain(views.actions(spark, sf).orderBy(F.desc("created_at"), F.desc("id")))


@query(
    "a17",
    f"""SELECT id, component, content_hash, {r('f1', 'f1')}, '{{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}}' AS metrics,
      {ts('created_at')} FROM run_log""",
    "run_log",
)
def a17(spark, sf):
    """Model-run export; map columns as JSON."""
    from flowloom.operators.runs import changed_runs

    log = changed_runs(views.run_records(spark, sf))
    return plain(tables.map_to_json(log).orderBy(F.desc("created_at"), F.desc("id")))
