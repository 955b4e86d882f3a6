"""Listings, relational joins, dashboard roll-ups, run logs and agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import dashboard, runs
from flowloom.plans import views
from flowloom.plans.oracle import big, n, r, ts
from flowloom.plans.q_risk import LATEST, edge_versions
from flowloom.plans.q_sources import ACT_OUT, scratch
from flowloom.plans.registry import query
from flowloom.plans.views import plain

FEED = f"""SELECT e.id AS event_id, e.timestamp, e.source_ip, e.source_port, e.destination_ip, e.destination_port, e.protocol, e.canonical_attack_label,
  d.anomaly_score, d.is_anomaly, x.risk_score, x.risk_level, e.source AS event_source FROM ev e LEFT JOIN det d ON d.event_id = e.id LEFT JOIN risk x ON x.event_id = e.id"""
FEED_OUT = f"event_id, {ts('timestamp')}, source_ip, source_port, destination_ip, destination_port, protocol, canonical_attack_label, {r('anomaly_score', 'anomaly_score')}, is_anomaly, {r('risk_score', 'risk_score')}, risk_level, event_source"


@query("c2", f"SELECT {FEED_OUT} FROM ({FEED} ORDER BY e.timestamp DESC, e.id DESC LIMIT 50 OFFSET 5)", "ev det risk")
def c2(spark, sf):
    """Threat feed: events with detection and risk where present."""
    return plain(dashboard.threat_feed(*views.relational(spark, sf), limit=50, offset=5))


@query("c2_min", f"SELECT {FEED_OUT} FROM ({FEED} WHERE x.risk_score >= 5.0 ORDER BY e.timestamp DESC, e.id DESC LIMIT 50)", "ev det risk")
def c2_min(spark, sf):
    """Threat feed with a minimum risk score (the outer join becomes inner)."""
    return plain(dashboard.threat_feed(*views.relational(spark, sf), min_risk_score=5.0))


@query(
    "c3",
    f"""SELECT d.id AS detection_id, d.event_id, e.event_uid, {ts('e.timestamp')}, e.source_ip, e.destination_ip, {r('d.anomaly_score', 'anomaly_score')},
      {r('d.reconstruction_error', 'reconstruction_error')}, {r('d.threshold_used', 'threshold_used')}, e.canonical_attack_label
    FROM det d JOIN ev e ON e.id = d.event_id WHERE d.is_anomaly""",
    "det ev",
)
def c3(spark, sf):
    events, detections, _ = views.relational(spark, sf)
    return plain(dashboard.anomaly_export(events, detections).orderBy(F.desc("detection_id")))


@query(
    "c4",
    f"""SELECT x.id AS risk_assessment_id, x.event_id, e.event_uid, {ts('e.timestamp')}, e.source_ip, e.destination_ip, {r('x.risk_score', 'risk_score')}, x.risk_level, x.reason
    FROM risk x JOIN ev e ON e.id = x.event_id WHERE x.risk_level IN ('High', 'Critical')""",
    "risk ev",
)
def c4(spark, sf):
    events, _, risks = views.relational(spark, sf)
    return plain(dashboard.alert_export(events, risks).orderBy(F.desc("risk_score"), F.desc("risk_assessment_id")))


SHOWN = "edge_attack_ratio edge_attack_flow_count edge_flow_count edge_first_seen edge_last_seen edge_attack_label_count".split()


@query(
    "c6",
    f"""WITH {LATEST} SELECT e.id AS event_id, e.source, {r('d.anomaly_score', 'anomaly_score')}, {r('x.risk_score', 'risk_score')}, x.risk_level,
      {', '.join(f"CASE WHEN e.source <> 'live' THEN {c} END AS {c}" if 'seen' not in c else ts(f"CASE WHEN e.source <> 'live' THEN {c} END", c) for c in SHOWN)}
    FROM ev e LEFT JOIN det d ON d.event_id = e.id LEFT JOIN risk x ON x.event_id = e.id LEFT JOIN latest l ON l.src_ip = e.source_ip AND l.dst_ip = e.destination_ip""",
    "edges ev det risk",
)
def c6(spark, sf):
    """Event detail; context withheld for live events."""
    d = dashboard.event_details(*views.relational(spark, sf), edge_versions(spark, sf))
    return plain(d.select("event_id", "source", "anomaly_score", "risk_score", "risk_level", *SHOWN))


@query(
    "c9",
    f"""SELECT {big("(SELECT count(*) FROM ev WHERE source = 'live')", 'total_live_events')},
      {big("(SELECT count(*) FROM det d JOIN ev e ON e.id = d.event_id WHERE e.source = 'live' AND d.is_anomaly)", 'detected_anomalies')},
      {big("(SELECT count(*) FROM act a JOIN ev e ON e.id = a.event_id WHERE e.source = 'live' AND a.actual_action = 'alerted')", 'alerts')},
      {big("(SELECT count(*) FROM act a JOIN ev e ON e.id = a.event_id WHERE e.source = 'live' AND a.actual_action IN ('blocked', 'would_block'))", 'threats_prevented_or_would_block')},
      {r("(SELECT avg(x.risk_score) FROM risk x JOIN ev e ON e.id = x.event_id WHERE e.source = 'live')", 'average_risk_score')}""",
    "ev det risk act",
)
def c9(spark, sf):
    """Live-only statistics over all four tables, of flows that are scored once."""
    path = scratch(spark, "c9")
    views.scored(spark, sf, explained=False).select(*views.EVENT_COLUMNS).write.parquet(path)
    known = spark.read.parquet(path)
    return plain(dashboard.live_statistics(*views.relational(spark, sf, known), views.actions(spark, sf, known)))


@query(
    "d40",
    f"""SELECT {big('(SELECT count(*) FROM ev)', 'total_events')}, {big('(SELECT count(*) FROM det WHERE is_anomaly)', 'active_threats')},
      {big('(SELECT count(*) FROM risk WHERE risk_score >= 7.0)', 'high_risk_events')}, {big('(SELECT count(*) FROM det WHERE is_anomaly)', 'anomaly_count')},
      {big("(SELECT count(*) FROM ev WHERE traffic_class = 'BENIGN')", 'benign_count')}, {ts('(SELECT max(created_at) FROM ev)', 'last_ingested_at')}, 'operational' AS system_health""",
    "ev det risk",
)
def d40(spark, sf):
    return plain(dashboard.summary(*views.relational(spark, sf)))


@query("d41", f"SELECT canonical_attack_label AS attack_type, {n()} FROM ev WHERE canonical_attack_label <> 'BENIGN' GROUP BY 1", "ev")
def d41(spark, sf):
    return plain(dashboard.attacks_by_type(views.relational(spark, sf)[0]))


@query("d42", f"SELECT {ts('bucket')}, {n('', 'event_count')}, {n('attack', 'attack_count')} FROM (SELECT date_trunc('hour', timestamp) AS bucket, traffic_class = 'ATTACK' AS attack FROM ev) GROUP BY bucket", "ev")
def d42(spark, sf):
    """Hourly timeline of events and attacks."""
    return plain(dashboard.timeline(views.relational(spark, sf)[0]))


@query("d45", f"SELECT 'action' AS part, actual_action AS key, {n()} FROM act GROUP BY 2 UNION ALL SELECT 'nodes', '', count(*) FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges", "act nodes edges")
def d45(spark, sf):
    """Response actions by outcome, node and edge totals."""
    from flowloom.operators.graph import build_nodes

    edges = views.edges(spark, sf)
    counts = dashboard.action_counts(views.actions(spark, sf)).select(F.lit("action").alias("part"), F.col("actual_action").alias("key"), "n")
    for name, t in (("nodes", build_nodes(edges)), ("edges", edges)):
        counts = counts.unionAll(t.agg(F.count("*").alias("n")).select(F.lit(name), F.lit(""), "n"))
    return plain(counts)


LEVELS = ("Very Low", "Low", "Moderate", "High", "Critical")


@query(
    "d47",
    f"""SELECT {n('', 'flows')}, {n('l_orderkey % 7 <> 0', 'valid_flows')}, {n('l_orderkey % 7 = 0', 'skipped_flows')},
      {n('l_orderkey % 7 <> 0 AND is_anomaly', 'anomaly_count')}, {n('l_orderkey % 7 <> 0 AND NOT is_anomaly', 'normal_count')},
      {', '.join(n(f"l_orderkey % 7 <> 0 AND risk_level = '{x}'", 'level_' + x.lower().replace(' ', '_')) for x in LEVELS)},
      {n('l_orderkey % 7 <> 0 AND edge_flow_count IS NOT NULL', 'context_obtained')} FROM scored""",
    "scored",
)
def d47(spark, sf):
    """Live scoring summary with skipped flows and context coverage."""
    s = views.scored(spark, sf, explained=False).withColumn("valid", F.col("l_orderkey") % 7 != 0)
    return plain(dashboard.live_scoring_summary(s))


# --- run logs ----------------------------------------------------------------
@query("e5", "SELECT id, component, content_hash FROM run_log", "run_log")
def e5(spark, sf):
    """Append-only run log: a row only when the content changed."""
    return runs.changed_runs(views.run_records(spark, sf)).select("id", "component", "content_hash")


@query("e9", f"SELECT component, id, {r('f1', 'f1')}, row_number() OVER (PARTITION BY component ORDER BY id) AS run_index FROM run_log", "run_log")
def e9(spark, sf):
    """Run index per component, oldest first."""
    log = runs.changed_runs(views.run_records(spark, sf))
    return plain(runs.run_trend(log).select("component", "id", "f1", "run_index"))


@query("f13", f"SELECT id, component, {r('f1', 'f1')}, {ts('created_at')} FROM (SELECT * FROM run_log WHERE component = 'knn' ORDER BY created_at DESC, id DESC LIMIT 50)", "run_log")
def f13(spark, sf):
    log = runs.changed_runs(views.run_records(spark, sf))
    return plain(runs.training_history(log, "knn").select("id", "component", "f1", "created_at"))


@query("f14", f"SELECT {ACT_OUT} FROM (SELECT * FROM act ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 25)", "act")
def f14(spark, sf):
    return plain(dashboard.list_actions(views.actions(spark, sf), 25, 25))


# --- agents and blocks -------------------------------------------------------
@query(
    "e6",
    f"""SELECT agent_id, arg_max(hostname, (ts, id)) FILTER (WHERE hostname <> '') AS hostname, arg_max(ip_address, (ts, id)) FILTER (WHERE ip_address <> '') AS ip_address,
      arg_max(agent_version, (ts, id)) FILTER (WHERE agent_version <> '') AS agent_version, {ts('max(ts)', 'last_seen')}, {n('', 'messages')} FROM messages GROUP BY 1""",
    "messages",
)
def e6(spark, sf):
    """Latest state per agent; NULL and empty fields overwrite nothing."""
    return plain(runs.latest_agents(views.agent_messages(spark, sf)))


@query("e7", "SELECT agent_id, epoch_us(TIMESTAMP '2024-01-30 23:30:00') - epoch_us(max(ts)) <= 3600000000 AS online FROM messages WHERE ts <= '2024-01-30 23:30:30' GROUP BY 1", "messages")
def e7(spark, sf):
    """Online flag as of a fixed time (one hour here, as heartbeats are sparse)."""
    seen = views.agent_messages(spark, sf).filter(F.col("ts") <= F.lit("2024-01-30 23:30:30").cast("timestamp_ntz"))
    state = runs.latest_agents(seen)
    as_of = F.lit("2024-01-30 23:30:00").cast("timestamp_ntz")
    return state.select("agent_id", runs.is_online("last_seen", as_of, 3600).alias("online"))


@query(
    "e8",
    """SELECT source_ip FROM (SELECT source_ip, arg_max(actual_action, (created_at, id)) AS state FROM (
      SELECT *, CASE WHEN substr(id, 1, 1) < '4' THEN 'unblocked' WHEN actual_action = 'would_block' THEN 'blocked' ELSE actual_action END AS action FROM act)
      b(id, event_id, source_ip, risk_score, risk_level, requested_action, old_action, dry_run, success, reason, adapter, target_scope, created_at, actual_action)
      WHERE actual_action IN ('blocked', 'unblocked') GROUP BY 1) WHERE state = 'blocked'""",
    "act",
)
def e8(spark, sf):
    """Sources whose last block or unblock was a block."""
    a = views.actions(spark, sf)
    action = F.when(F.substring("id", 1, 1) < "4", "unblocked").when(F.col("actual_action") == "would_block", "blocked").otherwise(F.col("actual_action"))
    return runs.currently_blocked(a.withColumn("actual_action", action))

