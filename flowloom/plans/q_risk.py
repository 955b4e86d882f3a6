"""Risk scoring, context joins and the response policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import policy
from flowloom.functions import risk as rk
from flowloom.functions.risk import score_risk
from flowloom.operators import context
from flowloom.plans import views
from flowloom.plans.oracle import factor_ctes, n, r, ts
from flowloom.plans.q_sources import ACT_OUT
from flowloom.plans.registry import query
from flowloom.plans.views import RISK, plain

CTX_OUT = f"""{r('edge_attack_ratio', 'edge_attack_ratio')}, edge_attack_flow_count, edge_flow_count, {ts('edge_first_seen')}, {ts('edge_last_seen')}, edge_attack_label_count"""


@query(
    "c1",
    f"""SELECT f.event_id, {CTX_OUT} FROM flows f LEFT JOIN (SELECT * FROM context WHERE edge_flow_count >= 12) c ON f.src_ip = c.src_ip AND f.dst_ip = c.dst_ip""",
    "flows context",
)
def c1(spark, sf):
    """Flows left-joined to edge context; unmatched flows stay with NULLs."""
    edges = views.edges(spark, sf).filter("flow_count >= 12")
    joined = context.attach_context(views.flows(spark, sf), edges)
    return plain(joined.select("event_id", *rk.CONTEXT_COLUMNS))


VERSIONS = """versions AS (SELECT src_ip, dst_ip, attack_ratio, attack_flow_count, flow_count, first_seen, last_seen, attack_labels, 1 AS id FROM edges
  UNION ALL SELECT src_ip, dst_ip, 0.5, attack_flow_count + 100, flow_count + 200, first_seen, last_seen, attack_labels, 2 FROM edges WHERE flow_count >= 12)"""


def edge_versions(spark, sf):
    """Two stored graph versions; the newer one holds only the busier edges."""
    e = views.edges(spark, sf).select("src_ip", "dst_ip", "attack_ratio", "attack_flow_count", "flow_count", "first_seen", "last_seen", "attack_labels")
    newer = e.filter("flow_count >= 12").withColumns(
        {"attack_ratio": F.lit(0.5), "attack_flow_count": F.col("attack_flow_count") + 100, "flow_count": F.col("flow_count") + 200}
    )
    return e.withColumn("id", F.lit(1)).unionAll(newer.withColumn("id", F.lit(2)))


LATEST = f"""{VERSIONS}, latest AS (SELECT src_ip, dst_ip, attack_ratio AS edge_attack_ratio, attack_flow_count AS edge_attack_flow_count, flow_count AS edge_flow_count,
  first_seen AS edge_first_seen, last_seen AS edge_last_seen, CAST(coalesce(len(attack_labels), 0) AS BIGINT) AS edge_attack_label_count FROM (
    SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY id DESC) AS rn FROM versions) WHERE rn = 1)"""


@query("c5", f"WITH {LATEST} SELECT src_ip, dst_ip, {CTX_OUT} FROM latest", "edges")
def c5(spark, sf):
    """Latest stored context of every pair."""
    return plain(context.edge_context(context.latest_edges(edge_versions(spark, sf))))


@query(
    "c7",
    f"""WITH live AS (SELECT *, count(*) OVER w AS live_flow_count, min(ts) OVER w AS live_first_seen, max(ts) OVER w AS live_last_seen FROM flows
        WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    h AS (SELECT * FROM context WHERE edge_flow_count >= 14),
    j AS (SELECT l.event_id, l.live_flow_count, l.live_first_seen, l.live_last_seen, h.* EXCLUDE (src_ip, dst_ip),
        h.edge_attack_ratio IS NULL AND h.edge_flow_count IS NULL AS empty FROM live l LEFT JOIN h ON l.src_ip = h.src_ip AND l.dst_ip = h.dst_ip)
    SELECT event_id, CASE WHEN empty AND live_flow_count >= 10 THEN 'live' WHEN empty THEN 'none' ELSE 'history' END AS context_source,
      CASE WHEN empty AND live_flow_count >= 10 THEN live_flow_count ELSE edge_flow_count END AS edge_flow_count,
      {ts('CASE WHEN empty AND live_flow_count >= 10 THEN live_last_seen ELSE edge_last_seen END', 'edge_last_seen')},
      {r('edge_attack_ratio', 'edge_attack_ratio')} FROM j""",
    "flows context",
)
def c7(spark, sf):
    """Context precedence: history, else ten or more live flows, else none."""
    flows = views.flows(spark, sf).select("event_id", "src_ip", "dst_ip", "ts")
    running = context.prior_edge_state(flows, ("ts", "event_id"))
    chosen = context.choose_context(context.attach_context(running, views.edges(spark, sf).filter("flow_count >= 14")))
    return plain(chosen.select("event_id", "context_source", "edge_flow_count", "edge_last_seen", "edge_attack_ratio"))


@query("h1", f"SELECT {r('anomaly_score', 'score')}, {r('1 - exp(-anomaly_score / 0.05)', 'severity')}, {n()} FROM flows GROUP BY anomaly_score", "flows")
def h1(spark, sf):
    g = views.flows(spark, sf).groupBy(F.col("anomaly_score").alias("score")).agg(F.count("*").alias("n"))
    return plain(g.withColumn("severity", rk.anomaly_severity("score", 0.05)))


@query("h2", f"SELECT src_ip, dst_ip, {r('greatest(0.0, least(1.0, attack_ratio * 3 - 0.5))', 'value')} FROM edges", "edges")
def h2(spark, sf):
    """Ratio clamp (fed with values on both sides of the range)."""
    e = views.edges(spark, sf)
    return plain(e.select("src_ip", "dst_ip", rk.attack_ratio_norm(F.col("attack_ratio") * 3 - 0.5).alias("value")))


@query("h3", f"SELECT src_ip, dst_ip, {r('CASE WHEN attack_flow_count <= 0 THEN 0 ELSE least(1.0, ln(1 + attack_flow_count) / ln(7.0)) END', 'value')} FROM edges", "edges")
def h3(spark, sf):
    return plain(views.edges(spark, sf).select("src_ip", "dst_ip", rk.attack_activity_norm("attack_flow_count", 6.0).alias("value")))


@query("h4", f"SELECT src_ip, dst_ip, {r('least(1.0, (epoch_us(last_seen) - epoch_us(first_seen)) / 3.6e9 / 50000.0)', 'value')} FROM edges", "edges")
def h4(spark, sf):
    return plain(views.edges(spark, sf).select("src_ip", "dst_ip", rk.temporal_persistence_norm("first_seen", "last_seen", 50_000.0).alias("value")))


@query("h5", f"SELECT src_ip, dst_ip, {r('least(1.0, coalesce(len(attack_labels), 0) / 3.0)', 'value')} FROM edges", "edges")
def h5(spark, sf):
    return plain(views.edges(spark, sf).select("src_ip", "dst_ip", rk.attack_context_norm(F.size("attack_labels"), 3).alias("value")))


def _context(spark, sf):
    return context.attach_context(views.flows(spark, sf), views.edges(spark, sf))


@query("h6", f"SELECT event_id, {r('raw', 'raw')} FROM scored", "scored")
def h6(spark, sf):
    """Weighted factor sum."""
    factors = rk.factor_columns("anomaly_score", RISK)
    return plain(_context(spark, sf).select("event_id", rk.raw_risk(factors, RISK).alias("raw")))


@query("h7", f"SELECT event_id, {r('1 + 9 * greatest(0.0, least(1.0, raw))', 'calibrated')} FROM scored", "scored")
def h7(spark, sf):
    factors = rk.factor_columns("anomaly_score", RISK)
    return plain(_context(spark, sf).select("event_id", rk.calibrate(rk.raw_risk(factors, RISK)).alias("calibrated")))


@query("h8", f"SELECT event_id, {r('final', 'score')}, rules_applied FROM scored", "scored")
def h8(spark, sf):
    """Additive rules in order, then the clip."""
    factors = rk.factor_columns("anomaly_score", RISK)
    score, fired = rk.apply_rules(rk.calibrate(rk.raw_risk(factors, RISK)), factors["anomaly_severity"], RISK)
    return plain(_context(spark, sf).select("event_id", score.alias("score"), fired.alias("rules_applied")))


@query("h9", f"SELECT risk_level, {n()}, {r('min(final)', 'low')}, {r('max(final)', 'high')} FROM scored GROUP BY 1", "scored")
def h9(spark, sf):
    """Levels of unrounded scores."""
    factors = rk.factor_columns("anomaly_score", RISK)
    score, _ = rk.apply_rules(rk.calibrate(rk.raw_risk(factors, RISK)), factors["anomaly_severity"], RISK)
    s = _context(spark, sf).select(score.alias("score"))
    return plain(s.groupBy(rk.risk_level("score").alias("risk_level")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")))


@query(
    "h10",
    f"""SELECT event_id, array_to_string(list_transform(ranked, lambda x: x.name), ',') AS factor_order, reason FROM explained""",
    "explained",
)
def h10(spark, sf):
    """Explanation: ranked factors and the reason sentence."""
    s = views.scored(spark, sf)
    return s.select("event_id", F.array_join(F.transform("factors", lambda f: f["name"]), ",").alias("factor_order"), "reason")


@query("h11", f"SELECT event_id, {r('risk_score', 'risk_score')}, risk_level, rules_applied, reason, 'risk-engine-v1' AS config_version FROM explained", "explained")
def h11(spark, sf):
    """The full event score."""
    s = views.scored(spark, sf)
    return plain(s.select("event_id", "risk_score", "risk_level", "rules_applied", "reason", "config_version"))


factor_ctes("tagged", "fitted", 0.05, "(SELECT quantile_cont(CAST(attack_flow_count AS DOUBLE), 0.95) FILTER (WHERE attack_flow_count > 0) FROM edges)",
            "(SELECT round(quantile_cont((epoch_us(last_seen) - epoch_us(first_seen)) / 3.6e9, 0.95) FILTER (WHERE flow_count > 1), 2) FROM edges)")


@query("h11_fitted", f"SELECT traffic_class, risk_level, {n()}, {r('avg(risk_score)', 'mean', 4)} FROM fitted GROUP BY 1, 2", "fitted")
def h11_fitted(spark, sf):
    """The risk pipeline with scales fitted from the edge table."""
    flows, edges = views.flows(spark, sf), views.edges(spark, sf)
    cfg = context.fit_risk_config(edges, views.THRESHOLD)
    s = context.attach_context(flows, edges).transform(score_risk(cfg, explained=False))
    return plain(s.groupBy("traffic_class", "risk_level").agg(F.count("*").alias("n"), F.avg("risk_score").alias("mean")), 4)


@query("h12", f"SELECT CASE WHEN risk_score >= 6.0 THEN 'block_candidate' WHEN risk_score >= 4.0 THEN 'alert' ELSE 'log' END AS decision, {n()} FROM scored GROUP BY 1", "scored")
def h12(spark, sf):
    s = views.scored(spark, sf, explained=False)
    return plain(s.groupBy(policy.decide("risk_score", views.POLICY).alias("decision")).agg(F.count("*").alias("n")))


@query("h13", f"SELECT {ACT_OUT.replace('id, event_id', 'event_id', 1)} FROM act", "act")
def h13(spark, sf):
    """Response audit rows: alerts, rejected and would-be blocks."""
    return plain(views.actions(spark, sf).drop("id"))
