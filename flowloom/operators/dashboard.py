"""Listings, joins and roll-ups over the event, detection, risk and action tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.parsing import pack_id, unpack_id
from flowloom.operators.context import edge_context, latest_edges
from flowloom.schemas import EVENT_SOURCES, HIGH_RISK_SCORE
from flowloom.session import ensure_checkpoint_dir


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a total order; the sort keeps only offset + limit rows per task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def list_events(events: DataFrame, source: str | None = None, traffic_class: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    if source is not None:
        if source not in EVENT_SOURCES:
            raise ValueError(f"unknown source {source!r}, expected one of {EVENT_SOURCES}")
        events = events.filter(F.col("source") == source)
    if traffic_class is not None:
        events = events.filter(F.col("traffic_class") == traffic_class)
    return page(events, [F.desc("timestamp"), F.desc("id")], limit, offset)


def list_detections(detections: DataFrame, is_anomaly: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    if is_anomaly is not None:
        detections = detections.filter(F.col("is_anomaly") == is_anomaly)
    return page(detections, [F.desc("id")], limit, offset)


def list_risks(risks: DataFrame, min_risk_score: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    if min_risk_score is not None:
        risks = risks.filter(F.col("risk_score") >= min_risk_score)
    return page(risks, [F.desc("risk_score"), F.desc("id")], limit, offset)


def list_telemetry(telemetry: DataFrame, agents: DataFrame, agent_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Connection rows with their agent, newest first."""
    if agent_id is not None:
        agents = agents.filter(F.col("agent_id") == agent_id)
    joined = telemetry.join(agents.select("agent_id", F.col("id").alias("agent_pk")), "agent_id")
    return page(joined, [F.desc("collected_at"), F.desc("id")], limit, offset)


def list_actions(actions: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(actions, [F.desc("created_at"), F.desc("id")], limit, offset)


def destination_pages(destinations: DataFrame, search: str = "", sort: str = "attack-desc", page_number: int = 0, size: int = 10) -> DataFrame:
    """Destination search: substring on the address, four orders, pages of ten."""
    orders = {
        "attack-desc": F.desc("attack_flow_count"),
        "attack-asc": F.asc("attack_flow_count"),
        "total-desc": F.desc("total_flow_count"),
        "ip-asc": F.asc("ip"),
    }
    query = search.strip().lower()
    found = destinations.filter(F.lower("ip").contains(query)) if query else destinations
    return page(found, [orders[sort], F.asc("ip")], size, page_number * size)


# --- joins -------------------------------------------------------------------
def threat_feed(events: DataFrame, detections: DataFrame, risks: DataFrame, min_risk_score: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Events with detection and risk where present, newest first.

    An outer join keeps every event, so the page lies within the first ``offset + limit`` events of
    its order: these are taken first, and only their detections and risks are looked up. A minimum
    risk score drops events without a risk row, so risks are joined before.
    """
    d = detections.select(F.col("event_id"), "anomaly_score", "is_anomaly")
    r = risks.select(F.col("event_id"), "risk_score", "risk_level")
    order = [F.desc("timestamp"), F.desc("event_id")]
    found = events.select(
        F.col("id").alias("event_id"), "timestamp", "source_ip", "source_port", "destination_ip", "destination_port", "protocol",
        "canonical_attack_label", F.col("source").alias("event_source"),
    )
    if min_risk_score is not None:
        found = found.join(r.filter(F.col("risk_score") >= min_risk_score), "event_id")
    ensure_checkpoint_dir(events.sparkSession)
    first = page(found, order, offset + limit).checkpoint()  # a page: read for its ids and for its rows
    ids = F.broadcast(first.select("event_id"))
    joined = first.join(d.join(ids, "event_id", "left_semi"), "event_id", "left")
    if min_risk_score is None:
        joined = joined.join(r.join(ids, "event_id", "left_semi"), "event_id", "left")
    shown = joined.select(
        "event_id", "timestamp", "source_ip", "source_port", "destination_ip", "destination_port", "protocol",
        "canonical_attack_label", "anomaly_score", "is_anomaly", "risk_score", "risk_level", "event_source",
    )
    return page(shown, order, limit, offset)


def anomaly_export(events: DataFrame, detections: DataFrame) -> DataFrame:
    e = events.select(F.col("id").alias("event_id"), "event_uid", "timestamp", "source_ip", "destination_ip", "canonical_attack_label")
    d = detections.filter("is_anomaly").withColumnRenamed("id", "detection_id")
    return d.join(e, "event_id").select(
        "detection_id", "event_id", "event_uid", "timestamp", "source_ip", "destination_ip", "anomaly_score",
        "reconstruction_error", "threshold_used", "canonical_attack_label",
    )


def alert_export(events: DataFrame, risks: DataFrame) -> DataFrame:
    e = events.select(F.col("id").alias("event_id"), "event_uid", "timestamp", "source_ip", "destination_ip")
    r = risks.filter(F.col("risk_level").isin("High", "Critical")).withColumnRenamed("id", "risk_assessment_id")
    return r.join(e, "event_id").select(
        "risk_assessment_id", "event_id", "event_uid", "timestamp", "source_ip", "destination_ip", "risk_score", "risk_level", "reason"
    )


def event_details(events: DataFrame, detections: DataFrame, risks: DataFrame, edge_versions: DataFrame) -> DataFrame:
    """Every event with detection, risk and graph context.

    Live events get no context: the stored graph never scored them.
    """
    context = edge_context(latest_edges(edge_versions))
    c = context.withColumnsRenamed({"src_ip": "source_ip", "dst_ip": "destination_ip"})
    packed = pack_id("event_id").alias("event_id")
    joined = (
        events.withColumn("id", pack_id("id")).withColumnRenamed("id", "event_id")
        .join(detections.select(packed, "anomaly_score", "is_anomaly"), "event_id", "left")
        .join(risks.select(packed, "risk_score", "risk_level"), "event_id", "left")
        .join(c, ["source_ip", "destination_ip"], "left")
        .withColumn("event_id", unpack_id("event_id"))
    )
    shown = [x for x in context.columns if x.startswith("edge_")]
    return joined.withColumns({x: F.when(F.col("source") != "live", F.col(x)) for x in shown})


# --- roll-ups ----------------------------------------------------------------
def summary(events: DataFrame, detections: DataFrame, risks: DataFrame) -> DataFrame:
    """One row of dashboard totals; one pass per table."""
    e = events.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("traffic_class") == "BENIGN").alias("benign_count"),
        F.max("created_at").alias("last_ingested_at"),
    )
    anomalies = detections.agg(F.count_if("is_anomaly")).scalar()
    high = risks.agg(F.count_if(F.col("risk_score") >= HIGH_RISK_SCORE)).scalar()
    return e.select(
        "total_events",
        anomalies.alias("active_threats"),
        high.alias("high_risk_events"),
        anomalies.alias("anomaly_count"),
        "benign_count",
        "last_ingested_at",
        F.when(F.col("total_events") > 0, "operational").otherwise("no_data").alias("system_health"),
    )


def attacks_by_type(events: DataFrame) -> DataFrame:
    label = F.col("canonical_attack_label")
    return (
        events.filter(label.isNotNull() & (label != "BENIGN"))
        .groupBy(label.alias("attack_type"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "attack_type")
    )


def timeline(events: DataFrame, ts: str = "timestamp", unit: str = "hour") -> DataFrame:
    return (
        events.groupBy(F.date_trunc(unit, F.col(ts)).alias("bucket"))
        .agg(F.count("*").alias("event_count"), F.count_if(F.col("traffic_class") == "ATTACK").alias("attack_count"))
        .orderBy("bucket")
    )


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("actual_action").agg(F.count("*").alias("n"))


def live_statistics(events: DataFrame, detections: DataFrame, risks: DataFrame, actions: DataFrame) -> DataFrame:
    """Totals of live events only.

    Each side table is reduced to one partial row per event before it meets the
    live events, so one join key covers all of them.
    """
    live = events.filter(F.col("source") == "live").select(F.col("id").alias("event_id"))
    tags = {
        "anomaly": detections.filter("is_anomaly").select("event_id", F.lit(1).alias("k"), F.lit(None).cast("double").alias("v")),
        "risk": risks.select("event_id", F.lit(2).alias("k"), F.col("risk_score").alias("v")),
        "alert": actions.filter(F.col("actual_action") == "alerted").select("event_id", F.lit(3).alias("k"), F.lit(None).cast("double").alias("v")),
        "blocked": actions.filter(F.col("actual_action").isin("blocked", "would_block")).select(
            "event_id", F.lit(4).alias("k"), F.lit(None).cast("double").alias("v")
        ),
        "event": events.select(F.col("id").alias("event_id"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("v")),
    }
    stacked = None
    for table in tags.values():
        stacked = table if stacked is None else stacked.unionAll(table)
    joined = stacked.join(live, "event_id", "left_semi")

    def rows(k: int) -> Column:
        return F.count_if(F.col("k") == k)

    return joined.agg(
        rows(0).alias("total_live_events"),
        rows(1).alias("detected_anomalies"),
        rows(3).alias("alerts"),
        rows(4).alias("threats_prevented_or_would_block"),
        F.avg(F.when(F.col("k") == 2, F.col("v"))).alias("average_risk_score"),
    )


def live_scoring_summary(scored: DataFrame, valid: str = "valid") -> DataFrame:
    """Valid and skipped flows, anomaly and level counts, context coverage."""
    ok = F.col(valid)
    levels = ("Very Low", "Low", "Moderate", "High", "Critical")
    return scored.agg(
        F.count("*").alias("flows"),
        F.count_if(ok).alias("valid_flows"),
        F.count_if(~ok).alias("skipped_flows"),
        F.count_if(ok & F.col("is_anomaly")).alias("anomaly_count"),
        F.count_if(ok & ~F.col("is_anomaly")).alias("normal_count"),
        *[F.count_if(ok & (F.col("risk_level") == x)).alias(f"level_{x.lower().replace(' ', '_')}") for x in levels],
        F.count_if(ok & F.col("edge_flow_count").isNotNull()).alias("context_obtained"),
    )


def metric_rows(name: str, df: DataFrame, key: str | None = None) -> DataFrame:
    """A roll-up as ``(section, key, metric, value)`` text rows, for one metric table."""
    values = [c for c in df.columns if c != key]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in values])
    label = F.lit("") if key is None else F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    return df.select(F.lit(name).alias("section"), label.alias("key"), F.explode(cells).alias("c")).select(
        "section", "key", "c.metric", "c.value"
    )
