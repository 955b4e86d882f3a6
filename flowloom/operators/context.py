"""Graph context for flows: joins, precedence and running edge state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.risk import CONTEXT_COLUMNS
from flowloom.operators.ordered import Slices, percentile_columns, running_before
from flowloom.functions.parsing import micros
from flowloom.schemas import RiskConfig

LIVE_MIN_FLOWS = 10


def edge_context(edges: DataFrame) -> DataFrame:
    """The six context columns per (source, destination)."""
    return edges.select(
        "src_ip",
        "dst_ip",
        F.col("attack_ratio").alias("edge_attack_ratio"),
        F.col("attack_flow_count").alias("edge_attack_flow_count"),
        F.col("flow_count").alias("edge_flow_count"),
        F.col("first_seen").alias("edge_first_seen"),
        F.col("last_seen").alias("edge_last_seen"),
        F.size("attack_labels").cast("long").alias("edge_attack_label_count"),
    )


def attach_context(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """Left join flows to their edge; unmatched flows keep NULL context.

    The edge side is aggregated, one row per pair, so no flow is multiplied. No
    broadcast hint: the optimizer broadcasts it under its own size limit, above
    that the adaptive skew join splits a hot edge.
    """
    return flows.join(edge_context(edges), ["src_ip", "dst_ip"], "left")


def latest_edges(versions: DataFrame, order: str = "id") -> DataFrame:
    """Newest version of every edge; a partial aggregate, no window sort."""
    rest = [c for c in versions.columns if c not in ("src_ip", "dst_ip")]
    newest = versions.groupBy("src_ip", "dst_ip").agg(F.max_by(F.struct(*rest), order).alias("e"))
    return newest.select("src_ip", "dst_ip", *[F.col(f"e.{c}").alias(c) for c in rest])


def context_is_empty(ratio: Column | str = "edge_attack_ratio", flows: Column | str = "edge_flow_count") -> Column:
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    flows = F.col(flows) if isinstance(flows, str) else flows
    return ratio.isNull() & flows.isNull()


def choose_context(df: DataFrame, live_prefix: str = "live_", min_flows: int = LIVE_MIN_FLOWS) -> DataFrame:
    """History where there is any, else live counts from ``min_flows`` flows on.

    Needs the ``edge_*`` columns and ``live_flow_count/first_seen/last_seen``.
    One flag decides for all fields, so the two are never blended. Adds
    ``context_source``.
    """
    empty = context_is_empty()
    live = empty & (F.coalesce(F.col(f"{live_prefix}flow_count"), F.lit(0)) >= min_flows)
    from_live = {
        "edge_flow_count": f"{live_prefix}flow_count",
        "edge_first_seen": f"{live_prefix}first_seen",
        "edge_last_seen": f"{live_prefix}last_seen",
    }
    picked = {}
    for name in CONTEXT_COLUMNS:
        fallback = F.col(from_live[name]) if name in from_live else F.lit(None)
        picked[name] = F.when(live, fallback).otherwise(F.col(name))
    source = F.when(live, "live").when(empty, "none").otherwise("history")
    return df.withColumns({**picked, "context_source": source})


def prior_edge_state(flows: DataFrame, order: tuple[str, ...], prefix: str = "live_", slices: Slices = Slices()) -> DataFrame:
    """Count, first and last time of the earlier flows on the same edge.

    Batch form of the running edge state: each flow sees what came before it. ``order``
    starts with the time; a hot edge is cut into slices of about equal rows.
    """
    ts, *ties = order
    timed = flows.withColumn("_t", micros(ts))
    running = {f"{prefix}flow_count": ("count", None), f"{prefix}first_seen": ("min", ts), f"{prefix}last_seen": ("max", ts)}
    return running_before(timed, ["src_ip", "dst_ip"], ["_t", *ties], slices, running).drop("_t")


def scale_parameters(edges: DataFrame) -> DataFrame:
    """One row: the two normalisation scales and the edges behind each."""
    attack = edges.filter("attack_flow_count > 0").select(F.col("attack_flow_count").cast("double").alias("v"))
    span = (micros("last_seen") - micros("first_seen")) / F.lit(3.6e9)
    hours = edges.filter("flow_count > 1 and first_seen is not null and last_seen is not null").select(span.alias("v"))
    both = attack.withColumn("scale", F.lit("activity")).unionByName(hours.withColumn("scale", F.lit("temporal")))
    p = percentile_columns(both, "v", {"p95": 0.95}, ["scale"])
    n = both.groupBy("scale").agg(F.count("*").alias("n"))
    joined = p.join(n, "scale")

    def pick(scale: str, column: str) -> Column:
        return F.max(F.when(F.col("scale") == scale, F.col(column)))

    return joined.agg(
        F.coalesce(F.round(pick("activity", "p95"), 2), F.lit(1.0)).alias("attack_activity_scale"),
        F.coalesce(F.round(pick("temporal", "p95"), 2), F.lit(24.0)).alias("temporal_scale_hours"),
        F.coalesce(pick("activity", "n"), F.lit(0)).cast("long").alias("edges_used_for_activity_scale"),
        F.coalesce(pick("temporal", "n"), F.lit(0)).cast("long").alias("edges_used_for_temporal_scale"),
    )


def fit_risk_config(edges: DataFrame, threshold: float, **overrides) -> RiskConfig:
    """Risk configuration with scales from the edge table (two driver scalars)."""
    row = scale_parameters(edges).first()
    return RiskConfig(
        anomaly_threshold=threshold,
        attack_activity_scale=row["attack_activity_scale"],
        temporal_scale_hours=row["temporal_scale_hours"],
        **overrides,
    )
