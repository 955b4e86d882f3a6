"""Flow reconstruction, features, sessions and running edge state."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import context, packets, sessionize
from flowloom.operators.packets import FLOW_KEY
from flowloom.plans import views
from flowloom.plans.oracle import big, cte, n, r, ts
from flowloom.plans.registry import query
from flowloom.plans.views import LIMITS, plain
from flowloom.schemas import FLOW_FEATURES
from flowloom.streaming.edges import CONTEXT, PORTS, live_port_context

IDLE_SECONDS = 21_600.0  # packets of one client are hours apart

# One flow per client; "ahead": the client spoke first; f: forward packet.
cte(
    "dirs",
    "packets",
    """
  SELECT p.*, outbound = first_out AS f FROM packets p JOIN (
    SELECT client, arg_min(outbound, (t, seq)) AS first_out FROM packets GROUP BY 1) USING (client)""",
)
cte(
    "gaps",
    "dirs",
    f"""
  SELECT *, gap IS NULL OR gap >= {int(IDLE_SECONDS * 1e6)} AS opens FROM (
    SELECT *, t - lag(t) OVER (PARTITION BY client ORDER BY t, seq) AS gap,
      t - lag(t) OVER (PARTITION BY client, f ORDER BY t, seq) AS side_gap FROM dirs)""",
)
cte("islands", "gaps", "SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY t, seq) AS burst FROM gaps")
cte(
    "bursts",
    "islands",
    """
  SELECT client, count(*) AS bursts, avg(d) AS active_mean, stddev_pop(d) AS active_std, max(d) AS active_max, min(d) AS active_min
  FROM (SELECT client, burst, max(t) - min(t) AS d FROM islands GROUP BY 1, 2) GROUP BY 1""",
)


def z(e: str) -> str:
    return f"coalesce({e}, 0)"


def iat(col: str, where: str) -> list[str]:
    w = f" FILTER (WHERE {where})" if where else ""
    return [z(f"{f}({col}){w}") for f in ("sum", "avg", "stddev_pop", "max", "min")]


SECONDS = "greatest((max(t) - min(t)) / 1e6, 1e-6)"


def _length(where: str) -> list[str]:
    return [z(f"{f}(len) FILTER (WHERE {where})") for f in ("max", "min", "avg", "stddev_pop")]


_FLOW_IAT, _FWD_IAT, _BWD_IAT = iat("gap", ""), iat("side_gap", "f"), iat("side_gap", "NOT f")
FEATURE_SQL = dict(
    zip(
        FLOW_FEATURES,
        [
            "any_value(CASE WHEN outbound = f THEN 443 ELSE client_port END)",
            "max(t) - min(t)",
            "count(*) FILTER (WHERE f)",
            "count(*) FILTER (WHERE NOT f)",
            z("sum(len) FILTER (WHERE f)"),
            z("sum(len) FILTER (WHERE NOT f)"),
            *_length("f"),
            *_length("NOT f"),
            f"sum(len) / {SECONDS}",
            f"count(*) / {SECONDS}",
            *_FLOW_IAT[1:],
            *_FWD_IAT,
            *_BWD_IAT,
            "count(*) FILTER (WHERE f AND psh)",
            "0",
            z("sum(head) FILTER (WHERE f)"),
            z("sum(head) FILTER (WHERE NOT f)"),
            f"count(*) FILTER (WHERE f) / {SECONDS}",
            f"count(*) FILTER (WHERE NOT f) / {SECONDS}",
            "min(len)",
            "max(len)",
            "avg(len)",
            "stddev_pop(len)",
            "var_pop(len)",
            *[f"count(*) FILTER (WHERE {x})" for x in ("fin", "syn", "rst", "psh", "ack")],
            "0",
            "0",
            "0",
            z("count(*) FILTER (WHERE NOT f) / nullif(count(*) FILTER (WHERE f), 0)"),
            "sum(len) / count(*)",
            z("avg(len) FILTER (WHERE f)"),
            z("avg(len) FILTER (WHERE NOT f)"),
            f"{z('sum(len) FILTER (WHERE f)')} / any_value(bursts)",
            f"{z('sum(len) FILTER (WHERE NOT f)')} / any_value(bursts)",
            "coalesce((arg_min({'w': win}, (t, seq)) FILTER (WHERE f)).w, -1)",
            "coalesce((arg_min({'w': win}, (t, seq)) FILTER (WHERE NOT f)).w, -1)",
            "count(*) FILTER (WHERE f AND payload > 0)",
            z("min(head) FILTER (WHERE f)"),
            *[f"any_value({x})" for x in ("active_mean", "active_std", "active_max", "active_min")],
            *[z(f"{f}(gap) FILTER (WHERE gap >= {int(IDLE_SECONDS * 1e6)})") for f in ("avg", "stddev_pop", "max", "min")],
        ],
        strict=True,
    )
)
# Microseconds are shown as seconds, moved off the rounding ties that halves would meet.
MICROS = {f for f in FLOW_FEATURES if "IAT" in f or f == "Flow Duration" or f.startswith(("Active", "Idle"))}


def _feature_columns() -> str:
    return ", ".join(r(f"({e}) / 1e6 + 1e-9" if f in MICROS else e, f'"{f}"') for f, e in FEATURE_SQL.items())


def _shown_features(df):
    scaled = {f: F.col(f"`{f}`") / 1e6 + 1e-9 for f in MICROS}
    return plain(df.withColumns(scaled))


def _client(df):
    out = F.col("src_port") != 443
    return df.withColumn("client", F.when(out, F.col("src_ip")).otherwise(F.col("dst_ip")))


@query("e1", f"""SELECT client, {', '.join(r(f'({e}) / 1e6 + 1e-9', f'{d}_{s}') for d, es in (('flow', _FLOW_IAT), ('fwd', _FWD_IAT), ('bwd', _BWD_IAT)) for e, s in zip(es, ('sum', 'avg', 'std', 'max', 'min')))}
  FROM gaps GROUP BY 1""", "gaps")
def e1(spark, sf):
    """Inter-arrival statistics per flow and direction."""
    s = packets.interarrival_stats(views.packets(spark, sf))
    cols = [F.col(f"{d}_iat_{m}") / 1e6 + 1e-9 for d in ("flow", "fwd", "bwd") for m in ("sum", "avg", "std", "max", "min")]
    names = [f"{d}_{m}" for d in ("flow", "fwd", "bwd") for m in ("sum", "avg", "std", "max", "min")]
    client = F.when(F.col("lo_port") != 443, F.col("lo_ip")).otherwise(F.col("hi_ip")).alias("client")
    return plain(s.select(client, *[c.alias(x) for c, x in zip(cols, names)]))


@query("e2", f"""SELECT g.client, any_value(b.bursts)::BIGINT AS burst_count, {', '.join(r(f'any_value(b.{x}) / 1e6 + 1e-9', x) for x in ('active_mean', 'active_std', 'active_max', 'active_min'))},
  {', '.join(r(f'coalesce({f}(gap) FILTER (WHERE gap >= {int(IDLE_SECONDS * 1e6)}), 0) / 1e6 + 1e-9', f'idle_{x}') for f, x in (('avg', 'mean'), ('stddev_pop', 'std'), ('max', 'max'), ('min', 'min')))}
  FROM gaps g JOIN bursts b ON b.client = g.client GROUP BY 1""", "gaps bursts")
def e2(spark, sf):
    """Activity bursts and idle gaps."""
    s = packets.burst_stats(views.packets(spark, sf), idle_seconds=IDLE_SECONDS)
    client = F.when(F.col("lo_port") != 443, F.col("lo_ip")).otherwise(F.col("hi_ip")).alias("client")
    shown = [(F.col(f"{k}_{m}") / 1e6 + 1e-9).alias(f"{k}_{m}") for k in ("active", "idle") for m in ("mean", "std", "max", "min")]
    return plain(s.select(client, "burst_count", *shown))


@query("e3", f"""SELECT client, {r(FEATURE_SQL['Init_Win_bytes_forward'], 'init_window_forward')}, {r(FEATURE_SQL['Init_Win_bytes_backward'], 'init_window_backward')} FROM dirs GROUP BY 1""", "dirs")
def e3(spark, sf):
    """First-packet TCP window per direction."""
    s = packets.initial_windows(views.packets(spark, sf))
    client = F.when(F.col("lo_port") != 443, F.col("lo_ip")).otherwise(F.col("hi_ip")).alias("client")
    return plain(s.select(client, "init_window_forward", "init_window_backward"))


@query("h20", f"SELECT client, {_feature_columns()} FROM islands JOIN bursts USING (client) GROUP BY 1", "islands bursts")
def h20(spark, sf):
    """All 67 features of every flow."""
    f = _client(packets.flow_features(views.packets(spark, sf), idle_seconds=IDLE_SECONDS))
    return _shown_features(f.select("client", *[F.col(f"`{x}`") for x in FLOW_FEATURES]))


@query("h20_quality", f"""SELECT quality, {n('', 'features')}, CAST(count(*) * (SELECT count(DISTINCT client) FROM packets) AS BIGINT) AS filled FROM (SELECT CASE WHEN f IN ('CWE Flag Count', 'Subflow Fwd Bytes', 'Subflow Bwd Bytes', 'min_seg_size_forward')
    OR f LIKE 'Active %' OR f LIKE 'Idle %' THEN 'B' ELSE 'A' END AS quality FROM (SELECT unnest([{', '.join("'" + f + "'" for f in FLOW_FEATURES)}]) AS f)) GROUP BY 1""", "packets")
def h20_quality(spark, sf):
    """Quality class of the features, and how many flows of the packet table yield a value."""
    q = packets.feature_quality(packets.flow_features(views.packets(spark, sf), idle_seconds=IDLE_SECONDS))
    return plain(q.groupBy("quality").agg(F.count("*").alias("features"), F.sum("filled").alias("filled")))


@query("h21", f"""SELECT CASE WHEN client < '192.168.10.50' THEN client ELSE '192.168.10.50' END AS lo_ip, CASE WHEN client < '192.168.10.50' THEN '192.168.10.50' ELSE client END AS hi_ip,
  CASE WHEN client < '192.168.10.50' THEN client_port ELSE 443 END AS lo_port, CASE WHEN client < '192.168.10.50' THEN 443 ELSE client_port END AS hi_port, {n('', 'packets')} FROM packets GROUP BY 1, 2, 3, 4""", "packets")
def h21(spark, sf):
    """Symmetric flow key."""
    k = packets.with_flow_key(views.packets(spark, sf))
    return plain(k.groupBy("lo_ip", "hi_ip", "lo_port", "hi_port").agg(F.count("*").alias("packets")))


@query("h22", "SELECT seq, f AS is_forward FROM dirs", "dirs")
def h22(spark, sf):
    """Direction of every packet."""
    return packets.with_direction(views.packets(spark, sf)).select("seq", "is_forward")


@query("h23", f"""SELECT client, {n('', 'total_packets')}, {n('f', 'forward_packets')}, {n('NOT f', 'backward_packets')}, {big('sum(len)', 'total_bytes')},
  {big(z('sum(len) FILTER (WHERE f)'), 'forward_bytes')}, {big(z('sum(len) FILTER (WHERE NOT f)'), 'backward_bytes')}, {ts('min(ts)', 'start_ts')}, {ts('max(ts)', 'end_ts')} FROM dirs GROUP BY 1""", "dirs")
def h23(spark, sf):
    """Flow reconstruction without timeouts."""
    f = _client(packets.reconstruct_flows(views.packets(spark, sf)))
    return plain(f.select("client", "total_packets", "forward_packets", "backward_packets", "total_bytes", "forward_bytes", "backward_bytes", "start_ts", "end_ts"))


@query(
    "e10",
    f"""SELECT event_id, count(*) OVER w AS live_flow_count, {ts('min(ts) OVER w', 'live_first_seen')}, {ts('max(ts) OVER w', 'live_last_seen')} FROM flows
    WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "flows",
)
def e10(spark, sf):
    """Running edge state: what each flow sees of the earlier ones on its edge."""
    f = views.flows(spark, sf).select("event_id", "src_ip", "dst_ip", "ts")
    out = context.prior_edge_state(f, ("ts", "event_id"))
    return plain(out.select("event_id", "live_flow_count", "live_first_seen", "live_last_seen"))


# --- sessions: the machine as a recursive query, one packet of every key per step
_D, _I, _P = int(LIMITS.max_duration_seconds * 1e6), int(LIMITS.idle_seconds * 1e6), LIMITS.max_packets
MACHINE = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, seq) AS rn FROM packets),
  walk AS (
    SELECT client, rn, seq, ts, t, CAST(0 AS BIGINT) AS flow, t AS first_t, t AS last_t, 1 AS cnt, outbound AS fwd_out, fin AS fin_f, false AS fin_b,
      CASE WHEN rst THEN 'rst' WHEN 1 >= {_P} THEN 'max_packets' END AS closed FROM ordered WHERE rn = 1
    UNION ALL
    SELECT client, rn, seq, ts, t, flow, first_t, last_t, cnt, fwd_out, fin_f, fin_b,
      CASE WHEN rst THEN 'rst' WHEN fin AND fin_f AND fin_b THEN 'fin' WHEN t - first_t >= {_D} THEN 'max_duration' WHEN cnt >= {_P} THEN 'max_packets' END AS closed
    FROM (
      SELECT o.client, o.rn, o.seq, o.ts, o.t, o.rst, o.fin, w.flow + CASE WHEN fresh THEN 1 ELSE 0 END AS flow,
        CASE WHEN fresh THEN o.t ELSE w.first_t END AS first_t, o.t AS last_t, CASE WHEN fresh THEN 1 ELSE w.cnt + 1 END AS cnt,
        CASE WHEN fresh THEN o.outbound ELSE w.fwd_out END AS fwd_out,
        CASE WHEN fresh THEN o.fin ELSE w.fin_f OR (o.fin AND o.outbound = w.fwd_out) END AS fin_f,
        CASE WHEN fresh THEN false ELSE w.fin_b OR (o.fin AND o.outbound <> w.fwd_out) END AS fin_b
      FROM (SELECT w.*, w.closed IS NOT NULL OR n.t - w.last_t > {_I} AS fresh FROM walk w JOIN ordered n ON n.client = w.client AND n.rn = w.rn + 1) w
      JOIN ordered o ON o.client = w.client AND o.rn = w.rn + 1)),
  sessions AS (SELECT client, flow, count(*) AS packets, min(ts) AS start_ts, max(ts) AS end_ts, max(closed) AS closed FROM walk GROUP BY 1, 2),
  ended AS (SELECT *, coalesce(closed, CASE WHEN flow < max(flow) OVER (PARTITION BY client) THEN 'idle_timeout' ELSE 'flush' END) AS end_reason FROM sessions)"""
SESSION_SQL = f"WITH {MACHINE} SELECT client, {big('packets', 'packets')}, {ts('start_ts')}, {ts('end_ts')}, end_reason FROM ended"


def _session_rows(flows):
    client = F.when(F.col("lo_port") != 443, F.col("lo_ip")).otherwise(F.col("hi_ip")).alias("client")
    return plain(flows.select(client, "packets", "start_ts", "end_ts", "end_reason"))


@query("k1", SESSION_SQL, "packets", recursive=True)
def k1(spark, sf):
    """Sessionization by the close rules (batch twin of the stream)."""
    return _session_rows(sessionize.close_reasons(sessionize.sessionize(views.packets(spark, sf), LIMITS)))


@query("k1_counts", f"WITH {MACHINE} SELECT end_reason, {n()} FROM ended GROUP BY 1", "packets", recursive=True)
def k1_counts(spark, sf):
    """Close reasons, counted; ``flush`` and ``idle_timeout`` are the sweep's."""
    flows = sessionize.close_reasons(sessionize.sessionize(views.packets(spark, sf), LIMITS))
    return plain(flows.groupBy("end_reason").agg(F.count("*").alias("n")))


@query("h20_sessions", f"""WITH {MACHINE}, m AS (SELECT client, flow, count(*) AS total, max(t) - min(t) AS d FROM walk GROUP BY 1, 2)
  SELECT client, {r('d / 1e6 + 1e-9', '"Flow Duration"')}, {r('total / greatest(d / 1e6, 1e-6) + 1e-9', '"Flow Packets/s"')}, {big('total', 'packets')} FROM m""", "packets", recursive=True)
def h20_sessions(spark, sf):
    """Features of sessionized flows, whose size is bounded by the close rules."""
    s = sessionize.sessionize(views.packets(spark, sf), LIMITS)
    f = _client(packets.flow_features(s, [*FLOW_KEY, "flow_id"], IDLE_SECONDS, slices=None))
    total = F.col("`Total Fwd Packets`") + F.col("`Total Backward Packets`")
    return plain(f.select("client", (F.col("`Flow Duration`") / 1e6 + 1e-9).alias("Flow Duration"), (F.col("`Flow Packets/s`") + 1e-9).alias("Flow Packets/s"), total.cast("long").alias("packets")))


TTL_DAYS = 200


def live_sql(flows: str) -> str:
    """The context of every row of ``flows``; ports count from the life's first flow on."""
    ports = ", ".join(f"count(DISTINCT {c}) OVER w AS live_{n}" for n, c in PORTS.items())
    return f"""WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts, event_id) > INTERVAL {TTL_DAYS} DAY AS gone FROM {flows}),
  s AS (SELECT *, sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM g)
  SELECT event_id, count(*) OVER w AS live_flow_count, {ts('min(ts) OVER w', 'live_first_seen')}, {ts('max(ts) OVER w', 'live_last_seen')}, {ports} FROM s
  WINDOW w AS (PARTITION BY src_ip, dst_ip, life ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("k3", live_sql("flows"), "flows")
def k3(spark, sf):
    """Live edge state with eviction after a quiet period (batch twin)."""
    f = views.flows(spark, sf).select("event_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ts")
    out = live_port_context(f, ("ts", "event_id"), ttl_seconds=TTL_DAYS * 86_400)
    return plain(out.select("event_id", *CONTEXT))
