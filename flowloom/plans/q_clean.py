"""Projections, filters, predicates and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.functions.labels import canonical_label, traffic_class, unknown_labels
from flowloom.functions.parsing import timestamp
from flowloom.operators import clean, dashboard, graph, packets, profile, validate
from flowloom.operators.autoencoder import impute_features
from flowloom.plans import views
from flowloom.plans.oracle import big, day_first, month_first, n, r, ts, valid_ip, valid_port
from flowloom.plans.q_sources import CONN, EVENT_OUT, _shown_connections, written_layouts
from flowloom.plans.registry import query
from flowloom.plans.views import plain
from flowloom.schemas import FLOW_FEATURES, TOPOLOGY_COLUMNS


@query("b1", f"SELECT original_label, canonical_label, {n()} FROM flows GROUP BY 1, 2", "flows")
def b1(spark, sf):
    """Strict label canonicalisation (unknown labels fail the job)."""
    f = views.flows(spark, sf).withColumn("canonical_label", canonical_label("original_label", topology=False))
    return plain(f.groupBy("original_label", "canonical_label").agg(F.count("*").alias("n")))


@query("b1_unknown", f"SELECT l_shipmode AS label, {n('', 'rows')} FROM (SELECT o_orderpriority AS l_shipmode FROM orders) GROUP BY 1")
def b1_unknown(spark, sf):
    """Labels a strict run would refuse, with their rows."""
    return plain(unknown_labels(views.table(spark, sf, "orders"), "o_orderpriority"))


@query("b2", f"SELECT canonical_label, {n()} FROM flows GROUP BY 1", "flows")
def b2(spark, sf):
    """Topology variant: the U+0096 spellings map as well."""
    f = views.flows(spark, sf).withColumn("Label", F.translate("original_label", "�", "\x96"))
    return plain(f.select(canonical_label("Label").alias("canonical_label")).groupBy("canonical_label").agg(F.count("*").alias("n")))


@query("b3", f"SELECT canonical_label, traffic_class, {n()} FROM flows GROUP BY 1, 2", "flows")
def b3(spark, sf):
    f = views.flows(spark, sf).withColumn("traffic_class", traffic_class("canonical_label"))
    return plain(f.groupBy("canonical_label", "traffic_class").agg(F.count("*").alias("n")))


@query("b4", f"""SELECT source_file, {n('"Label" IS NOT NULL', 'kept')}, {n('"Label" IS NULL', 'blank')} FROM raw_flows GROUP BY 1""", "raw_flows")
def b4(spark, sf):
    blank = clean.is_blank(TOPOLOGY_COLUMNS)
    raw = views.raw_flows(spark, sf)
    return plain(raw.groupBy("source_file").agg(F.count_if(~blank).alias("kept"), F.count_if(blank).alias("blank")))


@query("b5", f"""SELECT "Source IP" AS ip, {valid_ip('"Source IP"')} AS valid, {n()} FROM raw_flows GROUP BY 1, 2""", "raw_flows")
def b5(spark, sf):
    raw = views.raw_flows(spark, sf)
    return plain(raw.groupBy(F.col("Source IP").alias("ip"), net.is_valid_ip("Source IP").alias("valid")).agg(F.count("*").alias("n")))


@query("b6", f"""SELECT "Source Port" AS port, {valid_port('"Source Port"')} AS valid, {n()} FROM raw_flows GROUP BY 1, 2""", "raw_flows")
def b6(spark, sf):
    raw = views.raw_flows(spark, sf)
    return plain(raw.groupBy(F.col("Source Port").alias("port"), net.is_valid_port("Source Port").alias("valid")).agg(F.count("*").alias("n")))


@query(
    "b7",
    f"""SELECT "Timestamp" AS text, {ts(day_first('"Timestamp"'), 'day_first')}, {ts(month_first('"Timestamp"'), 'month_first')}, {n()}
    FROM raw_flows GROUP BY 1, 2, 3""",
    "raw_flows",
)
def b7(spark, sf):
    """Mixed-format timestamps, day-first with month-first fallback and the reverse."""
    raw = views.raw_flows(spark, sf)
    g = raw.groupBy(F.col("Timestamp").alias("text")).agg(F.count("*").alias("n"))
    return plain(g.select("text", timestamp("text").alias("day_first"), timestamp("text", day_first=False).alias("month_first"), "n"))


ACC = f"""{n('', 'raw_rows')}, {n("reject_reason = 'blank'", 'blank_rows')}, {n("reject_reason = 'ip'", 'invalid_ip_rows')},
  {n("reject_reason = 'port'", 'invalid_port_rows')}, {n("reject_reason = 'timestamp'", 'invalid_timestamp_rows')}, {n('reject_reason IS NULL', 'valid_rows')}"""


@query("b8", f"SELECT source_file, {ACC} FROM marked GROUP BY 1", "marked")
def b8(spark, sf):
    return plain(clean.reject_accounting(views.raw_flows(spark, sf)))


@query("b8_total", f"SELECT {big('count(DISTINCT source_file)', 'files_processed')}, {ACC} FROM marked", "marked")
def b8_total(spark, sf):
    return plain(clean.total_accounting(clean.reject_accounting(views.raw_flows(spark, sf))))


@query("b9", f"SELECT protocol, {r('sum(fwd_bytes)', 'fwd_bytes')}, {r('sum(bwd_bytes)', 'bwd_bytes')}, {n()} FROM clean GROUP BY 1", "clean")
def b9(spark, sf):
    """Numeric coercion: protocol must parse, byte totals fall back to 0."""
    c = clean.clean_flows(views.raw_flows(spark, sf))
    return plain(c.groupBy("protocol").agg(F.sum("fwd_bytes").alias("fwd_bytes"), F.sum("bwd_bytes").alias("bwd_bytes"), F.count("*").alias("n")))


RATES = ("Flow Bytes/s", "Flow Packets/s")
BAD = "(isinf(bytes_s) OR isnan(bytes_s) OR isinf(packets_s))"


@query(
    "b10",
    f"""SELECT 'label' AS part, canonical_label AS value, {n('', 'affected_rows')} FROM stat_flows WHERE {BAD} GROUP BY 2
    UNION ALL SELECT 'file', source_file, count(*) FROM stat_flows WHERE {BAD} GROUP BY 2""",
    "stat_flows",
)
def b10(spark, sf):
    """Rows affected by Inf or NaN, by label and by file."""
    s = views.statistics_flows(spark, sf)
    parts = [
        clean.infinite_breakdown(s, RATES, by).select(F.lit(name).alias("part"), F.col(by).alias("value"), "affected_rows")
        for name, by in (("label", "canonical_label"), ("file", "source_file"))
    ]
    return plain(parts[0].unionAll(parts[1]))


@query(
    "b10_stats",
    f"""SELECT {n('isinf(bytes_s)', 'inf_bytes')}, {n('isinf(packets_s)', 'inf_packets')}, {n('', 'total_rows')}, {n(BAD, 'affected_rows')},
      round(100.0 * count(*) FILTER (WHERE {BAD}) / count(*), 6) AS affected_pct FROM stat_flows""",
    "stat_flows",
)
def b10_stats(spark, sf):
    s = clean.infinite_stats(views.statistics_flows(spark, sf), RATES)
    return plain(s.withColumnsRenamed({"inf Flow Bytes/s": "inf_bytes", "inf Flow Packets/s": "inf_packets"}))


@query(
    "b10_kept",
    f"SELECT source_file, {n(f'NOT {BAD}', 'kept')}, {n(BAD, 'quarantined')} FROM stat_flows GROUP BY 1",
    "stat_flows",
)
def b10_kept(spark, sf):
    """Finite rows kept and affected rows set aside, by file."""
    kept, bad = clean.split_infinite(views.statistics_flows(spark, sf), RATES)
    both = kept.select("source_file", F.lit(1).alias("k")).unionAll(bad.select("source_file", F.lit(0)))
    return plain(both.groupBy("source_file").agg(F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("quarantined")))


@query("b11", f"SELECT canonical_label, {n('', 'kept')} FROM stat_flows WHERE NOT {BAD} GROUP BY 1", "stat_flows")
def b11(spark, sf):
    kept = clean.finite_features(views.statistics_flows(spark, sf), [*RATES, "l_quantity", "l_discount"])
    return plain(kept.groupBy("canonical_label").agg(F.count("*").alias("kept")))


@query(
    "b12",
    f"""SELECT {n('', 'total_training_rows')}, {n("canonical_label = 'BENIGN'", 'benign_training_rows')},
      {n("canonical_label <> 'BENIGN'", 'attack_rows_excluded')}, {big('5', 'matrix_columns')} FROM flows""",
    "flows",
)
def b12(spark, sf):
    return plain(clean.benign_training_counts(views.flows(spark, sf), len(views.FEATURES)))


@query(
    "b13",
    f"""SELECT {n("ts >= '1997-01-01' AND ts <= '1998-01-01'", 'closed_both')}, {n("ts >= '1997-01-01' AND ts < '1998-01-01'", 'closed_left')} FROM flows""",
    "flows",
)
def b13(spark, sf):
    """Time window, inclusive at both ends, and the half-open option."""
    f = views.flows(spark, sf)
    both = clean.within_window("ts", "1997-01-01", "1998-01-01")
    left = clean.within_window("ts", "1997-01-01", "1998-01-01", closed="left")
    return plain(f.filter(both).agg(F.count_if(both).alias("closed_both"), F.count_if(left).alias("closed_left")))


@query("b14", f"SELECT {EVENT_OUT} FROM (SELECT * FROM ev WHERE source = 'live' AND traffic_class = 'ATTACK' ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 20)", "ev")
def b14(spark, sf):
    events, _, _ = views.relational(spark, sf)
    return plain(dashboard.list_events(events, "live", "ATTACK", 50, 20))


DET_OUT = f"id, event_id, {r('anomaly_score', 'anomaly_score')}, {r('reconstruction_error', 'reconstruction_error')}, is_anomaly, {r('threshold_used', 'threshold_used')}"


@query("b15", f"SELECT {DET_OUT} FROM (SELECT * FROM det WHERE is_anomaly ORDER BY id DESC LIMIT 50 OFFSET 10)", "det")
def b15(spark, sf):
    _, detections, _ = views.relational(spark, sf)
    return plain(dashboard.list_detections(detections, True, 50, 10))


@query("b16", f"SELECT id, event_id, {r('risk_score', 'risk_score')}, risk_level FROM (SELECT * FROM risk WHERE risk_score >= 5.0 ORDER BY risk_score DESC, id DESC LIMIT 50)", "risk")
def b16(spark, sf):
    _, _, risks = views.relational(spark, sf)
    return plain(dashboard.list_risks(risks, 5.0).select("id", "event_id", "risk_score", "risk_level"))


@query(
    "b17",
    f"""SELECT {CONN}, agent_pk FROM (SELECT c.*, a.agent_pk, row_number() OVER (ORDER BY c.collected_at DESC, c.id DESC, c.local_port DESC) AS rk
      FROM conns c JOIN (SELECT agent_id, min(id) AS agent_pk FROM messages GROUP BY 1) a USING (agent_id) WHERE agent_id = 'agent-3') WHERE rk <= 40""",
    "conns messages",
)
def b17(spark, sf):
    """Telemetry of one agent, newest first."""
    batches = views.telemetry_batches(spark, sf)
    rows = batches.select("agent_id", "collected_at", "hostname", "id", F.explode("connections").alias("c"))
    t = rows.select("agent_id", "collected_at", "hostname", F.struct("id", "c.local_port").alias("id"), "c.*").withColumn("status", F.upper("status"))
    agents = views.agent_messages(spark, sf).groupBy("agent_id").agg(F.min("id").alias("id"))
    return _shown_connections(dashboard.list_telemetry(t, agents, "agent-3", 40).drop("id"))


@query("b18", f"SELECT l_tax, l_quantity, {big('l_linenumber', 'l_linenumber')}, l_discount, l_extendedprice FROM lineitem")
def b18(spark, sf):
    """Feature projection in contract order; a missing name fails at analysis time."""
    return plain(clean.require_columns(views.table(spark, sf, "lineitem"), ["l_tax", "l_quantity", "l_linenumber", "l_discount", "l_extendedprice"]))


@query(
    "b19",
    f"""SELECT CASE u % 5 WHEN 0 THEN 'missing: Idle Min' WHEN 1 THEN 'unexpected: Extra' WHEN 2 THEN 'not finite: Flow Duration'
        WHEN 3 THEN 'not a port or window: Destination Port' ELSE '' END AS violations, {n()}
    FROM (SELECT DISTINCT user_id AS u FROM events) GROUP BY 1""",
)
def b19(spark, sf):
    """Contract check of 67-feature maps with one injected fault each."""
    f = packets.flow_features(views.packets(spark, sf), idle_seconds=21_600.0)
    u = F.when(F.col("src_port") == 443, F.col("dst_port")).otherwise(F.col("src_port")) - 40_000
    base = F.map_from_arrays(F.array(*[F.lit(x) for x in FLOW_FEATURES]), F.array(*[F.col(f"`{x}`") for x in FLOW_FEATURES]))
    m = F.col("m")

    def put(name: str, value: float):
        return F.map_concat(F.map_filter(m, lambda k, v: k != name), F.create_map(F.lit(name), F.lit(value)))

    faulty = (
        F.when(F.col("u") % 5 == 0, F.map_filter(m, lambda k, v: k != "Idle Min"))
        .when(F.col("u") % 5 == 1, F.map_concat(m, F.create_map(F.lit("Extra"), F.lit(1.0))))
        .when(F.col("u") % 5 == 2, put("Flow Duration", float("inf")))
        .when(F.col("u") % 5 == 3, put("Destination Port", 80.5))
        .otherwise(m)
    )
    rows = f.select(u.alias("u"), base.alias("m")).select(faulty.alias("features"))
    checked = rows.select(F.array_join(validate.feature_violations("features"), "; ").alias("violations"))
    return plain(checked.groupBy("violations").agg(F.count("*").alias("n")))


@query(
    "b20",
    f"""SELECT event_id, {r("CASE WHEN l_orderkey % 3 = 0 THEN (SELECT avg(l_discount) FROM flows WHERE canonical_label = 'BENIGN') ELSE l_discount END", 'l_discount')},
      {r("CASE WHEN l_orderkey % 5 = 0 THEN (SELECT avg(l_tax) FROM flows WHERE canonical_label = 'BENIGN') ELSE l_tax END", 'l_tax')}, l_quantity,
      concat_ws(',', CASE WHEN l_orderkey % 3 = 0 THEN 'l_discount' END, CASE WHEN l_orderkey % 5 = 0 THEN 'l_tax' END) AS imputed_features FROM flows""",
    "flows",
)
def b20(spark, sf):
    """Absent features take the training mean, and are named."""
    f = views.flows(spark, sf)
    k = F.col("l_orderkey")
    names = ("l_quantity", "l_discount", "l_tax")
    scaler = profile.scaler_table(clean.benign_training_rows(f), names)
    entries = F.array_compact(
        F.array(
            F.struct(F.lit("l_quantity").alias("key"), F.col("l_quantity").alias("value")),
            F.when(k % 3 != 0, F.struct(F.lit("l_discount").alias("key"), F.col("l_discount").alias("value"))),
            F.when(k % 5 != 0, F.struct(F.lit("l_tax").alias("key"), F.col("l_tax").alias("value"))),
        )
    )
    sparse = f.select("event_id", F.map_from_entries(entries).alias("features"))
    return plain(impute_features(sparse, scaler, names).select("event_id", *names, "imputed_features"))


CONN_REASON = f"""CASE WHEN NOT {valid_ip('local_ip')} THEN 'local_ip' WHEN remote_ip IS NOT NULL AND NOT {valid_ip('remote_ip')} THEN 'remote_ip'
  WHEN local_port > 65535 THEN 'local_port' WHEN protocol NOT IN ('TCP', 'UDP') THEN 'protocol' WHEN status = 'BOGUS' THEN 'status' ELSE '' END"""


@query("b21", f"SELECT {CONN_REASON} AS reason, {n()} FROM conns GROUP BY 1", "conns")
def b21(spark, sf):
    """Connection rows: valid ones and the quarantine by first violated rule."""
    good, bad = validate.split_connections(explode(spark, sf))
    rows = good.select(F.lit("").alias("reason")).unionAll(bad.select("reason"))
    return plain(rows.groupBy("reason").agg(F.count("*").alias("n")))


def explode(spark, sf):
    return validate.explode_connections(views.telemetry_batches(spark, sf))


NAMES_SQL = "CASE event_id % 6 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'ICMP' WHEN 3 THEN 'GRE' WHEN 4 THEN 'IP-PROTO-' || (event_id % 140) ELSE 'IP-PROTO-x' END"


@query(
    "b22",
    f"""SELECT name, coalesce(CASE name WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 END,
      try_cast(regexp_extract(name, '^IP-PROTO-([0-9]+)$', 1) AS BIGINT), -1) AS number, {n()} FROM (SELECT {NAMES_SQL} AS name FROM events) GROUP BY 1, 2""",
)
def b22(spark, sf):
    e = views.table(spark, sf, "events")
    k = F.col("event_id")
    name = (
        F.when(k % 6 == 0, "TCP").when(k % 6 == 1, "UDP").when(k % 6 == 2, "ICMP").when(k % 6 == 3, "GRE")
        .when(k % 6 == 4, F.concat(F.lit("IP-PROTO-"), (k % 140).cast("string"))).otherwise("IP-PROTO-x")
    )
    g = e.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return plain(g.withColumn("number", F.coalesce(net.protocol_number("name"), F.lit(-1)).cast("long")))


@query(
    "b23",
    f"""SELECT number, coalesce(CASE number WHEN 1 THEN 'ICMP' WHEN 2 THEN 'IGMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 41 THEN 'IPv6-ENCAP'
      WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP' WHEN 51 THEN 'AH' WHEN 58 THEN 'ICMPv6' WHEN 89 THEN 'OSPF' WHEN 132 THEN 'SCTP' END, 'IP-PROTO-' || number) AS name, {n()}
    FROM (SELECT event_id % 256 AS number FROM events) GROUP BY 1, 2""",
)
def b23(spark, sf):
    g = views.table(spark, sf, "events").groupBy((F.col("event_id") % 256).alias("number")).agg(F.count("*").alias("n"))
    return plain(g.withColumn("name", net.protocol_name("number")))


TARGET_SQL = """CASE c_custkey % 10 WHEN 0 THEN '10.0.0.' || (c_custkey % 256) WHEN 1 THEN ' 192.168.56.' || (c_custkey % 256) || ' ' WHEN 2 THEN '224.0.0.' || (c_custkey % 256)
  WHEN 3 THEN '0.0.0.0' WHEN 4 THEN '255.255.255.255' WHEN 5 THEN '250.1.2.' || (c_custkey % 256) WHEN 6 THEN '127.0.0.1' WHEN 7 THEN '8.8.8.' || (c_custkey % 256)
  WHEN 8 THEN '10.0.0.0' || (c_custkey % 9) ELSE c_name END"""


@query(
    "b24",
    f"""SELECT ip, scope, reason, {n()} FROM (SELECT ip, CASE WHEN kind = 'inside' THEN net END AS scope, CASE kind
        WHEN 'malformed' THEN '''' || t || ''' cannot be read as an IP address' WHEN 'multicast' THEN t || ' addresses a multicast group, no single host'
        WHEN 'unspecified' THEN t || ' stands for no host'
        WHEN 'broadcast' THEN t || ' reaches every host of the network'
        WHEN 'reserved' THEN t || ' lies in a range reserved by IANA'
        WHEN 'loopback' THEN t || ' belongs to this host; pass allow_loopback to target it'
        WHEN 'outside' THEN t || ' is in none of the lab networks (10.0.0.0/25,192.168.56.0/24)' END AS reason
      FROM (SELECT *, CASE WHEN v BETWEEN 167772160 AND 167772287 THEN '10.0.0.0/25' WHEN v BETWEEN 3232249856 AND 3232250111 THEN '192.168.56.0/24' END AS net,
          CASE WHEN v IS NULL THEN 'malformed' WHEN v >= 3758096384 AND v < 4026531840 THEN 'multicast' WHEN v = 0 THEN 'unspecified'
            WHEN v = 4294967295 THEN 'broadcast' WHEN v >= 4026531840 THEN 'reserved' WHEN v BETWEEN 2130706432 AND 2147483647 THEN 'loopback'
            WHEN v BETWEEN 167772160 AND 167772287 OR v BETWEEN 3232249856 AND 3232250111 THEN 'inside' ELSE 'outside' END AS kind
        FROM (SELECT *, CASE WHEN {valid_ip('t')} THEN CAST(p[1] AS BIGINT) * 16777216 + CAST(p[2] AS BIGINT) * 65536 + CAST(p[3] AS BIGINT) * 256 + CAST(p[4] AS BIGINT) END AS v
          FROM (SELECT ip, trim(ip) AS t, string_split(trim(ip), '.') AS p FROM (SELECT {TARGET_SQL} AS ip FROM customer))))) GROUP BY 1, 2, 3""",
)
def b24(spark, sf):
    """Response target scope: the first matching class or network, else the reason."""
    c = views.table(spark, sf, "customer")
    k = F.col("c_custkey")
    last = (k % 256).cast("string")
    ip = (
        F.when(k % 10 == 0, F.concat(F.lit("10.0.0."), last))
        .when(k % 10 == 1, F.concat(F.lit(" 192.168.56."), last, F.lit(" ")))
        .when(k % 10 == 2, F.concat(F.lit("224.0.0."), last))
        .when(k % 10 == 3, "0.0.0.0")
        .when(k % 10 == 4, "255.255.255.255")
        .when(k % 10 == 5, F.concat(F.lit("250.1.2."), last))
        .when(k % 10 == 6, "127.0.0.1")
        .when(k % 10 == 7, F.concat(F.lit("8.8.8."), last))
        .when(k % 10 == 8, F.concat(F.lit("10.0.0.0"), (k % 9).cast("string")))
        .otherwise(F.col("c_name"))
    )
    g = c.groupBy(ip.alias("ip")).agg(F.count("*").alias("n"))
    s = g.withColumn("s", net.target_scope("ip", "10.0.0.0/25,192.168.56.0/24"))
    return plain(s.select("ip", "s.scope", "s.reason", "n"))


@query(
    "b25",
    f"""SELECT dst_ip AS ip, {big('sum(attack_flow_count)', 'attack_flow_count')}, {big('sum(flow_count)', 'total_flow_count')} FROM edges
    WHERE contains(lower(dst_ip), '0.1') GROUP BY 1 ORDER BY total_flow_count DESC, ip LIMIT 10 OFFSET 10""",
    "edges",
)
def b25(spark, sf):
    """Destination search, second page by total flows."""
    totals = graph.top_totals(views.edges(spark, sf), "dst_ip", None)
    return plain(dashboard.destination_pages(totals, " 0.1 ", "total-desc", 1))


@query("b26", f"SELECT {n('', 'records')}, {n('seq % 31 <> 0 AND seq % 37 <> 0', 'accepted')}, {n('seq % 31 = 0 OR seq % 37 = 0', 'rejected')} FROM packets", "packets")
def b26(spark, sf):
    """Packets without source, destination, protocol or time are rejected and counted."""
    p = views.packets(spark, sf).withColumns(
        {"src_ip": F.when(F.col("seq") % 31 == 0, "").otherwise(F.col("src_ip")), "protocol": F.when(F.col("seq") % 37 != 0, F.col("protocol"))}
    )
    return plain(packets.packet_quality(p))


@query(
    "b27",
    """SELECT field, CASE WHEN field IN ('Flow ID', 'Timestamp') THEN field ELSE ' ' || field END AS found_column, true AS present
    FROM (SELECT unnest(['Flow ID', 'Source IP', 'Source Port', 'Destination IP', 'Destination Port', 'Protocol', 'Timestamp', 'Label']) AS field)
    UNION ALL SELECT 'Absent', NULL, false UNION ALL SELECT 'Label', NULL, false""",
)
def b27(spark, sf):
    """Required header fields per file, matched after stripping."""
    from flowloom.schemas import REQUIRED_TOPOLOGY_FIELDS

    headers = written_layouts(spark, sf, "b27")
    found = profile.required_field_presence(headers, [*REQUIRED_TOPOLOGY_FIELDS, "Absent"])
    return found.groupBy("field", "found_column").agg(F.bool_and("present").alias("present"))
