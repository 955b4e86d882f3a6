"""SQL twins of the views, as named common table expressions."""

from __future__ import annotations

from flowloom.functions.net import REASON_OUTSIDE
from flowloom.plans.views import POLICY

#: The text that the response policy gives to a target outside its networks.
OUTSIDE = "'" + REASON_OUTSIDE % ("' || src_ip || '", POLICY.lab_cidrs) + "'"

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def ts(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, {TS}) AS {name or expr.split('.')[-1]}"


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def n(where: str = "", name: str = "n") -> str:
    return f"CAST(count(*){f' FILTER (WHERE {where})' if where else ''} AS BIGINT) AS {name}"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


V4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def valid_ip(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '{V4}') OR regexp_matches({c}, '^fd00::[0-9]$'), false)"


def valid_port(c: str) -> str:
    d = f"try_cast({c} AS DOUBLE)"
    return f"coalesce({d} BETWEEN 0 AND 65535 AND {d} = floor({d}), false)"


def day_first(c: str) -> str:
    return f"try_strptime({c}, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y %H:%M'])"


def month_first(c: str) -> str:
    return f"try_strptime({c}, ['%m/%d/%Y %H:%M:%S', '%m/%d/%Y %H:%M', '%Y-%m-%d %H:%M:%S', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M'])"


CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (needs, body)


cte(
    "flows",
    "",
    """
  SELECT *, CASE WHEN canonical_label = 'BENIGN' THEN 'BENIGN' ELSE 'ATTACK' END AS traffic_class FROM (
    SELECT *, CASE WHEN original_label = 'Web Attack ' || chr(65533) || ' XSS' THEN 'Web Attack - XSS'
                   ELSE original_label END AS canonical_label FROM (
      SELECT *,
        '10.0.' || (l_suppkey // 256) || '.' || (l_suppkey % 256) AS src_ip,
        CAST(1024 + l_orderkey % 64000 AS BIGINT) AS src_port,
        '10.1.0.' || (l_partkey % 50) AS dst_ip,
        CAST(20 + l_linenumber AS BIGINT) AS dst_port,
        CAST(CASE WHEN l_linestatus = 'O' THEN 6 ELSE 17 END AS BIGINT) AS protocol,
        l_shipdate AS ts, l_quantity AS fwd_bytes, l_extendedprice AS bwd_bytes,
        CASE WHEN l_returnflag <> 'R' THEN 'BENIGN' WHEN l_linenumber = 1 THEN 'DDoS' WHEN l_linenumber = 2 THEN 'PortScan'
             WHEN l_linenumber = 3 THEN 'Bot' WHEN l_linenumber = 4 THEN 'Web Attack ' || chr(65533) || ' XSS'
             ELSE 'DoS Hulk' END AS original_label,
        'capture_' || (l_linenumber % 3) || '.csv' AS source_file,
        l_discount * l_quantity / 50.0 AS anomaly_score,
        md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT),
                      CAST(l_quantity AS BIGINT), strftime(l_shipdate, '%Y-%m-%d'))) AS event_id
      FROM lineitem))""",
)
cte(
    "raw_flows",
    "flows",
    """
  SELECT event_id AS "Flow ID",
    CASE WHEN l_orderkey % 97 = 0 THEN '10.0.300.1' WHEN l_orderkey % 73 = 0 THEN 'fd00::' || (l_suppkey % 10) ELSE src_ip END AS "Source IP",
    CASE WHEN l_orderkey % 89 = 0 THEN '70000' ELSE CAST(src_port AS VARCHAR) END AS "Source Port",
    dst_ip AS "Destination IP", CAST(dst_port AS VARCHAR) AS "Destination Port", CAST(protocol AS VARCHAR) AS "Protocol",
    CASE WHEN l_orderkey % 83 = 0 THEN 'not-a-time' ELSE strftime(ts, '%-d/%-m/%Y %-H:%M:%S') END AS "Timestamp",
    CASE WHEN l_orderkey % 79 = 0 THEN 'n/a' ELSE CAST(CAST(trunc(fwd_bytes) AS BIGINT) AS VARCHAR) END AS "Total Length of Fwd Packets",
    CAST(CAST(trunc(bwd_bytes) AS BIGINT) AS VARCHAR) AS "Total Length of Bwd Packets",
    original_label AS "Label", source_file
  FROM flows
  UNION ALL
  SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, source_file FROM flows WHERE l_orderkey % 101 = 0""",
)
cte(
    "marked",
    "raw_flows",
    f"""
  SELECT *, CASE
      WHEN "Flow ID" IS NULL AND "Source IP" IS NULL AND "Source Port" IS NULL AND "Destination IP" IS NULL AND "Label" IS NULL THEN 'blank'
      WHEN NOT ({valid_ip('"Source IP"')} AND {valid_ip('"Destination IP"')}) THEN 'ip'
      WHEN NOT ({valid_port('"Source Port"')} AND {valid_port('"Destination Port"')}) THEN 'port'
      WHEN {day_first('"Timestamp"')} IS NULL THEN 'timestamp' END AS reject_reason
  FROM raw_flows""",
)
cte(
    "clean",
    "marked",
    f"""
  SELECT "Source IP" AS src_ip, CAST("Source Port" AS BIGINT) AS src_port, "Destination IP" AS dst_ip,
    CAST("Destination Port" AS BIGINT) AS dst_port, CAST("Protocol" AS BIGINT) AS protocol, {day_first('"Timestamp"')} AS ts,
    coalesce(try_cast("Total Length of Fwd Packets" AS DOUBLE), 0.0) AS fwd_bytes,
    coalesce(try_cast("Total Length of Bwd Packets" AS DOUBLE), 0.0) AS bwd_bytes,
    CASE WHEN "Label" LIKE 'Web Attack%XSS' THEN 'Web Attack - XSS' ELSE "Label" END AS canonical_label, source_file
  FROM marked WHERE reject_reason IS NULL""",
)
cte(
    "stat_flows",
    "flows",
    """
  SELECT *, CASE WHEN l_orderkey % 311 = 0 THEN CAST('inf' AS DOUBLE) WHEN l_orderkey % 457 = 0 THEN CAST('nan' AS DOUBLE)
                 ELSE l_extendedprice / l_quantity END AS bytes_s,
            CASE WHEN l_orderkey % 613 = 0 THEN CAST('-inf' AS DOUBLE) ELSE l_quantity * 2.0 END AS packets_s FROM (
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, canonical_label, source_file FROM flows
    UNION ALL
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, canonical_label, 'recapture.csv'
    FROM flows WHERE l_orderkey % 50 = 0)""",
)
EDGE_AGG = """
    CAST(count(*) AS BIGINT) AS flow_count,
    CAST(count(*) FILTER (WHERE canonical_label = 'BENIGN') AS BIGINT) AS benign_flow_count,
    CAST(count(*) FILTER (WHERE canonical_label <> 'BENIGN') AS BIGINT) AS attack_flow_count,
    round(count(*) FILTER (WHERE canonical_label <> 'BENIGN') / CAST(count(*) AS DOUBLE), 6) AS attack_ratio,
    CAST(count(DISTINCT src_port) AS BIGINT) AS unique_source_ports,
    CAST(count(DISTINCT dst_port) AS BIGINT) AS unique_destination_ports,
    list_sort(list(DISTINCT protocol)) AS protocols_seen, min(ts) AS first_seen, max(ts) AS last_seen,
    CAST(sum(CAST(trunc(fwd_bytes) AS BIGINT)) AS BIGINT) AS total_forward_bytes,
    CAST(sum(CAST(trunc(bwd_bytes) AS BIGINT)) AS BIGINT) AS total_backward_bytes,
    list_sort(list(DISTINCT canonical_label) FILTER (WHERE canonical_label <> 'BENIGN')) AS attack_labels"""
cte("edges", "flows", f"SELECT src_ip, dst_ip, {EDGE_AGG} FROM flows GROUP BY src_ip, dst_ip")
EDGE_OUT = (
    "src_ip, dst_ip, flow_count, benign_flow_count, attack_flow_count, attack_ratio, unique_source_ports, unique_destination_ports, "
    "array_to_string(protocols_seen, ',') AS protocols_seen, "
    + ts("first_seen") + ", " + ts("last_seen")
    + ", total_forward_bytes, total_backward_bytes, coalesce(array_to_string(attack_labels, ','), '') AS attack_labels"
)
cte(
    "ends",
    "edges",
    """
  SELECT src_ip AS ip, 1 AS is_source, flow_count, benign_flow_count, attack_flow_count FROM edges
  UNION ALL SELECT dst_ip, 0, flow_count, benign_flow_count, attack_flow_count FROM edges""",
)
cte(
    "nodes",
    "ends",
    """
  SELECT ip, CAST(sum(flow_count) AS BIGINT) AS total_flow_count, CAST(sum(benign_flow_count) AS BIGINT) AS benign_flow_count,
    CAST(sum(attack_flow_count) AS BIGINT) AS attack_flow_count,
    round(sum(attack_flow_count) / CAST(sum(flow_count) AS DOUBLE), 6) AS attack_ratio,
    CAST(count(*) FILTER (WHERE is_source = 0) AS BIGINT) AS in_degree,
    CAST(count(*) FILTER (WHERE is_source = 1) AS BIGINT) AS out_degree, CAST(count(*) AS BIGINT) AS degree,
    CAST(count(*) FILTER (WHERE is_source = 0) AS BIGINT) AS unique_source_count,
    CAST(count(*) FILTER (WHERE is_source = 1) AS BIGINT) AS unique_destination_count
  FROM ends GROUP BY ip""",
)
cte(
    "sparse",
    "",
    "SELECT DISTINCT 'o' || l_orderkey AS src_ip, 'o' || (l_orderkey - l_orderkey % 8 + CASE WHEN l_linenumber = 4 AND l_partkey % 8 = 0 THEN 8 ELSE 0 END) AS dst_ip FROM lineitem",
)
cte(
    "context",
    "edges",
    """
  SELECT src_ip, dst_ip, attack_ratio AS edge_attack_ratio, attack_flow_count AS edge_attack_flow_count,
    flow_count AS edge_flow_count, first_seen AS edge_first_seen, last_seen AS edge_last_seen,
    CAST(coalesce(len(attack_labels), 0) AS BIGINT) AS edge_attack_label_count FROM edges""",
)


def factor_ctes(source: str, out: str, threshold: float, activity: str, hours: str, prefix: str = "") -> None:
    """Risk score over ``source`` (anomaly_score and edge columns)."""
    cte(
        f"{out}_f",
        source,
        f"""
  SELECT *, 1 - exp(-anomaly_score / {threshold}) AS f1,
    coalesce(greatest(0.0, least(1.0, edge_attack_ratio)), 0.0) AS f2,
    CASE WHEN coalesce(edge_attack_flow_count, 0) <= 0 THEN 0.0
         ELSE least(1.0, ln(1 + edge_attack_flow_count) / ln(1 + {activity})) END AS f3,
    coalesce(least(1.0, greatest(0.0, (epoch_us(edge_last_seen) - epoch_us(edge_first_seen)) / 3.6e9) / {hours}), 0.0) AS f4,
    CASE WHEN coalesce(edge_attack_label_count, 0) <= 0 THEN 0.0 ELSE least(1.0, edge_attack_label_count / 3.0) END AS f5
  FROM {source}""",
    )
    cte(
        f"{out}_r",
        f"{out}_f",
        f"""
  SELECT *, 0.40 * f1 + 0.25 * f2 + 0.15 * f3 + 0.10 * f4 + 0.10 * f5 AS raw,
    coalesce(edge_attack_ratio, 0) >= 0.7 AND coalesce(edge_flow_count, 0) >= 10 AS rule1, f1 >= 0.9 AS rule2,
    coalesce(edge_attack_flow_count, 0) <= 1 AND coalesce(edge_flow_count, 0) <= 2 AND f1 < 0.5 AS rule3
  FROM {out}_f""",
    )
    cte(
        out,
        f"{out}_r",
        f"""
  SELECT *, round(final, 4) AS risk_score,
    CASE WHEN final < 2 THEN 'Very Low' WHEN final < 4 THEN 'Low' WHEN final < 6 THEN 'Moderate' WHEN final < 8 THEN 'High'
         ELSE 'Critical' END AS risk_level,
    concat_ws(',', CASE WHEN rule1 THEN 'repeated_attack_heavy_communication' END, CASE WHEN rule2 THEN 'very_high_anomaly' END,
              CASE WHEN rule3 THEN 'isolated_low_volume_weak_evidence' END) AS rules_applied
  FROM (SELECT *, greatest(1.0, least(10.0, 1 + 9 * greatest(0.0, least(1.0, raw)) + CASE WHEN rule1 THEN 0.5 ELSE 0 END
          + CASE WHEN rule2 THEN 0.5 ELSE 0 END - CASE WHEN rule3 THEN 0.5 ELSE 0 END)) AS final FROM {out}_r)""",
    )


cte(
    "tagged",
    "flows context",
    """
  SELECT f.*, f.anomaly_score >= 0.05 AS is_anomaly, 0.05 AS threshold_used,
    CASE f.l_linenumber % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'offline_demo' ELSE 'test_event' END AS source,
    f.ts + to_minutes(f.l_linenumber) AS created_at, c.* EXCLUDE (src_ip, dst_ip)
  FROM flows f LEFT JOIN context c ON f.src_ip = c.src_ip AND f.dst_ip = c.dst_ip""",
)
factor_ctes("tagged", "scored", 0.05, "10.0", "40000.0")
EXPLAINED = """
  SELECT *, CASE WHEN len(phrases) > 0 THEN array_to_string(phrases, ' combined with ') ELSE 'No significant risk factors observed' END
    || CASE WHEN len(rule_texts) > 0 THEN '; adjusted for ' || array_to_string(rule_texts, ', ') ELSE '' END AS reason
  FROM (SELECT *,
    list_transform(list_filter(ranked[1:2], lambda x: x.v > 0), lambda x:
      CASE WHEN x.v >= 0.6 THEN 'High ' WHEN x.v >= 0.3 THEN 'Moderate ' ELSE 'Low ' END || x.words) AS phrases,
    list_filter([CASE WHEN rule1 THEN 'repeated attack-heavy communication' END, CASE WHEN rule2 THEN 'an extreme anomaly deviation' END,
      CASE WHEN rule3 THEN 'isolated low-volume evidence (risk reduced)' END], lambda x: x IS NOT NULL) AS rule_texts
    FROM (SELECT *, list_sort([
      {'c': -round(0.40 * f1, 4), 'p': 0, 'v': round(f1, 4), 'name': 'anomaly_severity', 'words': 'anomaly deviation'},
      {'c': -round(0.25 * f2, 4), 'p': 1, 'v': round(f2, 4), 'name': 'edge_attack_ratio', 'words': 'attack-heavy communication'},
      {'c': -round(0.15 * f3, 4), 'p': 2, 'v': round(f3, 4), 'name': 'attack_activity', 'words': 'attack traffic volume'},
      {'c': -round(0.10 * f4, 4), 'p': 3, 'v': round(f4, 4), 'name': 'temporal_persistence', 'words': 'sustained activity over time'},
      {'c': -round(0.10 * f5, 4), 'p': 4, 'v': round(f5, 4), 'name': 'attack_context', 'words': 'history of diverse attack categories on this edge'}
      ]) AS ranked FROM scored))"""
cte("explained", "scored", EXPLAINED)
cte(
    "ev",
    "tagged",
    """
  SELECT event_id AS id, CASE source WHEN 'live' THEN 'live-' WHEN 'offline_demo' THEN 'offline-demo-' ELSE 'test-' END || event_id AS event_uid,
    ts AS timestamp, src_ip AS source_ip, src_port AS source_port, dst_ip AS destination_ip, dst_port AS destination_port, protocol,
    canonical_label AS canonical_attack_label, traffic_class, source, 'processed' AS status, created_at FROM tagged""",
)
cte(
    "det",
    "tagged",
    """
  SELECT event_id AS id, event_id, anomaly_score, anomaly_score AS reconstruction_error, is_anomaly, threshold_used
  FROM tagged WHERE l_linenumber <> 7""",
)
cte(
    "risk",
    "explained",
    """
  SELECT event_id AS id, event_id, event_id AS detection_id, risk_score, risk_level, rules_applied, reason, created_at
  FROM explained WHERE l_linenumber < 6""",
)
cte(
    "act",
    "scored",
    f"""
  SELECT event_id AS id, event_id, src_ip AS source_ip, risk_score, risk_level,
    CASE WHEN risk_score >= 6.0 THEN 'block' ELSE 'alert' END AS requested_action,
    CASE WHEN risk_score < 6.0 THEN 'alerted' WHEN inside THEN 'would_block' ELSE 'rejected' END AS actual_action,
    risk_score >= 6.0 AS dry_run, risk_score < 6.0 OR inside AS success,
    CASE WHEN risk_score < 6.0 THEN 'risk_score ' || printf('%.2f', risk_score) || ' crossed alert threshold 4.0'
         WHEN inside THEN 'Dry-run: would block ' || src_ip || ' (risk_score ' || printf('%.2f', risk_score) || ' crossed block threshold 6.0)'
         ELSE {OUTSIDE} END AS reason,
    'lab' AS adapter, CASE WHEN risk_score >= 6.0 AND inside THEN '10.0.0.0/27' END AS target_scope, created_at
  FROM (SELECT *, l_suppkey < 32 AS inside FROM scored) WHERE risk_score >= 4.0""",
)
cte(
    "runs",
    "",
    """
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'autoencoder' ELSE 'knn' END AS component,
    sha256(o_orderstatus || o_orderpriority) AS content_hash, o_totalprice / 1e6 AS f1, o_orderdate AS created_at,
    o_orderstatus, o_orderpriority FROM orders""",
)
cte(
    "run_log",
    "runs",
    """
  SELECT * EXCLUDE (before) FROM (SELECT *, lag(content_hash) OVER (PARTITION BY component ORDER BY id) AS before FROM runs)
  WHERE content_hash IS DISTINCT FROM before""",
)
cte(
    "packets",
    "",
    """
  SELECT ts, event_id AS seq, event_id % 2 = 0 AS outbound,
    '172.16.' || (user_id // 256) || '.' || (user_id % 256) AS client, CAST(40000 + user_id % 20000 AS BIGINT) AS client_port,
    CAST(trunc(value) AS BIGINT) AS len, 20 + (event_id % 4) * 4 AS head, greatest(0, CAST(trunc(value) AS BIGINT) - 20) AS payload,
    event_type = 'purchase' AS fin, event_type = 'signup' AS syn, event_type = 'error' AS rst, event_type = 'view' AS psh,
    event_type IN ('click', 'view') AS ack, CASE WHEN event_id % 5 <> 0 THEN event_id % 65536 END AS win, epoch_us(ts) AS t
  FROM events""",
)
cte(
    "batches",
    "",
    """
  SELECT 'agent-' || user_id AS agent_id, ts AS collected_at, 'host-' || (event_id % 7) AS hostname, event_id AS id FROM events""",
)
cte(
    "conns",
    "",
    """
  SELECT agent_id, collected_at, hostname, id,
    CASE WHEN k % 11 = 0 THEN '300.1.1.1' ELSE '10.9.0.' || (k % 200) END AS local_ip,
    CASE WHEN k % 13 = 0 THEN 70000 ELSE k % 60000 END AS local_port,
    CASE WHEN k % 4 <> 0 THEN '10.8.0.' || (k % 250) END AS remote_ip,
    CASE WHEN k % 4 <> 0 THEN k % 50000 END AS remote_port,
    CASE WHEN k % 17 = 0 THEN 'SCTP' WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol,
    CASE k % 5 WHEN 0 THEN 'ESTABLISHED' WHEN 1 THEN 'LISTEN' WHEN 2 THEN 'TIME_WAIT' WHEN 3 THEN 'BOGUS' END AS status
  FROM (SELECT 'agent-' || user_id AS agent_id, ts AS collected_at, 'host-' || (event_id % 7) AS hostname, event_id AS id,
          event_id + unnest(range(1, CAST(event_id % 4 AS BIGINT) + 1)) AS k FROM events)""",
)
cte(
    "messages",
    "",
    """
  SELECT event_id AS id, 'agent-' || user_id AS agent_id, ts,
    CASE WHEN event_type = 'signup' THEN 'host-' || (event_id % 7) END AS hostname,
    CASE WHEN event_type = 'signup' OR event_id % 3 = 0 THEN '10.9.0.' || (event_id % 200) WHEN event_id % 3 = 1 THEN '' END AS ip_address,
    CASE WHEN event_type = 'signup' THEN '1.' || (event_id % 4) END AS agent_version FROM events""",
)


def sql(needs: str, body: str, recursive: bool = False) -> str:
    """A query with the CTEs it needs, in dependency order."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for dep in CTES[name][0].split():
                add(dep)
            done.append(name)

    for name in needs.split():
        add(name)
    if not done:
        return body.strip()
    head = ",\n".join(f"{name} AS ({CTES[name][1].strip()})" for name in done)
    word = "WITH RECURSIVE" if recursive else "WITH"
    body = body.strip()
    if body.startswith("WITH "):
        return f"{word} {head},\n{body[5:]}"
    return f"{word} {head}\n{body}"
