"""Cleaning, graph, risk and policy on small hand-built tables."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowloom.functions import net, parsing
from flowloom.functions.labels import canonical_label
from flowloom.functions.policy import decide, response_actions
from flowloom.functions.risk import score_risk
from flowloom.operators import clean, components, context, graph, metrics, ordered, profile, split
from flowloom.schemas import TOPOLOGY_COLUMNS, PolicyConfig, RiskConfig

A, B, C = "10.0.0.1", "10.0.0.2", "10.0.0.3"
RAW = [
    ("1", A, "100", B, "80", "6", "3/7/2017 08:00:00", "10", "5", "BENIGN"),
    ("2", A, "101", B, "80", "6", "3/7/2017 09:00", "10", "5", "BENIGN"),
    ("3", A, "102", B, "443", "17", "3/7/2017 07:00:00", "15", "7", "DDoS"),
    ("4", B, "103", C, "22", "6", "3/7/2017 10:00:00", "bad", "1", "PortScan"),
    (None,) * 10,
]


def raw(spark, rows=RAW):
    schema = ", ".join(f"`{c}` string" for c in TOPOLOGY_COLUMNS)
    return spark.createDataFrame(rows, schema).withColumn("source_file", F.lit("a.csv"))


def test_graph_build_from_raw_rows(spark):
    df = raw(spark)
    account = clean.reject_accounting(df).first()
    assert (account.raw_rows, account.blank_rows, account.valid_rows) == (5, 1, 4)
    edges = graph.build_edges(clean.clean_flows(df))
    e = edges.filter(F.col("src_ip") == A).first()
    assert (e.flow_count, e.benign_flow_count, e.attack_flow_count, e.attack_ratio) == (3, 2, 1, 0.333333)
    assert (e.unique_source_ports, e.unique_destination_ports, e.protocols_seen) == (3, 2, [6, 17])
    assert (e.total_forward_bytes, e.total_backward_bytes, e.attack_labels) == (35, 17, ["DDoS"])
    assert (e.first_seen.hour, e.last_seen.hour) == (7, 9)
    nodes = {n.ip: n for n in graph.build_nodes(edges).collect()}
    assert len(nodes) == 3
    assert (nodes[B].total_flow_count, nodes[B].benign_flow_count, nodes[B].attack_ratio) == (4, 2, 0.5)
    window = clean.clean_flows(df).filter(clean.within_window("ts", "2017-07-03 08:30:00", "2017-07-03 10:30:00"))
    assert window.count() == 2


def test_edges_hold_all_protocols_and_shuffle_flows_once(spark):
    sets = [[0, 63, 64, 127, 128, 191, 192, 255], [63], [17, 6], [255, 1], [None], list(range(256))]
    rows = [(f"10.0.0.{i}", B, 1000 + j % 3, 80 if j % 2 else None, p, "BENIGN") for i, ps in enumerate(sets) for j, p in enumerate(ps)]
    flows = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, canonical_label string")
    edges = graph.build_edges(flows.withColumns({"ts": F.lit("2017-07-03").cast("timestamp"), "fwd_bytes": F.lit(1.0), "bwd_bytes": F.lit(1.0)}))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan
    got = {e.src_ip: (e.protocols_seen, e.unique_source_ports, e.unique_destination_ports) for e in edges.collect()}
    assert got == {f"10.0.0.{i}": (sorted(p for p in ps if p is not None), min(3, len(ps)), min(1, len(ps) // 2)) for i, ps in enumerate(sets)}
    assert "sequence(0, 255" not in edges._jdf.queryExecution().analyzed().toString()  # no walk over all numbers for every edge


@pytest.mark.parametrize(
    ("column", "value", "reason"),
    [("Source IP", "1.2.3.256", "ip"), ("Destination IP", "01.2.3.4", "ip"), ("Source Port", "70000", "port"), ("Destination Port", "1.5", "port"), ("Timestamp", "yesterday", "timestamp")],
)
def test_first_failed_check_is_counted(spark, column, value, reason):
    row = list(RAW[0])
    row[TOPOLOGY_COLUMNS.index(column)] = value
    assert clean.mark_rejects(raw(spark, [tuple(row)])).first().reject_reason == reason


def test_unknown_label_and_missing_column_raise(spark):
    row = list(RAW[0])
    row[-1] = "Something"
    with pytest.raises(PySparkException):
        clean.clean_flows(raw(spark, [tuple(row)])).collect()
    with pytest.raises(ValueError, match="missing"):
        clean.mark_rejects(raw(spark).drop("Label"))
    labels = spark.createDataFrame([("Web Attack � XSS",), ("Web Attack \x96 XSS",), ("Bot",)], "l string")
    assert [r[0] for r in labels.select(canonical_label("l")).collect()] == ["Web Attack - XSS", "Web Attack - XSS", "Bot"]
    assert labels.select(canonical_label("l", topology=False, strict=False)).collect()[1][0] is None


def test_addresses(spark):
    import ipaddress

    texts = [
        "1.2.3.4", "01.2.3.4", "1.2.3", "255.255.255.255", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4::5:6:7:8", "1::2::3",
        "fe80::1%eth0", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "12345::", "g::1", "", " 10.0.0.1 ", "2001:db8::a:b", ":1", "1:", "1:2:3:4:5:6:7:8:9",
    ]

    def valid(t):
        try:
            ipaddress.ip_address(t.strip())
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", net.is_valid_ip("t").alias("ok"), net.address_hex("t").alias("hex")).collect():
        assert row.ok == valid(row.t), row.t
        if row.ok:
            address = ipaddress.ip_address(row.t.strip())
            assert int(row.hex, 16) == int(address), row.t


def test_target_scope_order(spark):
    cases = {"192.168.56.9": "192.168.56.0/24", "127.0.0.1": None, "224.0.0.1": None, "0.0.0.0": None, "255.255.255.255": None, "8.8.8.8": None, "x": None, "fd00::5": "fd00::/16"}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    cidrs = "192.168.56.0/24, nonsense, fd00::/16"
    rows = df.select("ip", net.target_scope("ip", cidrs).alias("s")).collect()
    assert {r.ip: r.s.scope for r in rows} == cases
    words = {r.ip: r.s.reason for r in rows}
    assert "loopback" in words["127.0.0.1"] and "every host" in words["255.255.255.255"] and "cannot be read" in words["x"]
    allowed = df.filter("ip = '127.0.0.1'").select(net.target_scope("ip", cidrs, True).alias("s")).first().s
    assert allowed.scope.startswith("loopback") and allowed.reason is None


def test_two_decimals_follow_the_binary_value(spark):
    values = [round(random.Random(7).uniform(1, 10), 4) for _ in range(200)] + [i / 1000 for i in range(1005, 9999, 10)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", parsing.two_decimals("v").alias("t")).collect():
        assert row.t == f"{row.v:.2f}"


def test_dedup_and_infinite_guard(spark):
    rows = [(1, "x", "b.csv"), (1, "x", "a.csv"), (1, "x", "a.csv"), (2, "y", "a.csv")]
    kept = clean.drop_exact_duplicates(spark.createDataFrame(rows, "d long, l string, source_file string")).collect()
    assert sorted((r.d, r.source_file, r.copies) for r in kept) == [(1, "a.csv", 3), (2, "a.csv", 1)]
    inf = float("inf")
    data = [(inf, 1.0, "DDoS"), (1.0, inf, "DDoS"), (inf, 2.0, "BENIGN"), (1.0, 1.0, "BENIGN"), (2.0, 1.0, "BENIGN")]
    df = spark.createDataFrame(data, "`Flow Bytes/s` double, `Flow Packets/s` double, canonical_label string")
    cols = ("Flow Bytes/s", "Flow Packets/s")
    stats = clean.infinite_stats(df, cols).first()
    assert (stats["inf Flow Bytes/s"], stats["inf Flow Packets/s"], stats.affected_rows) == (2, 1, 3)
    kept, bad = clean.split_infinite(df, cols)
    assert (kept.count(), bad.count()) == (2, 3)
    with pytest.raises(RuntimeError):
        clean.stop_if_infinite(df, cols)
    many = spark.range(1000).select(F.when(F.col("id") == 0, inf).otherwise(1.0).alias("v"))
    assert [x.count() for x in clean.split_infinite(many, ["v"])] == [999, 1]


def test_split_is_exact_disjoint_and_covering(spark):
    df = spark.range(302).select("id", F.when(F.col("id") < 300, (F.col("id") % 3).cast("string")).otherwise("rare").alias("l"))
    parts = split.stratified_split(df, "l", F.col("id")).groupBy("l", "split").count().collect()
    sizes = {(r.l, r.split): r["count"] for r in parts}
    for label in "012":
        assert [sizes[(label, s)] for s in ("train", "val", "test")] == [70, 15, 15]
    assert sizes[("rare", "train")] == 2 and sum(sizes.values()) == 302


def test_split_cuts_at_half_a_row_are_rounded_up(spark):
    """0.7 * 45 is 31.5 and 0.7 * 85 is 59.5, which doubles put just below the half."""
    df = spark.range(130).select("id", F.when(F.col("id") < 45, "a").otherwise("b").alias("l"))
    sizes = {(r.l, r.split): r["count"] for r in split.stratified_split(df, "l", F.col("id")).groupBy("l", "split").count().collect()}
    assert [sizes[("a", s)] for s in ("train", "val", "test")] == [32, 6, 7]
    assert [sizes[("b", s)] for s in ("train", "val", "test")] == [60, 12, 13]


def test_snapshots_of_a_graph_read_its_edges_once(spark, monkeypatch):
    """Three versions of two tables are written; the rows that the edges come from are computed once."""
    from flowloom.plans import q_sources, views

    seen = spark.sparkContext.accumulator(0)

    def counted(n):
        seen.add(1)
        return n

    udf = F.udf(counted, "long").asNondeterministic()
    rows = [("a", "b", 5, 2), ("b", "c", 3, 0), ("a", "c", 1, 1)]
    edges = spark.createDataFrame([(s, d, n, n - k, k, k / n) for s, d, n, k in rows], "src_ip string, dst_ip string, flow_count long, benign_flow_count long, attack_flow_count long, attack_ratio double").coalesce(1)
    monkeypatch.setattr(views, "edges", lambda *_: edges.withColumn("flow_count", udf("flow_count")))
    got = {r.graph_version: (r.edges, r.flows) for r in q_sources.a10(spark, "").collect()}
    assert got == {"v1": (3, 9), "v2": (2, 6)}
    assert seen.value == 3


def test_percentiles_by_class_do_not_shuffle_rows_by_class(spark):
    """Whatever the optimizer thinks of the sizes: a class is not put into one task to meet its brackets."""
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ordered.exact_percentiles(df, "v", [0.5], ["g"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_exact_percentiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.exponential(size=3000), np.full(1500, 0.25)])
    df = spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(values)], "v double, g string")
    got = {r.point: r.percentile for r in ordered.exact_percentiles(df, "v", [0.05, 0.5, 0.95], margin=0.01).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)
    for r in ordered.exact_percentiles(df, "v", [0.5], ["g"], margin=0.01).collect():
        own = [v for i, v in enumerate(values) if (i % 3 != 0) == (r.g == "a")]
        assert r.percentile == pytest.approx(np.median(own), abs=1e-12)


def test_running_state_does_not_depend_on_chunks(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("k"), (F.col("id") * 37 % 101).alias("v"))
    agg = {"n": ("count", None), "s": ("sum", "v"), "m": ("max", "v")}
    whole = ordered.running_before(df, ["k"], ["id"], None, agg).orderBy("id").collect()
    cut = ordered.running_before(df, ["k"], ["id"], F.floor(F.col("id") / 7), agg).orderBy("id").collect()
    assert [tuple(r) for r in whole] == [tuple(r) for r in cut]
    lag = ordered.previous_value(df, ["k"], ["id"], F.floor(F.col("id") / 7), {"p": "v"}).orderBy("id").collect()
    assert [r.p for r in lag] == [None, None] + [r.v for r in lag[:-2]]


def test_separable_scores(spark):
    rows = [(0, float(s)) for s in np.linspace(0, 1, 100)] + [(1, float(s)) for s in np.linspace(5, 10, 50)]
    df = spark.createDataFrame(rows, "y int, s double")
    a = metrics.areas(df, "y", "s").first()
    assert (a.roc_auc, a.pr_auc) == (1.0, pytest.approx(1.0))
    m = metrics.threshold_metrics(df, "y", "s", 3.0).first()
    assert (m.tp, m.tn, m.fp, m.fn, m.f1) == (50, 100, 0, 0, 1.0)
    assert metrics.f1_threshold(df, "y", "s").first().threshold == 5.0
    none = spark.createDataFrame([(1, 0.0), (0, 1.0)], "y int, s double")
    assert metrics.roc_threshold(none, "y", "s").first().threshold is None
    flat = spark.createDataFrame([(2.0,)] * 3, "v double")
    bins = metrics.histogram(flat, "v").orderBy("bin").collect()
    assert (bins[0].range_start, bins[-1].range_end, sum(b.n for b in bins)) == (1.5, 2.5, 3)


def test_redundant_and_constant_columns(spark):
    df = spark.range(500).select("id", F.rand(1).alias("a"), F.lit(3.0).alias("flat"), F.rand(2).alias("other"))
    df = df.withColumns({"copy": F.col("a"), "near": F.col("a") + F.when(F.col("id") == 7, 0.01).otherwise(0.0), "minus": -F.col("a")}).cache()
    cols = ["a", "copy", "near", "minus", "flat", "other"]
    found = {(r.left, r.right): (r.kind, r.mismatch_count) for r in profile.redundant_pairs(df, cols).collect()}
    assert found == {("a", "copy"): ("exact", 0), ("a", "near"): ("near", 1), ("copy", "near"): ("near", 1)}
    assert [r.column for r in profile.variance_profile(df, cols).filter("zero_variance").collect()] == ["flat"]


def test_components_with_a_hub_chain_and_loop(spark):
    edges = [("hub", f"leaf{i}") for i in range(50)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("self", "self")]
    got = components.component_sizes(spark.createDataFrame(edges, "src_ip string, dst_ip string"))
    assert sorted(r["size"] for r in got.collect()) == [1, 41, 51]


CTX = "anomaly_score double, edge_attack_ratio double, edge_attack_flow_count long, edge_flow_count long, edge_first_seen timestamp, edge_last_seen timestamp, edge_attack_label_count long"


def test_risk_bounds_rules_and_levels(spark):
    cfg = RiskConfig(anomaly_threshold=0.1)
    rows = [(0.0, None, None, None, None, None, None), (1e6, 1.0, 10**6, 10**6, None, None, 9), (0.1, None, None, None, None, None, None)]
    low, top, mid = spark.createDataFrame(rows, CTX).transform(score_risk(cfg)).collect()
    assert (low.risk_score, low.risk_level, low.rules_applied) == (1.0, "Very Low", ["isolated_low_volume_weak_evidence"])
    assert top.risk_level == "Critical" and top.rules_applied == ["repeated_attack_heavy_communication", "very_high_anomaly"]
    assert 1.0 <= mid.risk_score <= 10.0 and mid.rules_applied == []
    assert mid.risk_score == pytest.approx(1 + 9 * 0.4 * (1 - np.exp(-1)), abs=1e-4)
    assert mid.reason.startswith("High anomaly deviation")
    assert [f.name for f in top.factors][0] == "anomaly_severity"
    with pytest.raises(PySparkException):
        spark.createDataFrame([(-1.0, None, None, None, None, None, None)], CTX).transform(score_risk(cfg)).collect()
    with pytest.raises(ValueError):
        RiskConfig(weights={"anomaly_severity": 0.5})


def test_context_precedence_never_blends(spark):
    cols = "live_flow_count long, live_first_seen timestamp, live_last_seen timestamp, " + CTX
    rows = [(n, None, None, 0.0, None, None, None, None, None, None) for n in (0, 1, 9, 10)] + [(50, None, None, 0.0, 0.2, 1, 5, None, None, 1)]
    got = context.choose_context(spark.createDataFrame(rows, cols)).collect()
    assert [r.context_source for r in got] == ["none", "none", "none", "live", "history"]
    assert [r.edge_flow_count for r in got] == [None, None, None, 10, 5]


def test_policy(spark):
    cfg = PolicyConfig()
    df = spark.createDataFrame([("e1", "192.168.56.3", 9.5), ("e2", "8.8.8.8", 9.0), ("e3", "8.8.8.8", 7.0), ("e4", "8.8.8.8", 6.99)], "event_id string, source_ip string, risk_score double")
    assert [r[0] for r in df.select(decide("risk_score", cfg)).collect()] == ["block_candidate", "block_candidate", "alert", "log"]
    ready = df.withColumns({"risk_level": F.lit("High"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    rows = {r.event_id: r for r in response_actions(ready, cfg).collect()}
    assert [rows[k].actual_action for k in ("e1", "e2", "e3")] == ["would_block", "rejected", "alerted"] and "e4" not in rows
    assert rows["e1"].target_scope == "192.168.56.0/24" and rows["e3"].reason == "risk_score 7.00 crossed alert threshold 7.0"
    assert response_actions(ready, PolicyConfig(enabled=False)).count() == 0
    with pytest.raises(ValueError):
        PolicyConfig(alert_threshold=9.0, block_threshold=8.0)


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_checks_of_raw_rows_are_made_once(spark):
    """Every check stands once in the plan; a port in plain digits and a month above 12 are told by their shape."""
    issues = profile.topology_issues(raw(spark))
    issues.collect()
    final = issues._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("unparseable timestamp") == 1
    ports = ["0", "0080", "9999", "59999", "60000", "65535", "65536", "99999", "1.5", "80.0", "-1", "", None, " 80 "]
    assert [bool(r[0]) for r in spark.createDataFrame([(p,) for p in ports], "p string").select(net.is_valid_port("p")).collect()] == [True] * 6 + [False] * 3 + [True] + [False] * 3 + [True]
    times = ["13/7/2017 08:00", "7/13/2017 08:00", "13/13/2017 08:00", "12/7/2017 08:00"]
    shown = spark.createDataFrame([(t,) for t in times], "t string").select(*[F.date_format(parsing.timestamp("t", day_first=d), "M-d").alias(str(d)) for d in (True, False)]).collect()
    assert [tuple(r) for r in shown] == [("7-13", "7-13"), ("7-13", "7-13"), (None, None), ("7-12", "12-7")]


def test_a_score_and_a_target_are_evaluated_once(spark):
    edge = {"edge_attack_ratio": F.lit(0.5), "edge_attack_flow_count": F.lit(3), "edge_flow_count": F.lit(6), "edge_attack_label_count": F.lit(1)}
    times = {c: F.col("created_at") for c in ("edge_first_seen", "edge_last_seen")}
    rows = spark.createDataFrame([("e", A, 1.0)], "event_id string, source_ip string, anomaly_score double").withColumn("created_at", F.lit("2017-07-03").cast("timestamp") + F.expr("INTERVAL 1 HOUR") * F.col("anomaly_score").cast("int"))
    scored = rows.withColumns(edge).withColumns(times).transform(score_risk(RiskConfig(anomaly_threshold=0.1), explained=False))
    acts = response_actions(scored, PolicyConfig())
    plan = _optimized(acts)
    assert plan.count("EXP(") == 1  # the filter on the decision holds no copy of the score
    assert str(net.target_scope("ip", "10.0.0.0/8")).count("reserved by IANA") == 1
