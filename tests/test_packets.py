"""Flow features, sessions, neighbours and streaming state on small inputs."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.operators import autoencoder, context, knn, packets, sessionize
from flowloom.operators.ordered import Slices, with_slices
from flowloom.schemas import FLOW_FEATURES, PACKET, SessionLimits
from flowloom.sources import snapshots
from flowloom.sources.tables import csv_files, flags_from_letters, parse_packet_lines, read_flow_csvs, read_graph, replace_graph, unique_names
from flowloom.streaming.edges import keep_recent_edges, live_edge_context

T0 = datetime(2024, 1, 1)
CLIENT, SERVER = ("10.0.0.1", 5000), ("10.0.0.2", 80)


def packet(second, forward=True, length=100, flags="A", protocol=6, window=1000, payload=10, pair=(CLIENT, SERVER)):
    (a, b) = pair if forward else pair[::-1]
    bits = None if flags is None else tuple(x in flags for x in "FSRPAUEC")
    return (T0 + timedelta(seconds=second), a[0], b[0], a[1], b[1], protocol, length, 20, payload, bits, window)


def table(spark, rows):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKET.fields) + ", seq long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def test_four_packet_flow(spark):
    rows = [packet(0, True, 100, "S"), packet(2, False, 300, "SA", window=2000), packet(4, True, 100, "PA"), packet(6, False, 300, "A")]
    f = packets.flow_features(table(spark, rows)).first().asDict()
    expected = {
        "Destination Port": 80, "Flow Duration": 6e6, "Total Fwd Packets": 2, "Total Backward Packets": 2, "Flow IAT Mean": 2e6, "Flow IAT Std": 0,
        "Flow Bytes/s": 800 / 6, "Flow Packets/s": 4 / 6, "Fwd IAT Total": 4e6, "Bwd IAT Mean": 4e6, "SYN Flag Count": 2, "PSH Flag Count": 1, "ACK Flag Count": 3,
        "Fwd PSH Flags": 1, "Packet Length Mean": 200, "Packet Length Std": 100, "Packet Length Variance": 10_000, "Down/Up Ratio": 1, "Subflow Fwd Bytes": 200,
        "Init_Win_bytes_forward": 1000, "Init_Win_bytes_backward": 2000, "act_data_pkt_fwd": 2, "min_seg_size_forward": 20, "Active Mean": 6e6, "Idle Max": 0,
    }
    for name, value in expected.items():
        assert f[name] == pytest.approx(value), name
    assert [c for c in f if c in FLOW_FEATURES] == list(FLOW_FEATURES) and len(FLOW_FEATURES) == 67


def test_features_do_not_depend_on_slices_or_side(spark):
    rng = np.random.default_rng(5)
    rows = []
    for client in (("10.0.0.1", 5000), ("192.168.9.9", 7)):
        t = 0.0
        for _ in range(120):
            t += float(rng.choice([0.3, 2.0, 7.5, 40.0]))
            rows.append(packet(t, bool(rng.integers(2)), int(rng.integers(40, 1500)), "PA", window=int(rng.integers(100)), pair=(client, SERVER)))
    p = table(spark, rows)
    a = {r.src_ip + str(r.src_port): r for r in packets.flow_features(p, slices=Slices(rows=7, every=1)).collect()}
    b = {r.src_ip + str(r.src_port): r for r in packets.flow_features(p, slices=None).collect()}
    assert a.keys() == b.keys() and len(a) == 2
    for k in a:
        assert np.allclose([a[k][f] for f in FLOW_FEATURES], [b[k][f] for f in FLOW_FEATURES])
    udp = packets.flow_features(table(spark, [packet(0, flags=None, protocol=17, window=None)])).first()
    assert (udp["Init_Win_bytes_forward"], udp["Flow Duration"], udp["Flow Packets/s"]) == (-1.0, 0.0, 1e6)


CASES = {
    "fin": ([packet(0), packet(1, False, flags="FA"), packet(2, True, flags="FA"), packet(3)], [("fin", 3), ("flush", 1)]),
    "rst": ([packet(0), packet(1, False, flags="R"), packet(2)], [("rst", 2), ("flush", 1)]),
    "idle": ([packet(0), packet(30), packet(60.5)], [("idle_timeout", 2), ("flush", 1)]),
    "duration": ([packet(20 * i) for i in range(17)], [("max_duration", 16), ("flush", 1)]),
    "packets": ([packet(i) for i in range(8)], [("max_packets", 7), ("flush", 1)]),
}


@pytest.mark.parametrize("slices", [Slices(), Slices(rows=2, every=1)])
@pytest.mark.parametrize("name", sorted(CASES))
def test_close_reasons(spark, name, slices):
    rows, expected = CASES[name]
    limits = SessionLimits(max_packets=7 if name == "packets" else 200_000)
    s = sessionize.sessionize(table(spark, rows), limits, slices)
    got = sessionize.close_reasons(s).orderBy("start_ts").collect()
    assert [(r.end_reason, r.packets) for r in got] == expected


def test_sweep(spark):
    s = sessionize.sessionize(table(spark, [packet(0), packet(1)]))
    for second, reason in ((31, "flush"), (32, "idle_timeout")):
        now = F.lit(T0 + timedelta(seconds=second))
        assert sessionize.close_reasons(s, now, 30.0).first().end_reason == reason


def test_walk_is_the_same_in_any_batching():
    rng = np.random.default_rng(11)
    n = 400
    t = np.cumsum(rng.integers(0, 9_000_000, n))
    lo, fin, rst = rng.random(n) < 0.5, rng.random(n) < 0.1, rng.random(n) < 0.02
    limits = SessionLimits(max_duration_seconds=60.0, max_packets=17)
    whole = sessionize.walk_segment(t, lo, fin, rst, sessionize.OpenFlow(), limits)
    state, numbers, reasons = sessionize.OpenFlow(), [], []
    for a in range(0, n, 7):
        x, y = sessionize.walk_segment(t[a : a + 7], lo[a : a + 7], fin[a : a + 7], rst[a : a + 7], state, limits)
        numbers.extend(x)
        reasons.extend(y)
    assert list(whole[0]) == numbers and list(whole[1]) == reasons
    # One packet at a time, by the rules as worded.
    flow, start, count, fins = 0, None, 0, set()
    for i in range(n):
        if start is None:
            start, count, fins = t[i], 0, set()
        count += 1
        if fin[i]:
            fins.add(bool(lo[i]))
        reason = None
        if rst[i]:
            reason = "rst"
        elif fin[i] and len(fins) == 2:
            reason = "fin"
        elif t[i] - start >= 60_000_000:
            reason = "max_duration"
        elif count >= 17:
            reason = "max_packets"
        assert (numbers[i], reasons[i]) == (flow, reason)
        if reason:
            flow, start = flow + 1, None


@pytest.mark.parametrize("seed", range(12))
def test_transition_tables_lead_to_the_state_of_a_walk(seed):
    rng = np.random.default_rng(seed)
    n = 300
    t = np.cumsum(rng.choice([0, 1, 5, 40], n, p=[0.2, 0.4, 0.395, 0.005]) * 1_000_000)
    seq, lo = np.arange(n) + 7, rng.random(n) < 0.5
    fin, rst = rng.random(n) < [0.0, 0.05, 0.3][seed % 3], rng.random(n) < [0.0, 0.02][seed % 2]
    limits = SessionLimits(idle_seconds=30.0, max_duration_seconds=[20.0, 1e6, 90.0, 0.0][seed % 4], max_packets=[9, 10**6, 25][seed // 4])
    breaks = np.concatenate([[False], np.diff(t) > 30_000_000])
    for at in sorted(set(rng.integers(1, n, 40).tolist())):
        for stop in {n, min(n, at + 1), min(n, at + 12)}:
            before, whole = sessionize.OpenFlow(), sessionize.OpenFlow()
            sessionize.walk_run(t[:at], seq[:at], lo[:at], fin[:at], rst[:at], breaks[:at], before, limits)
            sessionize.walk_run(t[:stop], seq[:stop], lo[:stop], fin[:stop], rst[:stop], breaks[:stop], whole, limits)
            state = sessionize.Entry() if before.start is None else sessionize.Entry(int(before.start), before.seq, before.count, before.fin_lo, before.fin_hi)
            part = slice(at, stop)
            got = sessionize.Transition.of(t[part], seq[part], lo[part], fin[part], rst[part], limits).leave(state, limits, bool(breaks[at]))
            if whole.start is None:
                assert got.start is None
            else:
                assert (got.start, got.seq, got.count, got.fin_lo, got.fin_hi) == (whole.start, whole.seq, whole.count, whole.fin_lo, whole.fin_hi)


def test_sessions_do_not_depend_on_slices_and_spread_an_endless_flow(spark):
    rng = np.random.default_rng(3)
    rows, t = [], 0.0
    for _ in range(600):  # no gap, no RST: only the caps end flows
        t += float(rng.choice([0.0, 0.5, 2.0]))
        rows.append(packet(t, bool(rng.integers(2)), flags="FA" if rng.random() < 0.02 else "A"))
    rows += [packet(i * 7, pair=(("10.0.0.9", 1), SERVER)) for i in range(40)]
    p = table(spark, rows)
    limits = SessionLimits(idle_seconds=30.0, max_duration_seconds=60.0, max_packets=70)
    one = sessionize.sessionize(p, limits, Slices())
    many = sessionize.sessionize(p, limits, Slices(rows=50, every=1))
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    sizes = [r["count"] for r in with_slices(sessionize._flagged(p, Slices(rows=50, every=1)).drop("_slice", "_cut"), sessionize.FLOW_KEY, sessionize.ORDER, Slices(rows=50, every=1)).filter("_cut").groupBy("_slice").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 100
    assert sum(sizes) == 600


def test_rows_in_one_hour_are_cut_into_even_slices(spark):
    hour = [(int(x), i) for i, x in enumerate(np.random.default_rng(1).integers(0, 3_600_000_000, 9000))]
    rest = [(3_600_000_000 * (k + 1), 9000 + k) for k in range(1000)]
    df = spark.createDataFrame([("hot", *r) for r in hour + rest] + [(f"k{i}", i, i) for i in range(300)], "k string, _t long, seq long")
    got = with_slices(df, ["k"], ["_t", "seq"], Slices(rows=500, every=4))
    per = {r["_slice"]: r["count"] for r in got.filter("k = 'hot'").groupBy("_slice").count().collect()}
    assert len(per) >= 15 and max(per.values()) < 1000 and not got.filter("k <> 'hot' and (_cut or _slice > 0)").count()
    order = got.filter("k = 'hot'").groupBy("_slice").agg(F.min("_t").alias("a"), F.max("_t").alias("b")).orderBy("_slice").collect()
    assert all(x.b < y.a for x, y in zip(order, order[1:]))


@pytest.mark.parametrize("job", ["interarrival_stats", "burst_stats", "flow_features"])
def test_ordered_pass_reads_its_input_twice(spark, tmp_path, job):
    table(spark, [packet(i) for i in range(5)]).write.parquet(f"{tmp_path}/p")
    df = getattr(packets, job)(spark.read.parquet(f"{tmp_path}/p"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # to place the cuts, and for the pass itself
    assert plan.count("Exchange hashpartitioning") == 3  # cuts, packets by flow and slice, summaries by flow


def test_knn_against_brute_force_with_many_equal_rows(spark):
    rng = np.random.default_rng(2)
    train = np.vstack([rng.normal(size=(150, 6)), np.tile(rng.normal(size=6), (80, 1)), rng.normal(5, 0.01, size=(70, 6))])
    ask = np.vstack([rng.normal(size=(30, 6)), train[:5], train[160:163]])
    t = spark.createDataFrame([(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(train)], "id long, v array<double>, y int")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ask)], "id long, v array<double>")
    got = knn.nearest_neighbours(t, q, "v", "id", "y", knn.KnnConfig())
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query_id, []).append((r["rank"], r.train_id))
    for i, v in enumerate(ask):
        d = np.sqrt(((train - v) ** 2).sum(1))
        assert [x for _, x in sorted(rows[i])] == np.lexsort((np.arange(len(train)), d))[:5].tolist()
    votes = {r.query_id: r for r in knn.vote(got).collect()}
    assert votes[30].attack_probability == 1.0 and votes[31].predicted_label == "BENIGN"


@pytest.mark.parametrize("ship", [True, False])
def test_knn_searches_every_labelled_row(spark, ship):
    """Beyond 200,000 labelled rows the classifier was fitted on a sample of them."""
    n = 220_000 if ship else 400
    cfg = knn.KnnConfig(k=3) if ship else knn.KnnConfig(k=3, max_matrix_bytes=1 << 10, block_bytes=1 << 10)
    t = spark.range(n).select("id", F.array(F.col("id") * 1.0, F.lit(0.0)).alias("v"), (F.col("id") % 2).cast("int").alias("y"))
    asked = sorted({*range(0, n, n // 40), n - 1, 5}) + [5]  # an id that comes twice
    q = spark.createDataFrame([(i, f"q{i}", [float(i), 0.0]) for i in asked], "id long, name string, v array<double>")
    got = knn.nearest_neighbours(t, q, "v", "id", "y", cfg, ("name",)).collect()
    assert len(got) == 3 * len(asked)
    for i in asked:
        near = sorted(range(max(0, i - 3), min(n, i + 4)), key=lambda j: (abs(j - i), j))[:3]
        rows = sorted((r["rank"], r.train_id, r.label, r.distance, r.name) for r in got if r.query_id == i)
        assert rows == sorted([(k + 1, j, j % 2, float(abs(j - i)), f"q{i}") for k, j in enumerate(near)] * asked.count(i))


def test_network_gradient_and_fit(spark):
    net = autoencoder.Network.start((4, 3, 2), seed=1)
    x = np.random.default_rng(0).normal(size=(20, 4))
    loss, grad = net.gradient(x)
    flat, eps = net.flat(), 1e-6
    for i in range(0, len(flat), 5):
        up, down = flat.copy(), flat.copy()
        up[i] += eps
        down[i] -= eps
        numeric = (autoencoder.Network.from_flat(up, net.shapes).gradient(x)[0] - autoencoder.Network.from_flat(down, net.shapes).gradient(x)[0]) / (2 * eps)
        assert grad[i] == pytest.approx(numeric, abs=1e-6)
    data = np.random.default_rng(1).normal(size=(400, 1)) @ np.ones((1, 4)) + np.random.default_rng(2).normal(scale=0.05, size=(400, 4))
    df = spark.createDataFrame(pd.DataFrame(data, columns=list("abcd"))).repartition(3)
    cfg = autoencoder.TrainingConfig(dims=(4, 3, 2), max_epochs=6, learning_rate=0.02)
    result = autoencoder.fit(df, df, list("abcd"), cfg)
    assert result.history[-1]["val_loss"] < result.history[0]["val_loss"]
    again = autoencoder.fit(df.repartition(7), df, list("abcd"), cfg)  # the partitions do not matter
    assert np.allclose(again.network.flat(), result.network.flat())
    same = autoencoder.Network.from_json(result.network.to_json())
    assert np.allclose(same.errors(x), result.network.errors(x))


@pytest.mark.parametrize("slices", [Slices(rows=1, every=1), Slices(), None])
def test_live_edges_expire_and_cap(spark, slices):
    rows = [("a", "b", T0 + timedelta(seconds=s), i) for i, s in enumerate((0, 5, 15, 26))] + [("c", "d", T0, 9)]
    f = spark.createDataFrame(rows, "src_ip string, dst_ip string, ts timestamp, k long")
    got = live_edge_context(f, ("ts", "k"), 10, slices).orderBy("k").collect()
    assert [r.live_flow_count for r in got] == [0, 1, 2, 0, 0]
    held = spark.createDataFrame([("a", "b", 4, T0 - timedelta(seconds=9), T0 - timedelta(seconds=3))], "src_ip string, dst_ip string, flow_count long, first_seen timestamp, last_seen timestamp")
    more = live_edge_context(f, ("ts", "k"), 10, slices, carried=held).orderBy("k").collect()
    assert [r.live_flow_count for r in more] == [4, 5, 6, 0, 0]
    assert more[0].live_last_seen == T0 - timedelta(seconds=3)
    table_ = spark.createDataFrame([("a", "b", T0), ("c", "d", T0 + timedelta(seconds=1)), ("e", "f", T0 + timedelta(seconds=2))], "src_ip string, dst_ip string, last_seen timestamp")
    assert sorted(r.src_ip for r in keep_recent_edges(table_, 2).collect()) == ["c", "e"]


@pytest.mark.parametrize("seed", range(3))
def test_live_edges_by_slices_are_those_of_a_walk(spark, seed):
    rng = np.random.default_rng(seed)
    rows, t = [], {"a": 0, "b": 0}
    for k in range(400):
        key = "a" if rng.random() < 0.8 else "b"
        t[key] += int(rng.choice([0, 3, 9, 11, 50], p=[0.3, 0.4, 0.25, 0.02, 0.03]))
        rows.append((key, "x", T0 + timedelta(seconds=t[key]), k))
    held = {"a": (5, T0 - timedelta(seconds=40), T0 - timedelta(seconds=[2, 30, 10][seed]))}
    want = []
    for key in t:
        count, first, last = held.get(key, (0, None, None))
        for _, _, ts, k in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3])):
            if last is not None and ts - last > timedelta(seconds=10):
                count, first, last = 0, None, None
            want.append((k, count, first, last))
            count, first, last = count + 1, first or ts, ts
    f = spark.createDataFrame(rows, "src_ip string, dst_ip string, ts timestamp, k long")
    c = spark.createDataFrame([(k, "x", *v) for k, v in held.items()], "src_ip string, dst_ip string, flow_count long, first_seen timestamp, last_seen timestamp")
    for slices in (Slices(rows=20, every=1), None):
        got = live_edge_context(f, ("ts", "k"), 10, slices, carried=c).select("k", "live_flow_count", "live_first_seen", "live_last_seen")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_prior_edge_state_by_slices(spark):
    rng = np.random.default_rng(8)
    rows = [("a", "b" if rng.random() < 0.9 else "c", T0 + timedelta(seconds=int(rng.integers(50))), k) for k in range(500)]
    f = spark.createDataFrame(rows, "src_ip string, dst_ip string, ts timestamp, k long")
    one, many = (sorted(map(tuple, context.prior_edge_state(f, ("ts", "k"), slices=s).collect())) for s in (Slices(), Slices(rows=30, every=1)))
    assert one == many
    seen = {}
    for a, b, ts, k, n, first, last in sorted(many, key=lambda r: (r[2], r[3])):
        before = seen.setdefault(b, [])
        assert (n, first, last) == (len(before), before[0] if before else None, before[-1] if before else None)
        before.append(ts)


def test_packet_lines_and_flag_letters(spark):
    lines = ['{"type":"ready"}', '{"type":"packet"', '{"type":"packet","timestamp":1.5}', "", '{"type":"packet","timestamp":1.5,"src_ip":"a","dst_ip":"b","protocol":6,"total_length":40,"ip_header_length":20,"transport_header_length":20,"payload_length":0,"tcp_flags":{"syn":true}}']
    parsed = parse_packet_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.kind for r in parsed] == ["other", "malformed_line", "malformed_packet", "packet"]
    assert parsed[3].tcp_flags.syn is True
    flags = spark.createDataFrame([("SA",), (None,)], "f string").select(flags_from_letters("f").alias("x")).collect()
    assert flags[0].x.syn and flags[0].x.ack and not flags[0].x.fin and flags[1].x is None


def test_csv_scan_with_mixed_encodings(spark, tmp_path):
    assert unique_names([" a", "b ", "a"]) == ["a", "b", "a.1"]
    (tmp_path / "one.csv").write_bytes("Fwd Header Length, Label,Fwd Header Length\n20,Web Attack � XSS,20\n".encode())
    (tmp_path / "two.csv").write_bytes(b"Fwd Header Length, Label,Fwd Header Length\n20,Web Attack \x96 XSS,20\n,,\n")
    df = read_flow_csvs(spark, str(tmp_path))
    assert df.columns == ["Fwd Header Length", "Label", "source_file"]
    got = {(r.source_file, r.Label) for r in df.collect()}
    assert got == {("one.csv", "Web Attack � XSS"), ("two.csv", "Web Attack \x96 XSS"), ("two.csv", None)}


def test_csv_files_of_one_name_are_told_apart(spark, tmp_path):
    for name, content in {
        "x/day.csv": "Label,Port\nWeb Attack é,1\n".encode(),
        "y/day.csv": b"Label,Port\nWeb Attack \xe9,2\n",
        "y/old.csv": 'Port," Flow, ""all"" ", Label\n3,"a, b",Plain\n'.encode(),
        "z/bom.csv": "\ufeffLabel,Port\nlast,4\n".encode(),
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    seen = {"/".join(r.source_path.split("/")[-2:]): (r.encoding, r.header) for r in csv_files(spark, str(tmp_path), recursive=True).collect()}
    assert seen == {
        "x/day.csv": ("utf-8", ["Label", "Port"]),
        "y/day.csv": ("latin1", ["Label", "Port"]),
        "y/old.csv": ("utf-8", ["Port", ' Flow, "all" ', " Label"]),
        "z/bom.csv": ("utf-8", ["Label", "Port"]),
    }
    rows = read_flow_csvs(spark, str(tmp_path), recursive=True)
    got = {(r.source_file, r.Label, r.Port, r['Flow, "all"']) for r in rows.collect()}
    assert got == {("day.csv", "Web Attack é", "1", None), ("day.csv", "Web Attack é", "2", None), ("old.csv", "Plain", "3", "a, b"), ("bom.csv", "last", "4", None)}
    with pytest.raises(FileNotFoundError):
        read_flow_csvs(spark, str(tmp_path))


def test_half_a_snapshot_is_never_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "graph")
    table = lambda n, name: spark.range(n).withColumnRenamed("id", name)
    assert replace_graph(table(3, "ip"), table(2, "edge"), path, "v1") == 2
    assert replace_graph(table(5, "ip"), table(7, "edge"), path, "007") == 7

    broken = table(4, "edge").selectExpr("edge", "raise_error('lost') AS x")
    with pytest.raises(Exception, match="lost"):
        replace_graph(table(9, "ip"), broken, path, "v1")  # nodes are written, edges are not
    counts = lambda: {(t, r.graph_version): r["count"] for t in ("nodes", "edges") for r in read_graph(spark, path, t).groupBy("graph_version").count().collect()}
    assert counts() == {("nodes", "v1"): 3, ("edges", "v1"): 2, ("nodes", "007"): 5, ("edges", "007"): 7}

    # another writer commits between the start and the commit of this one
    plain, others = snapshots._commit, [("v2", "ok"), ("v1", "conflict")]

    def late(spark, path, number, content):
        if others:
            version, _ = others.pop(0)
            monkeypatch.setattr(snapshots, "_commit", plain)
            replace_graph(table(1, "ip"), table(1, "edge"), path, version)
        return plain(spark, path, number, content)

    monkeypatch.setattr(snapshots, "_commit", late)
    assert replace_graph(table(6, "ip"), table(6, "edge"), path, "v1") == 6  # another version: both stay
    monkeypatch.setattr(snapshots, "_commit", late)
    with pytest.raises(snapshots.SnapshotConflict):
        replace_graph(table(8, "ip"), table(8, "edge"), path, "v1")
    assert counts() == {("nodes", "v1"): 1, ("edges", "v1"): 1, ("nodes", "007"): 5, ("edges", "007"): 7, ("nodes", "v2"): 1, ("edges", "v2"): 1}
    assert snapshots.expire(spark, path, keep=1) == 4  # both tables of the first two states of v1
    assert counts()[("edges", "007")] == 7
