"""Reconstruction model, nearest neighbours and their evaluation jobs."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import autoencoder, clean, context, dashboard, knn, metrics, profile, runs, scoring, split
from flowloom.operators.autoencoder import Network
from flowloom.plans import views
from flowloom.plans.oracle import big, cte, factor_ctes, n, r, ts
from flowloom.plans.q_metrics import HIST, class_metrics_sql, cm, rates
from flowloom.plans.q_sources import SPLIT_CTE, STATISTICS, a9_stats, scratch
from flowloom.plans.registry import query
from flowloom.plans.views import FEATURES, RISK, plain

LIMIT = 1.05


def fixed_network() -> Network:
    """A small network with weights from a rule, so that SQL can repeat it."""
    dims = [5, 3, 2, 3, 5]
    weights, biases = [], []
    for layer, (rows, cols) in enumerate(zip(dims[:-1], dims[1:])):
        weights.append(np.array([[((i * 7 + j * 3 + layer * 5) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)]))
        biases.append(np.array([((j * 5 + layer) % 7 - 3) / 20 for j in range(cols)]))
    return Network(tuple(weights), tuple(biases))


def layer_ctes(source: str, out: str, inputs: list[str]) -> None:
    """The fixed network as one CTE per layer, then ``out`` with the error ``err``."""
    net, names, previous = fixed_network(), inputs, source
    last = len(net.weights) - 1
    for k, (w, b) in enumerate(zip(net.weights, net.biases)):
        cols = []
        for j in range(w.shape[1]):
            z = " + ".join([f"({b[j]})", *[f"{names[i]} * ({w[i, j]})" for i in range(w.shape[0])]])
            cols.append(f"{z if k == last else f'greatest(0.0, {z})'} AS {out}_{k}_{j}")
        cte(f"{out}_{k}", previous, f"SELECT *, {', '.join(cols)} FROM {previous}")
        previous, names = f"{out}_{k}", [f"{out}_{k}_{j}" for j in range(w.shape[1])]
    error = " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(inputs, names))
    cte(out, previous, f"SELECT *, ({error}) / {float(len(inputs))} AS err FROM {previous}")


X = [f"x{i}" for i in range(len(FEATURES))]
FIT = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(FEATURES))
cte("fit", "flows", f"SELECT {FIT} FROM flows WHERE canonical_label = 'BENIGN'")
cte("scaled", "flows fit", f"SELECT f.*, {', '.join(f'(f.{c} - fit.m{i}) / fit.d{i} AS x{i}' for i, c in enumerate(FEATURES))} FROM flows f, fit")
layer_ctes("scaled", "errs", X)


def fitted_scaler(flows):
    return profile.scaler_table(clean.benign_training_rows(flows), FEATURES)


def predicted(spark, sf):
    flows = views.flows(spark, sf).drop("anomaly_score")
    return autoencoder.predict(flows, fitted_scaler(flows), fixed_network(), FEATURES, LIMIT)


@query("j1")
def j1(spark, sf):
    """Distributed fit on benign training rows; per-epoch losses."""
    rows = split.stratified_split(views.flows(spark, sf), "canonical_label", F.col("event_id"))
    scaler = profile.scaler_table(rows.filter("split = 'train'"), FEATURES)
    ready = profile.scale_columns(clean.benign_training_rows(rows), scaler, FEATURES).select("split", *FEATURES)
    cfg = autoencoder.TrainingConfig(dims=(5, 4, 2), max_epochs=3, learning_rate=5e-3)
    result = autoencoder.fit(ready.filter("split = 'train'"), ready.filter("split = 'val'"), FEATURES, cfg)
    return spark.createDataFrame([(h["epoch"], h["train_loss"], h["val_loss"]) for h in result.history], "epoch long, train_loss double, val_loss double")


@query("j1_start", f"SELECT CAST(1 AS BIGINT) AS epoch, {r('avg(err)', 'train_loss')} FROM errs WHERE canonical_label = 'BENIGN'", "errs")
def j1_start(spark, sf):
    """The loss that the first full step of a fit measures, from a network that SQL can repeat."""
    flows = views.flows(spark, sf).drop("anomaly_score")
    benign = profile.scale_columns(clean.benign_training_rows(flows), fitted_scaler(flows), FEATURES).select(*FEATURES)
    cfg = autoencoder.TrainingConfig(dims=(5, 3, 2), max_epochs=1, steps_per_epoch=1)
    history = autoencoder.fit(benign, benign, FEATURES, cfg, fixed_network()).history
    return plain(spark.createDataFrame([(h["epoch"], h["train_loss"]) for h in history], "epoch long, train_loss double"))


@query("j2", f"SELECT event_id, {r('err', 'anomaly_score')} FROM errs", "errs")
def j2(spark, sf):
    """Reconstruction error per row, through the vectorised function."""
    return plain(predicted(spark, sf).select("event_id", "anomaly_score"))


@query("j2_sql", f"SELECT event_id, {r('err', 'anomaly_score')} FROM errs", "errs")
def j2_sql(spark, sf):
    """The same error as one Column expression."""
    flows = views.flows(spark, sf)
    scaled = profile.scale_columns(flows, fitted_scaler(flows), FEATURES)
    return plain(scaled.select("event_id", autoencoder.error_expression(fixed_network(), FEATURES).alias("anomaly_score")))


@query("j3", f"SELECT event_id, {r('err', 'anomaly_score')}, err >= {LIMIT} AS is_anomaly, {r(str(LIMIT), 'threshold_used')} FROM errs", "errs")
def j3(spark, sf):
    """Batch prediction: scale, score, flag."""
    return plain(predicted(spark, sf).select("event_id", "anomaly_score", "is_anomaly", "threshold_used"))


def raw_with_features(spark, sf):
    """Raw text rows with feature columns; every 71st order key has an infinite one."""
    text = {c: F.col(c).cast("string") for c in FEATURES if c != "l_tax"}
    tax = F.when(F.col("l_orderkey") % 71 == 0, "Infinity").otherwise(F.col("l_tax").cast("string"))
    return views.raw_flows(spark, sf, **text, l_tax=tax)


VALID = "l_orderkey % 97 <> 0 AND l_orderkey % 89 <> 0 AND l_orderkey % 83 <> 0"


@query("j4", f"SELECT canonical_label, {n()}, {r('avg(err)', 'mean_score')}, {n(f'err >= {LIMIT}', 'anomalies')} FROM errs WHERE {VALID} AND l_orderkey % 71 <> 0 GROUP BY 1", "errs")
def j4(spark, sf):
    """Joint scored flows: cleaned, finite, scored, keys kept."""
    scaler = fitted_scaler(views.flows(spark, sf))
    joint = scoring.joint_flows(raw_with_features(spark, sf), scaler, fixed_network(), FEATURES, LIMIT)
    return plain(joint.groupBy("canonical_label").agg(F.count("*").alias("n"), F.avg("anomaly_score").alias("mean_score"), F.count_if("is_anomaly").alias("anomalies")))


@query(
    "j4_counts",
    f"""SELECT CAST((SELECT count(*) FROM raw_flows) AS BIGINT) AS total_raw_rows, {n(VALID, 'total_topology_valid_rows')},
      {n(f'{VALID} AND l_orderkey % 71 = 0', 'total_feature_invalid_rows_dropped')}, {n(f'{VALID} AND l_orderkey % 71 <> 0', 'total_scored_rows')} FROM flows""",
    "flows raw_flows",
)
def j4_counts(spark, sf):
    """Row counts through the stages of the joint job."""
    return plain(scoring.joint_accounting(raw_with_features(spark, sf), FEATURES))


cte("vec", "", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label >= 5 AS INTEGER) AS y, vec_id % 5 = 0 AS held FROM embeddings")
cte(
    "near",
    "vec",
    """
  SELECT * FROM (SELECT q.vec_id AS query_id, q.y AS truth, t.vec_id AS train_id, t.y AS label, list_distance(q.v, t.v) AS distance,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS rank
    FROM vec q JOIN vec t ON q.held AND NOT t.held) WHERE rank <= 5""",
)
cte(
    "votes",
    "near",
    """
  SELECT query_id, any_value(truth) AS truth, sum(CASE WHEN label = 1 THEN w ELSE 0 END) / sum(w) AS p FROM (
    SELECT *, CASE WHEN min(distance) OVER (PARTITION BY query_id) = 0 THEN CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / distance END AS w FROM near) GROUP BY 1""",
)


def classified(spark, sf):
    train, asked = views.vectors(spark, sf)
    votes = knn.classify(train, asked, "embedding", "vec_id", "y")
    truth = asked.select(F.col("vec_id").alias("query_id"), F.col("y").alias("truth"))
    return votes.join(truth, "query_id")


@query("j5", f"SELECT query_id, {r('p', 'attack_probability')}, CAST(p > 0.5 AS BIGINT) AS predicted_class, CASE WHEN p > 0.5 THEN 'ATTACK' ELSE 'BENIGN' END AS predicted_label FROM votes", "votes")
def j5(spark, sf):
    """Exact 5-nearest-neighbour classification, distance-weighted."""
    return plain(classified(spark, sf).select("query_id", "attack_probability", "predicted_class", "predicted_label"))


@query("j5_neighbours", f"SELECT query_id, train_id, {r('distance', 'distance')}, CAST(rank AS BIGINT) AS rank FROM near", "near")
def j5_neighbours(spark, sf):
    """The neighbours themselves."""
    train, asked = views.vectors(spark, sf)
    return plain(knn.nearest_neighbours(train, asked, "embedding", "vec_id", "y").select("query_id", "train_id", "distance", "rank"))


def areas_sql(source: str, y: str, s: str) -> str:
    return f"""pts AS (SELECT {s} AS s, count(*) FILTER (WHERE {y}) AS pos, count(*) FILTER (WHERE NOT ({y})) AS neg FROM {source} GROUP BY 1),
  curve AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM pts),
  area AS (SELECT {r('sum(pos * (q - fp + neg / 2.0)) / (any_value(p) * any_value(q))', 'roc_auc')}, {r('sum(pos / p * (tp / (tp + fp)))', 'pr_auc')} FROM curve)"""


@query("j6", f"WITH {areas_sql('votes', 'truth = 1', 'round(p, 9)')} SELECT * FROM ({class_metrics_sql('SELECT ' + cm('p > 0.5', 'truth = 1') + ' FROM votes')}), area", "votes")
def j6(spark, sf):
    """KNN held-out evaluation."""
    c = classified(spark, sf).withColumn("p", F.round("attack_probability", 9))
    a = metrics.areas(c, "truth", "p")
    m = metrics.class_metrics(c, "truth", "predicted_class")
    s = a.select(F.struct("roc_auc", "pr_auc").alias("a")).scalar()
    return plain(m.withColumn("_a", s).select(*m.columns, "_a.roc_auc", "_a.pr_auc"))


ERR = "SELECT canonical_label <> 'BENIGN' AS y, round(err, 9) AS s FROM (SELECT e.*, t.split FROM errs e JOIN tsplit t ON t.event_id = e.event_id) WHERE split = 'test'"
cte("tsplit", "flows", f"SELECT event_id, split FROM ({SPLIT_CTE})")
cte("test_errs", "errs tsplit", ERR)


def held_out(spark, sf):
    rows = split.stratified_split(predicted(spark, sf), "canonical_label", F.col("event_id")).filter("split = 'test'")
    # the model runs once: all metrics read its written scores
    path = scratch(spark, "held-out")
    rows.select("canonical_label", F.round("anomaly_score", 9).alias("s"), (F.col("canonical_label") != "BENIGN").cast("int").alias("y")).write.parquet(path)
    return spark.read.parquet(path)


@query("j7", f"WITH {areas_sql('test_errs', 'y', 's')}, m AS (SELECT {cm(f's >= {LIMIT}', 'y')} FROM test_errs) SELECT {r(str(LIMIT), 'threshold')}, tp, tn, fp, fn, {rates()}, roc_auc, pr_auc FROM m, area", "test_errs")
def j7(spark, sf):
    """Held-out evaluation of the reconstruction model."""
    df = held_out(spark, sf)
    m = metrics.threshold_metrics(df, "y", "s", LIMIT)
    s = metrics.areas(df, "y", "s").select(F.struct("roc_auc", "pr_auc").alias("a")).scalar()
    return plain(m.withColumn("_a", s).select(*m.columns, "_a.roc_auc", "_a.pr_auc"))


@query(
    "j7_attacks",
    f"""SELECT canonical_label AS attack_type, {n('', 'sample_count')}, {r('avg(s)', 'mean_reconstruction_error')}, {r('median(s)', 'median_reconstruction_error')},
      {r(f'avg(CASE WHEN s >= {LIMIT} THEN 1.0 ELSE 0.0 END)', 'rate')}
    FROM (SELECT e.canonical_label, round(e.err, 9) AS s FROM errs e JOIN tsplit t ON t.event_id = e.event_id WHERE t.split = 'test') WHERE canonical_label <> 'BENIGN' GROUP BY 1""",
    "errs tsplit",
)
def j7_attacks(spark, sf):
    """Held-out detection per attack type."""
    return plain(metrics.per_attack_table(held_out(spark, sf), "canonical_label", "s", LIMIT, "reconstruction_error"))


# Telemetry rows: a feature map without some keys, imputed with the training mean.
_GIVEN = {"l_discount": "l_orderkey % 3 <> 0", "l_tax": "l_orderkey % 5 <> 0"}
cte(
    "imputed",
    "flows fit context",
    "SELECT f.event_id, c.* EXCLUDE (src_ip, dst_ip), "
    + ", ".join(
        f"((CASE WHEN {_GIVEN.get(c, 'true')} THEN f.{c} ELSE fit.m{i} END) - fit.m{i}) / fit.d{i} AS x{i}" for i, c in enumerate(FEATURES)
    )
    + ", concat_ws(',', CASE WHEN l_orderkey % 3 = 0 THEN 'l_discount' END, CASE WHEN l_orderkey % 5 = 0 THEN 'l_tax' END) AS imputed_features"
    + " FROM flows f JOIN fit ON true LEFT JOIN context c ON f.src_ip = c.src_ip AND f.dst_ip = c.dst_ip",
)
layer_ctes("imputed", "tele_errs", X)
cte("tele_ctx", "tele_errs", "SELECT event_id, imputed_features, err AS anomaly_score, edge_attack_ratio, edge_attack_flow_count, edge_flow_count, edge_first_seen, edge_last_seen, edge_attack_label_count FROM tele_errs")
factor_ctes("tele_ctx", "tele", 0.05 * 20, "10.0", "40000.0")


def telemetry_rows(spark, sf):
    f = views.flows(spark, sf)
    k = F.col("l_orderkey")
    given = {"l_discount": k % 3 != 0, "l_tax": k % 5 != 0}
    entries = [F.when(given.get(c, F.lit(True)), F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))) for c in FEATURES]
    base = f.select("event_id", "src_ip", "dst_ip", F.map_from_entries(F.array_compact(F.array(*entries))).alias("features"))
    return context.attach_context(base, views.edges(spark, sf)), fitted_scaler(f)


@query("j8", f"SELECT event_id, {r('anomaly_score', 'anomaly_score')}, {r('risk_score', 'risk_score')}, risk_level, rules_applied, imputed_features FROM tele", "tele")
def j8(spark, sf):
    """Telemetry rows: impute, predict, context, risk."""
    from dataclasses import replace

    rows, scaler = telemetry_rows(spark, sf)
    out = scoring.score_telemetry(rows, scaler, fixed_network(), FEATURES, LIMIT, replace(RISK, anomaly_threshold=1.0))
    shown = out.select("event_id", "anomaly_score", "risk_score", "risk_level", "rules_applied", "imputed_features")
    return plain(shown)


def _model_row(name: str, source: str, pred: str, pos: str) -> str:
    return f"SELECT '{name}' AS model, tp, tn, fp, fn, {rates()} FROM (SELECT {cm(pred, pos)} FROM {source})"


@query("d50", _model_row("autoencoder", "test_errs", f"s >= {LIMIT}", "y") + " UNION ALL " + _model_row("knn", "votes", "p > 0.5", "truth = 1"), "test_errs votes")
def d50(spark, sf):
    """Two models side by side, same positive class."""
    cols = ["tp", "tn", "fp", "fn", "precision", "recall", "f1", "false_positive_rate"]
    a = metrics.threshold_metrics(held_out(spark, sf), "y", "s", LIMIT).select(F.lit("autoencoder").alias("model"), *cols)
    b = metrics.threshold_metrics(classified(spark, sf).withColumn("s", F.col("predicted_class").cast("double")), "truth", "s", 1.0)
    return plain(a.unionAll(b.select(F.lit("knn").alias("model"), *cols)))




# --- the security summary: every section of the report as one metric table ---
def _cells(section: str, key: str, source: str, counts: tuple[str, ...] = (), doubles: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> str:
    """``(section, key, metric, value)`` rows from the columns of a query."""
    shown = [(c, f"CAST({c} AS VARCHAR)") for c in (*counts, *texts)] + [(c, f"printf('%.6f', {c})") for c in doubles]
    names, values = ", ".join(f"'{c}'" for c, _ in shown), ", ".join(v for _, v in shown)
    return f"SELECT '{section}' AS section, {key} AS key, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM ({source})"


def _lines(section: str, df: DataFrame, key: str | None = None) -> DataFrame:
    """The same from a DataFrame."""
    shown = plain(df)
    doubles = {c: F.format_string("%.6f", F.col(c)) for c, kind in shown.dtypes if kind == "double" and c != key}
    return dashboard.metric_rows(section, shown.withColumns(doubles), key)


_MODEL = (("tp", "tn", "fp", "fn"), ("precision", "recall", "f1", "false_positive_rate"))
_RISK_STATS = f"SELECT {n()}, {r('avg(risk_score)', 'mean')}, {r('median(risk_score)', 'median')}, {r('stddev_samp(risk_score)', 'std')}, {r('min(risk_score)', 'min')}, {r('max(risk_score)', 'max')} FROM risk"
_BINS = (r("lo + b.i * ((hi - lo) / 10)", "range_start"), r("lo + (b.i + 1) * ((hi - lo) / 10)", "range_end"))
_SUMMARY = f"""SELECT {big('(SELECT count(*) FROM ev)', 'total_events')}, {big('(SELECT count(*) FROM det WHERE is_anomaly)', 'active_threats')},
  {big('(SELECT count(*) FROM risk WHERE risk_score >= 7.0)', 'high_risk_events')}, {big('(SELECT count(*) FROM det WHERE is_anomaly)', 'anomaly_count')},
  {big("(SELECT count(*) FROM ev WHERE traffic_class = 'BENIGN')", 'benign_count')}, {ts('(SELECT max(created_at) FROM ev)', 'last_ingested_at')}, 'operational' AS system_health"""
_LIVE = f"""SELECT {big("(SELECT count(*) FROM ev WHERE source = 'live')", 'total_live_events')},
  {big("(SELECT count(*) FROM det d JOIN ev e ON e.id = d.event_id WHERE e.source = 'live' AND d.is_anomaly)", 'detected_anomalies')},
  {big("(SELECT count(*) FROM act a JOIN ev e ON e.id = a.event_id WHERE e.source = 'live' AND a.actual_action = 'alerted')", 'alerts')},
  {big("(SELECT count(*) FROM act a JOIN ev e ON e.id = a.event_id WHERE e.source = 'live' AND a.actual_action IN ('blocked', 'would_block'))", 'threats_prevented_or_would_block')},
  {r("(SELECT avg(x.risk_score) FROM risk x JOIN ev e ON e.id = x.event_id WHERE e.source = 'live')", 'average_risk_score')}"""
REPORT = " UNION ALL ".join(
    [
        _cells("summary", "''", _SUMMARY, ("total_events", "active_threats", "high_risk_events", "anomaly_count", "benign_count"), (), ("last_ingested_at", "system_health")),
        _cells("active_model", "component", "SELECT component, CAST(max(id) AS BIGINT) AS run_id, arg_max(content_hash, id) AS content_hash, arg_max(f1, id) AS f1 FROM run_log GROUP BY 1", ("run_id",), ("f1",), ("content_hash",)),
        _cells("dataset_statistics", "''", STATISTICS, ("rows_before_dedup", "exact_duplicate_rows", "rows_after_dedup", "rows_after_inf_nan")),
        _cells("dataset", "traffic_class", f"SELECT traffic_class, {n()} FROM ev GROUP BY 1", ("n",)),
        _cells("live_statistics", "''", _LIVE, ("total_live_events", "detected_anomalies", "alerts", "threats_prevented_or_would_block"), ("average_risk_score",)),
        _cells("events_by_source", "source", f"SELECT source, {n()} FROM ev GROUP BY 1", ("n",)),
        _cells("attacks_by_type", "attack_type", f"SELECT canonical_attack_label AS attack_type, {n()} FROM ev WHERE canonical_attack_label <> 'BENIGN' GROUP BY 1", ("n",)),
        _cells("timeline", "bucket", f"SELECT {ts('bucket')}, {n('', 'event_count')}, {n('attack', 'attack_count')} FROM (SELECT date_trunc('hour', timestamp) AS bucket, traffic_class = 'ATTACK' AS attack FROM ev) GROUP BY bucket", ("event_count", "attack_count")),
        _cells("risk_distribution", "risk_level", f"SELECT risk_level, {n()} FROM risk GROUP BY 1", ("n",)),
        _cells("risk_summary", "''", _RISK_STATS, ("n",), ("mean", "median", "std", "min", "max")),
        _cells("anomaly_histogram", "CAST(bin AS VARCHAR)", HIST.format(*_BINS, "SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM det", "(SELECT anomaly_score AS v FROM det)"), ("n",), ("range_start", "range_end")),
        _cells("risk_histogram", "CAST(bin AS VARCHAR)", HIST.format(*_BINS, "SELECT 1.0::DOUBLE AS lo, 10.0::DOUBLE AS hi", "(SELECT risk_score AS v FROM risk)"), ("n",), ("range_start", "range_end")),
        _cells("prevention_by_action", "actual_action", f"SELECT actual_action, {n()} FROM act GROUP BY 1", ("n",)),
        _cells("graph", "''", f"SELECT {big('(SELECT count(*) FROM nodes)', 'node_count')}, {big('count(*)', 'edge_count')}, {big('sum(flow_count)', 'flow_count')} FROM edges", ("node_count", "edge_count", "flow_count")),
        _cells("top_destinations", "ip", f"SELECT dst_ip AS ip, {big('sum(attack_flow_count)', 'attack_flow_count')} FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", ("attack_flow_count",)),
        _cells("model_metrics", "model", _model_row("autoencoder", "test_errs", f"s >= {LIMIT}", "y"), *_MODEL),
        _cells("model_metrics", "model", _model_row("knn", "votes", "p > 0.5", "truth = 1"), *_MODEL),
    ]
)


@query("d46", REPORT, "ev det risk act edges nodes test_errs votes run_log stat_flows")
def d46(spark, sf):
    """Security summary: all sections of the report as one metric table, from tables written once."""
    from flowloom.operators.graph import build_nodes, top_totals

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, f"d46-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    edges = written(views.edges(spark, sf), "edges")
    scored = written(views.scored(spark, sf, False, edges).select(*views.EVENT_COLUMNS), "scored")  # scored once; no section reads an explanation
    events, detections, risks = views.relational(spark, sf, scored)
    acts = written(views.actions(spark, sf, scored).select("event_id", "actual_action"), "actions")
    log = runs.changed_runs(views.run_records(spark, sf))
    active = log.groupBy("component").agg(F.max("id").alias("run_id"), F.max_by("content_hash", "id").alias("content_hash"), F.max_by("f1", "id").alias("f1"))
    size = edges.agg(F.count("*").alias("edge_count"), F.sum("flow_count").alias("flow_count"))
    nodes = build_nodes(edges).agg(F.count("*").alias("n")).scalar()
    parts = [
        _lines("summary", dashboard.summary(events, detections, risks)),
        _lines("active_model", active, "component"),
        _lines("dataset_statistics", a9_stats(spark, sf)),
        _lines("dataset", events.groupBy("traffic_class").agg(F.count("*").alias("n")), "traffic_class"),
        _lines("live_statistics", dashboard.live_statistics(events, detections, risks, acts)),
        _lines("events_by_source", events.groupBy("source").agg(F.count("*").alias("n")), "source"),
        _lines("attacks_by_type", dashboard.attacks_by_type(events), "attack_type"),
        _lines("timeline", dashboard.timeline(events), "bucket"),
        _lines("risk_distribution", metrics.level_counts(risks), "risk_level"),
        _lines("risk_summary", metrics.score_summary(risks)),
        _lines("anomaly_histogram", metrics.histogram(detections, "anomaly_score"), "bin"),
        _lines("risk_histogram", metrics.histogram(risks, "risk_score", 10, 1.0, 10.0), "bin"),
        _lines("prevention_by_action", dashboard.action_counts(acts), "actual_action"),
        _lines("graph", size.withColumn("node_count", nodes)),
        _lines("top_destinations", top_totals(edges, "dst_ip").select("ip", "attack_flow_count"), "ip"),
        _lines("model_metrics", d50(spark, sf), "model"),
    ]
    return reduce(DataFrame.unionByName, parts)
