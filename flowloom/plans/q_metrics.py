"""Thresholds, classifier metrics, risk evaluation and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import metrics
from flowloom.plans import views
from flowloom.plans.oracle import big, n, r
from flowloom.plans.registry import query
from flowloom.plans.views import THRESHOLD, plain

CATEGORIES = ("Bot", "PortScan", "Web Attack - XSS", "Heartbleed")


def labelled(spark, sf):
    """Scores with ``y`` = 1 for attacks."""
    return views.flows(spark, sf).select("canonical_label", "traffic_class", "anomaly_score", (F.col("canonical_label") != "BENIGN").cast("int").alias("y"))


Y = "CAST(canonical_label <> 'BENIGN' AS INTEGER)"
BASE = f"y AS (SELECT {Y} AS y, anomaly_score AS s, canonical_label FROM flows)"


def rates(tp="tp", tn="tn", fp="fp", fn="fn", fpr=True) -> str:
    p, rc = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
    out = f"{r(p, 'precision')}, {r(rc, 'recall')}, {r(f'coalesce(2.0 * {tp} / nullif(2.0 * {tp} + {fp} + {fn}, 0), 0)', 'f1')}"
    return out + (f", {r(f'coalesce({fp} / nullif({fp} + {tn}, 0), 0)', 'false_positive_rate')}" if fpr else "")


def cm(pred: str, pos: str = "y = 1") -> str:
    return f"""{n(f'{pos} AND {pred}', 'tp')}, {n(f'NOT ({pos}) AND NOT ({pred})', 'tn')}, {n(f'NOT ({pos}) AND {pred}', 'fp')}, {n(f'{pos} AND NOT ({pred})', 'fn')}"""


@query("d21", f"WITH {BASE}, m AS (SELECT {cm('s >= 0.05')} FROM y) SELECT CAST(0.05 AS DOUBLE) AS threshold, tp, tn, fp, fn, {rates()} FROM m", "flows")
def d21(spark, sf):
    """Confusion matrix and rates at a threshold."""
    return plain(metrics.threshold_metrics(labelled(spark, sf), "y", "anomaly_score", THRESHOLD))


def class_metrics_sql(source: str) -> str:
    one = {"precision": "tp / nullif(tp + fp, 0)", "recall": "tp / nullif(tp + fn, 0)", "f1": "2.0 * tp / nullif(2.0 * tp + fp + fn, 0)"}
    zero = {"precision": "tn / nullif(tn + fn, 0)", "recall": "tn / nullif(tn + fp, 0)", "f1": "2.0 * tn / nullif(2.0 * tn + fp + fn, 0)"}
    cols = []
    for k in one:
        a, b = f"coalesce({one[k]}, 0)", f"coalesce({zero[k]}, 0)"
        cols.append(r(f"((tp + fn) * {a} + (tn + fp) * {b}) / (tp + tn + fp + fn)", f"{k}_weighted"))
        cols.append(r(f"({a} + {b}) / 2", f"{k}_macro"))
    return f"SELECT tp, tn, fp, fn, {r('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {', '.join(cols)} FROM ({source})"


@query("d22", f"WITH {BASE} " + class_metrics_sql(f"SELECT {cm('s >= 0.05')} FROM y"), "flows")
def d22(spark, sf):
    """Accuracy, macro and weighted precision, recall and F1."""
    df = labelled(spark, sf).withColumn("p", (F.col("anomaly_score") >= THRESHOLD).cast("int"))
    return plain(metrics.class_metrics(df, "y", "p"))


CURVE = f"""{BASE}, pts AS (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM y GROUP BY s),
  curve AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM pts)"""


@query("d23", f"WITH {CURVE} SELECT {r('sum(pos * (q - fp + neg / 2.0)) / (any_value(p) * any_value(q))', 'roc_auc')} FROM curve", "flows")
def d23(spark, sf):
    """ROC-AUC with tied scores."""
    return plain(metrics.roc_auc(labelled(spark, sf), "y", "anomaly_score"))


@query("d24", f"WITH {CURVE} SELECT {r('sum(pos / p * (tp / (tp + fp)))', 'pr_auc')} FROM curve", "flows")
def d24(spark, sf):
    """Average precision, step-wise."""
    return plain(metrics.average_precision(labelled(spark, sf), "y", "anomaly_score"))


@query("d25", f"WITH {BASE} SELECT {r('quantile_cont(s, 0.95)', 'threshold')} FROM y WHERE y = 0", "flows")
def d25(spark, sf):
    """Exact 95th percentile of benign errors."""
    return plain(metrics.percentile_threshold(labelled(spark, sf).filter("y = 0"), "anomaly_score"))


@query("d26", f"WITH {BASE} SELECT {r('avg(s) + 3 * stddev_pop(s)', 'threshold')} FROM y WHERE y = 0", "flows")
def d26(spark, sf):
    return plain(metrics.mean_std_threshold(labelled(spark, sf).filter("y = 0"), "anomaly_score"))


ROC_T = "(SELECT CASE WHEN j > 0 THEN s END FROM (SELECT s, round(tp / p - fp / q, 12) AS j FROM curve) ORDER BY j DESC, s DESC LIMIT 1)"
PR_T = "(SELECT s FROM (SELECT s, round(2.0 * tp / (tp + fp + p), 12) AS f FROM curve) ORDER BY f DESC, s LIMIT 1)"


@query("d27", f"WITH {CURVE} SELECT {r(ROC_T, 'threshold')}", "flows")
def d27(spark, sf):
    """Threshold with the largest TPR - FPR."""
    return plain(metrics.roc_threshold(labelled(spark, sf), "y", "anomaly_score"))


@query("d28", f"WITH {CURVE} SELECT {r(PR_T, 'threshold')}", "flows")
def d28(spark, sf):
    """Threshold with the largest F1."""
    return plain(metrics.f1_threshold(labelled(spark, sf), "y", "anomaly_score"))


@query(
    "d29",
    f"""WITH {CURVE}, t AS (SELECT 'percentile' AS strategy, (SELECT quantile_cont(s, 0.95) FROM y WHERE y = 0) AS t
      UNION ALL SELECT 'mean_std', (SELECT avg(s) + 3 * stddev_pop(s) FROM y WHERE y = 0) UNION ALL SELECT 'roc', {ROC_T} UNION ALL SELECT 'pr', {PR_T}),
    m AS (SELECT strategy, t, {cm('s >= t')} FROM t, y GROUP BY 1, 2)
    SELECT strategy, {r('t', 'threshold')}, tp, tn, fp, fn, {rates()} FROM m""",
    "flows",
)
def d29(spark, sf):
    """Four threshold strategies compared."""
    return plain(metrics.compare_thresholds(labelled(spark, sf), "y", "anomaly_score"))


@query("d30", f"""SELECT traffic_class, {n()}, {r('avg(anomaly_score)', 'mean')}, {r('stddev_pop(anomaly_score)', 'std')}, {r('median(anomaly_score)', 'median')} FROM flows GROUP BY 1""", "flows")
def d30(spark, sf):
    return plain(metrics.error_stats(labelled(spark, sf), "traffic_class", "anomaly_score"))


@query(
    "d31",
    f"""SELECT canonical_label AS attack_type, {n('', 'sample_count')}, {r('avg(anomaly_score)', 'mean_reconstruction_error')},
      {r('median(anomaly_score)', 'median_reconstruction_error')}, {r('avg(CASE WHEN anomaly_score >= 0.05 THEN 1.0 ELSE 0.0 END)', 'detection_rate')}
    FROM flows WHERE canonical_label <> 'BENIGN' GROUP BY 1""",
    "flows",
)
def d31(spark, sf):
    """Per-attack detection table."""
    t = metrics.per_attack_table(labelled(spark, sf), "canonical_label", "anomaly_score", THRESHOLD, "reconstruction_error")
    return plain(t.withColumnRenamed("rate", "detection_rate"))


def risk(spark, sf):
    return views.scored(spark, sf, explained=False)


@query(
    "d32",
    f"""SELECT {n()}, {r('avg(risk_score)', 'mean')}, {r('median(risk_score)', 'median')}, {r('stddev_samp(risk_score)', 'std')},
      {r('min(risk_score)', 'min')}, {r('max(risk_score)', 'max')} FROM scored""",
    "scored",
)
def d32(spark, sf):
    return plain(metrics.score_summary(risk(spark, sf)))


@query("d33", f"SELECT risk_level, {n()} FROM scored GROUP BY 1", "scored")
def d33(spark, sf):
    return plain(metrics.level_counts(risk(spark, sf)))


@query("d34", f"SELECT traffic_class, {n()}, {r('avg(risk_score)', 'mean')}, {r('median(risk_score)', 'median')} FROM scored GROUP BY 1", "scored")
def d34(spark, sf):
    return plain(metrics.separation(risk(spark, sf)))


@query(
    "d35",
    f"""SELECT canonical_label AS attack_type, {n('', 'sample_count')}, {r('avg(risk_score)', 'mean_risk_score')}, {r('median(risk_score)', 'median_risk_score')},
      {r('avg(CASE WHEN risk_score >= 5.0 THEN 1.0 ELSE 0.0 END)', 'high_risk_rate')} FROM scored WHERE canonical_label <> 'BENIGN' GROUP BY 1""",
    "scored",
)
def d35(spark, sf):
    t = metrics.per_attack_table(risk(spark, sf), "canonical_label", "risk_score", 5.0, "risk_score")
    return plain(t.withColumnRenamed("rate", "high_risk_rate"))


IS_ATTACK = "traffic_class = 'ATTACK'"


@query("d36", f"WITH m AS (SELECT {cm('risk_score >= 5.0', IS_ATTACK)} FROM scored) SELECT CAST(5.0 AS DOUBLE) AS high_risk_threshold, tp, tn, fp, fn, {rates(fpr=False)} FROM m", "scored")
def d36(spark, sf):
    return plain(metrics.high_risk_metrics(risk(spark, sf), 5.0))


CAT = "(SELECT unnest(['Bot', 'PortScan', 'Web Attack - XSS', 'Heartbleed']) AS category) c"


@query(
    "d37",
    f"""SELECT c.category, {big('count(s.canonical_label)', 'sample_count')}, {r('median(s.edge_flow_count)', 'median_edge_flow_count')},
      {r('avg(CASE WHEN s.edge_flow_count <= 10 THEN 1.0 WHEN s.edge_flow_count > 10 THEN 0.0 END)', 'fraction_on_small_edges')}
    FROM {CAT} LEFT JOIN scored s ON s.canonical_label = c.category GROUP BY 1""",
    "scored",
)
def d37(spark, sf):
    """Edge volume behind each requested label; absent ones give 0."""
    return plain(metrics.edge_volume_context(risk(spark, sf), CATEGORIES, 10))


@query(
    "d38",
    f"""SELECT category, sample_count, {r('a', 'anomaly_alone_detection_rate')}, {r('b', 'risk_engine_detection_rate')}, round(b - a, 4) + 0.0 AS improvement FROM (
      SELECT c.category, {big('count(s.canonical_label)', 'sample_count')}, avg(CASE WHEN s.anomaly_score >= 0.05 THEN 1.0 WHEN s.anomaly_score < 0.05 THEN 0.0 END) AS a,
        avg(CASE WHEN s.risk_score >= 5.0 THEN 1.0 WHEN s.risk_score < 5.0 THEN 0.0 END) AS b FROM {CAT} LEFT JOIN scored s ON s.canonical_label = c.category GROUP BY 1)""",
    "scored",
)
def d38(spark, sf):
    """Detection gain of the risk score over the anomaly score alone."""
    return plain(metrics.uplift_over_anomaly(risk(spark, sf), CATEGORIES, THRESHOLD, 5.0))


@query(
    "d39",
    """SELECT round(quantile_cont(CAST(attack_flow_count AS DOUBLE), 0.95) FILTER (WHERE attack_flow_count > 0), 2) AS attack_activity_scale,
      round(quantile_cont((epoch_us(last_seen) - epoch_us(first_seen)) / 3.6e9, 0.95) FILTER (WHERE flow_count > 1), 2) AS temporal_scale_hours,
      CAST(count(*) FILTER (WHERE attack_flow_count > 0) AS BIGINT) AS edges_used_for_activity_scale,
      CAST(count(*) FILTER (WHERE flow_count > 1) AS BIGINT) AS edges_used_for_temporal_scale FROM edges""",
    "edges",
)
def d39(spark, sf):
    """Normalisation scales from the edge table."""
    from flowloom.operators.context import scale_parameters

    return plain(scale_parameters(views.edges(spark, sf)))


HIST = """SELECT CAST(b.i AS BIGINT) AS bin, {0}, {1}, CAST(count(v) AS BIGINT) AS n FROM (SELECT unnest(range(10)) AS i) b CROSS JOIN ({2}) e
  LEFT JOIN {3} t ON least(floor((v - lo) / ((hi - lo) / 10)), 9) = b.i AND v BETWEEN lo AND hi GROUP BY b.i, lo, hi"""


@query(
    "d43",
    HIST.format(r("lo + b.i * ((hi - lo) / 10)", "range_start"), r("lo + (b.i + 1) * ((hi - lo) / 10)", "range_end"),
                "SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM det", "(SELECT anomaly_score AS v FROM det)"),
    "det",
)
def d43(spark, sf):
    """Equal-width histogram over the data's own range."""
    _, detections, _ = views.relational(spark, sf)
    return plain(metrics.histogram(detections, "anomaly_score"))


@query(
    "d44",
    HIST.format(r("lo + b.i * ((hi - lo) / 10)", "range_start"), r("lo + (b.i + 1) * ((hi - lo) / 10)", "range_end"),
                "SELECT 1.0::DOUBLE AS lo, 10.0::DOUBLE AS hi", "(SELECT risk_score AS v FROM risk)"),
    "risk",
)
def d44(spark, sf):
    """Equal-width histogram on the fixed 1-10 range."""
    _, _, risks = views.relational(spark, sf)
    return plain(metrics.histogram(risks, "risk_score", 10, 1.0, 10.0))
