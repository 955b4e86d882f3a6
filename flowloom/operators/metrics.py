"""Classifier metrics, thresholds and risk evaluation tables.

Convention: label 1 (ATTACK) is positive; a row is predicted positive when its
score is at or above the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.ordered import percentile_columns, running_before, value_chunk
from flowloom.schemas import HIGH_RISK_SCORE


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _safe(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(_d(top), _d(bottom)), F.lit(0.0))


def confusion(positive: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if(positive & predicted).alias("tp"),
        F.count_if(~positive & ~predicted).alias("tn"),
        F.count_if(~positive & predicted).alias("fp"),
        F.count_if(positive & ~predicted).alias("fn"),
    ]


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false positive rate from tp/tn/fp/fn; 0 when undefined."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = df.withColumns({"precision": _safe(tp, tp + fp), "recall": _safe(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": _safe(2.0 * p * r, p + r), "false_positive_rate": _safe(fp, fp + tn)})


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float | Column) -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    counted = df.withColumn("_limit", limit).agg(
        F.max("_limit").alias("threshold"), *confusion(F.col(label) == 1, F.col(score) >= F.col("_limit"))
    )
    return rates(counted)


def class_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy and the macro and weighted averages over the two classes."""
    c = df.agg(*confusion(F.col(label) == 1, F.col(predicted) == 1))
    tp, tn, fp, fn = (_d(x) for x in ("tp", "tn", "fp", "fn"))
    n1, n0 = tp + fn, tn + fp
    one = {"precision": _safe(tp, tp + fp), "recall": _safe(tp, n1)}
    zero = {"precision": _safe(tn, tn + fn), "recall": _safe(tn, n0)}
    for m in (one, zero):
        m["f1"] = _safe(2.0 * m["precision"] * m["recall"], m["precision"] + m["recall"])
    averaged = []
    for name in ("precision", "recall", "f1"):
        averaged.append(_safe(n1 * one[name] + n0 * zero[name], n1 + n0).alias(f"{name}_weighted"))
        averaged.append(((one[name] + zero[name]) / 2.0).alias(f"{name}_macro"))
    return c.select("tp", "tn", "fp", "fn", _safe(tp + tn, n1 + n0).alias("accuracy"), *averaged)


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score: own and cumulative positives and negatives, from the top.

    Equal scores are merged first; the running sums walk slices of the score
    range, so no task holds the whole curve.
    """
    points = df.groupBy(_d(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    down = points.withColumn("_down", -F.col("score")).withColumn("_all", F.lit(0))
    run = running_before(
        down, ["_all"], ["_down"], value_chunk("_down"), {"_tp": ("sum", "pos"), "_fp": ("sum", "neg")},
        totals={"positives": "_tp", "negatives": "_fp"},
    )
    return run.select(
        "score",
        "pos",
        "neg",
        (F.coalesce("_tp", F.lit(0)) + F.col("pos")).alias("tp"),
        (F.coalesce("_fp", F.lit(0)) + F.col("neg")).alias("fp"),
        "positives",
        "negatives",
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve; tied scores count half."""
    c = score_curve(df, label, score)
    below = _d("negatives") - _d("fp")
    won = F.sum(_d("pos") * (below + _d("neg") / 2.0))
    return c.agg(F.try_divide(won, F.max(_d("positives")) * F.max(_d("negatives"))).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Step-wise area under the precision-recall curve (no interpolation)."""
    c = score_curve(df, label, score)
    step = _d("pos") / _d("positives") * _d("tp") / (_d("tp") + _d("fp"))
    return c.agg(F.sum(step).alias("pr_auc"))


def areas(df: DataFrame, label: str, score: str) -> DataFrame:
    """Both areas from one curve."""
    c = score_curve(df, label, score)
    below = _d("negatives") - _d("fp")
    won = F.sum(_d("pos") * (below + _d("neg") / 2.0))
    step = _d("pos") / _d("positives") * _d("tp") / (_d("tp") + _d("fp"))
    return c.agg(
        F.try_divide(won, F.max(_d("positives")) * F.max(_d("negatives"))).alias("roc_auc"), F.sum(step).alias("pr_auc")
    )


def percentile_threshold(benign: DataFrame, error: str, percentile: float = 95.0) -> DataFrame:
    return percentile_columns(benign, error, {"threshold": percentile / 100.0})


def mean_std_threshold(benign: DataFrame, error: str, k: float = 3.0) -> DataFrame:
    return benign.agg((F.avg(error) + F.lit(float(k)) * F.stddev_pop(error)).alias("threshold"))


def curve_thresholds(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(roc, pr)`` from one curve.

    ``roc``: the score with the largest TPR - FPR, the highest one on ties; NULL when no
    score beats 0, where an infinite threshold would be best. ``pr``: the score with
    the largest F1, the lowest one on ties.
    """
    j = F.round(_d("tp") / _d("positives") - _d("fp") / _d("negatives"), 12)
    f1 = F.round(2.0 * _d("tp") / (_d("tp") + _d("fp") + _d("positives")), 12)
    points = score_curve(df, label, score).select("score", j.alias("j"), f1.alias("f1"))
    best = points.agg(
        F.max_by(F.struct("score", "j"), F.struct("j", "score")).alias("b"), F.max_by("score", F.struct(F.col("f1"), -F.col("score"))).alias("pr")
    )
    return best.select(F.when(F.col("b.j") > 0, F.col("b.score")).alias("roc"), "pr")


def roc_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """Score with the largest TPR - FPR."""
    return curve_thresholds(df, label, score).select(F.col("roc").alias("threshold"))


def f1_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """Score with the largest F1."""
    return curve_thresholds(df, label, score).select(F.col("pr").alias("threshold"))


def compare_thresholds(df: DataFrame, label: str, score: str, percentile: float = 95.0, k: float = 3.0) -> DataFrame:
    """The four strategies with their metrics.

    The thresholds are scalar subqueries, both curve ones from one curve; all four
    confusion matrices come from one pass over the scores.
    """
    benign = df.filter(F.col(label) != 1)
    both = curve_thresholds(df, label, score).select(F.struct("roc", "pr").alias("c")).scalar()
    limits = {
        "percentile": percentile_threshold(benign, score, percentile).scalar(),
        "mean_std": mean_std_threshold(benign, score, k).scalar(),
        "roc": both["roc"],
        "pr": both["pr"],
    }
    options = F.array(*[F.struct(F.lit(n).alias("strategy"), t.alias("threshold")) for n, t in limits.items()])
    rows = df.select((F.col(label) == 1).alias("_y"), _d(score).alias("_s"), F.explode(options).alias("o"))
    counted = rows.groupBy(F.col("o.strategy").alias("strategy"), F.col("o.threshold").alias("threshold")).agg(
        *confusion(F.col("_y"), F.coalesce(F.col("_s") >= F.col("o.threshold"), F.lit(False)))
    )
    return rates(counted)


def error_stats(df: DataFrame, by: str, error: str) -> DataFrame:
    """Count, mean, median and population deviation per class."""
    base = df.groupBy(by).agg(
        F.count(error).alias("n"), F.avg(error).alias("mean"), F.stddev_pop(error).alias("std")
    )
    return base.join(percentile_columns(df, error, {"median": 0.5}, [by]), by)


def per_attack_table(df: DataFrame, label: str, score: str, threshold: float | Column, prefix: str) -> DataFrame:
    """Per attack label: count, mean, median and share at or above the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    attacks = df.filter(F.col(label) != "BENIGN").withColumn("_hit", (F.col(score) >= limit).cast("int").cast("double"))
    base = attacks.groupBy(F.col(label).alias("attack_type")).agg(
        F.count("*").alias("sample_count"), F.avg(score).alias(f"mean_{prefix}"), F.avg("_hit").alias("rate")
    )
    median = percentile_columns(attacks, score, {f"median_{prefix}": 0.5}, [label]).withColumnRenamed(label, "attack_type")
    return base.join(median, "attack_type").orderBy(F.desc("sample_count"), "attack_type")


# --- risk evaluation ---------------------------------------------------------
def score_summary(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """Count, mean, median, sample deviation, minimum, maximum."""
    median = percentile_columns(df, score, {"median": 0.5})
    return df.agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    ).withColumn("median", median.select("median").scalar())


def level_counts(df: DataFrame, level: str = "risk_level") -> DataFrame:
    return df.groupBy(level).agg(F.count("*").alias("n"))


def separation(df: DataFrame, by: str = "traffic_class", score: str = "risk_score") -> DataFrame:
    base = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    return base.join(percentile_columns(df, score, {"median": 0.5}, [by]), by)


def high_risk_metrics(df: DataFrame, threshold: float = HIGH_RISK_SCORE) -> DataFrame:
    attack = F.col("traffic_class") == "ATTACK"
    counted = df.agg(*confusion(attack, F.col("risk_score") >= threshold))
    return rates(counted).drop("false_positive_rate").withColumn("high_risk_threshold", F.lit(float(threshold)))


def _categories(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(n,) for n in names], "category string")


def edge_volume_context(df: DataFrame, categories: Sequence[str], small_edge: int = 5) -> DataFrame:
    """Per requested label: how much of it sits on small edges; absent labels give 0."""
    rows = df.filter(F.col("canonical_label").isin(*categories)).withColumnRenamed("canonical_label", "category")
    on_small = (F.col("edge_flow_count") <= small_edge).cast("int").cast("double")
    base = rows.groupBy("category").agg(F.count("*").alias("sample_count"), F.avg(on_small).alias("fraction_on_small_edges"))
    median = percentile_columns(rows, "edge_flow_count", {"median_edge_flow_count": 0.5}, ["category"])
    return (
        _categories(df, categories)
        .join(base, "category", "left")
        .join(median, "category", "left")
        .withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))
    )


def uplift_over_anomaly(
    df: DataFrame, categories: Sequence[str], anomaly_threshold: float, high_risk: float = HIGH_RISK_SCORE
) -> DataFrame:
    """Per requested label: detection by anomaly alone, by risk, and the gain."""
    flag = lambda c, t: (F.col(c) >= t).cast("int").cast("double")
    found = (
        df.filter(F.col("canonical_label").isin(*categories))
        .groupBy(F.col("canonical_label").alias("category"))
        .agg(
            F.count("*").alias("sample_count"),
            F.avg(flag("anomaly_score", anomaly_threshold)).alias("anomaly_alone_detection_rate"),
            F.avg(flag("risk_score", high_risk)).alias("risk_engine_detection_rate"),
        )
    )
    out = _categories(df, categories).join(found, "category", "left")
    gain = F.round(F.col("risk_engine_detection_rate") - F.col("anomaly_alone_detection_rate"), 4)
    return out.withColumns({"sample_count": F.coalesce("sample_count", F.lit(0)), "improvement": gain})


# --- histograms --------------------------------------------------------------
def histogram(df: DataFrame, value: str, bins: int = 10, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width bins, the last one closed, empty bins kept.

    Without a range the data's own is used, widened by 0.5 each side when it is
    a single point; with one, values outside are ignored.
    """
    v = df.select(_d(value).alias("v")).filter(F.col("v").isNotNull())
    spark = df.sparkSession
    if low is None:
        ends = v.agg(F.min("v").alias("a"), F.max("v").alias("z"))
        flat = F.col("a") == F.col("z")
        ends = ends.select(
            F.struct(
                F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("low"),
                F.when(flat, F.col("z") + 0.5).otherwise(F.col("z")).alias("high"),
            ).alias("e")
        )
        span = ends.scalar()
    else:
        span = F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    width = (F.col("e.high") - F.col("e.low")) / F.lit(float(bins))
    slot = F.least(F.floor((F.col("v") - F.col("e.low")) / width), F.lit(bins - 1))
    inside = F.col("v").between(F.col("e.low"), F.col("e.high"))
    counted = v.withColumn("e", span).filter(inside).groupBy(slot.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    table = all_bins.join(counted, "bin", "left").withColumn("e", span)
    if low is None:
        table = table.filter(F.col("e.low").isNotNull())
    return table.select(
        "bin",
        (F.col("e.low") + F.col("bin") * width).alias("range_start"),
        (F.col("e.low") + (F.col("bin") + 1) * width).alias("range_end"),
        F.coalesce("c", F.lit(0)).alias("n"),
    )
