"""The 1-10 risk score as pure Column expressions.

Every function takes Columns and returns a Column, so a whole scoring run is
one projection inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.parsing import bind, micros
from flowloom.schemas import (
    FACTOR_WORDING,
    NO_FACTOR_WORDING,
    RISK_LEVELS,
    RULE_WORDING,
    TOP_RISK_LEVEL,
    RiskConfig,
)

CONTEXT_COLUMNS = (
    "edge_attack_ratio",
    "edge_attack_flow_count",
    "edge_flow_count",
    "edge_first_seen",
    "edge_last_seen",
    "edge_attack_label_count",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _guard(bad: Column, message: str, value: Column) -> Column:
    """``value``, or a failed job where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def anomaly_severity(score: Column | str, threshold: float) -> Column:
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    s = _col(score)
    return _guard(s < 0, "anomaly_score must not be negative", 1.0 - F.exp(-s / F.lit(float(threshold))))


def attack_ratio_norm(ratio: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_col(ratio).cast("double"), F.lit(0.0))))


def attack_activity_norm(count: Column | str, scale: float) -> Column:
    c = _col(count)
    share = F.log1p(c.cast("double")) / F.log1p(F.lit(float(scale)))
    return F.when(c > 0, F.least(F.lit(1.0), share)).otherwise(0.0)


def temporal_persistence_norm(first: Column | str, last: Column | str, scale_hours: float) -> Column:
    hours = (micros(last) - micros(first)) / F.lit(3.6e9)
    share = F.greatest(F.lit(0.0), hours) / F.lit(float(scale_hours))
    return F.coalesce(F.least(F.lit(1.0), share), F.lit(0.0))


def attack_context_norm(label_count: Column | str, cap: int) -> Column:
    c = _col(label_count)
    return F.when(c > 0, F.least(F.lit(1.0), c / F.lit(float(cap)))).otherwise(0.0)


def factor_columns(score: Column | str, cfg: RiskConfig) -> dict[str, Column]:
    """The five normalised factors, named as in the weight table."""
    ratio = _col("edge_attack_ratio")
    outside = (ratio < 0) | (ratio > 1)
    return {
        "anomaly_severity": anomaly_severity(score, cfg.anomaly_threshold),
        "edge_attack_ratio": _guard(outside, "edge_attack_ratio must be in [0,1]", attack_ratio_norm(ratio)),
        "attack_activity": attack_activity_norm("edge_attack_flow_count", cfg.attack_activity_scale),
        "temporal_persistence": temporal_persistence_norm("edge_first_seen", "edge_last_seen", cfg.temporal_scale_hours),
        "attack_context": attack_context_norm("edge_attack_label_count", cfg.attack_label_cap),
    }


def raw_risk(factors: dict[str, Column], cfg: RiskConfig) -> Column:
    total = F.lit(0.0)
    for name, weight in cfg.weights.items():
        total = total + F.lit(weight) * factors[name]
    return total


def calibrate(raw: Column) -> Column:
    return 1.0 + 9.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def rule_conditions(severity: Column, cfg: RiskConfig) -> dict[str, tuple[Column, float]]:
    """Rule name to (condition, score change). Missing context counts as zero."""
    flows = F.coalesce(_col("edge_flow_count"), F.lit(0))
    attacks = F.coalesce(_col("edge_attack_flow_count"), F.lit(0))
    ratio = F.coalesce(_col("edge_attack_ratio"), F.lit(0.0))
    return {
        "repeated_attack_heavy_communication": (
            (ratio >= cfg.repeated_attack_edge_ratio) & (flows >= cfg.repeated_attack_min_flows),
            cfg.repeated_attack_bonus,
        ),
        "very_high_anomaly": (severity >= cfg.high_anomaly_severity, cfg.high_anomaly_bonus),
        "isolated_low_volume_weak_evidence": (
            (attacks <= cfg.isolated_max_attack_flows)
            & (flows <= cfg.isolated_max_total_flows)
            & (severity < cfg.isolated_max_anomaly_severity),
            -cfg.isolated_penalty,
        ),
    }


def apply_rules(calibrated: Column, severity: Column, cfg: RiskConfig) -> tuple[Column, Column]:
    """Clipped score after the rules, and the names of those that fired."""
    score, fired = calibrated, []
    for name, (holds, change) in rule_conditions(severity, cfg).items():
        score = score + F.when(holds, F.lit(change)).otherwise(0.0)
        fired.append(F.when(holds, F.lit(name)))
    clipped = F.greatest(F.lit(1.0), F.least(F.lit(10.0), score))
    return clipped, F.array_compact(F.array(*fired))


def risk_level(score: Column | str) -> Column:
    """Level of an unrounded score; bands are closed below, open above."""
    s = _col(score)
    level = None
    for upper, name in RISK_LEVELS:
        level = F.when(s < upper, name) if level is None else level.when(s < upper, name)
    return level.otherwise(TOP_RISK_LEVEL)


def _ranked(rounded: dict[str, tuple[Column, Column]]) -> Column:
    """Factors by name with their rounded value and contribution: biggest contribution first, ties in weight order."""
    entries = [
        F.struct((-share).alias("rank"), F.lit(position).alias("position"), F.lit(name).alias("name"), value.alias("value"), share.alias("contribution"))
        for position, (name, (value, share)) in enumerate(rounded.items())
    ]
    return F.sort_array(F.array(*entries))


def _rounded(factors: dict[str, Column], cfg: RiskConfig) -> dict[str, tuple[Column, Column]]:
    return {name: (F.round(factors[name], 4), F.round(F.lit(weight) * factors[name], 4)) for name, weight in cfg.weights.items()}


def _shown(ranked: Column, n: int) -> Column:
    """The ranked factors without what they were ranked by; a plain array, because a lambda is not compiled."""
    return F.array(*[F.struct(*[F.get(ranked, F.lit(i))[c].alias(c) for c in ("name", "value", "contribution")]) for i in range(n)])


def factor_list(factors: dict[str, Column], cfg: RiskConfig) -> Column:
    """Factors rounded to 4 places, biggest contribution first, ties in weight order."""
    return _shown(_ranked(_rounded(factors, cfg)), len(cfg.weights))


def explain(factor_array: Column | str, rules: Column | str) -> Column:
    """One sentence: the two leading factors above zero, then the fired rules."""
    wording = F.create_map(*[F.lit(x) for pair in FACTOR_WORDING.items() for x in pair])
    rule_wording = F.create_map(*[F.lit(x) for pair in RULE_WORDING.items() for x in pair])

    def phrase(f: Column) -> Column:
        strength = F.when(f["value"] >= 0.6, "High").when(f["value"] >= 0.3, "Moderate").otherwise("Low")
        return F.when(f["value"] > 0, F.concat(strength, F.lit(" "), F.element_at(wording, f["name"])))

    top = [phrase(F.get(_col(factor_array), F.lit(i))) for i in range(2)]
    lead = F.coalesce(F.nullif(F.concat_ws(" combined with ", *top), F.lit("")), F.lit(NO_FACTOR_WORDING))
    fired = _col(rules)
    tail = F.array_join(F.transform(fired, lambda r: F.coalesce(F.try_element_at(rule_wording, r), r)), ", ")
    return F.when(F.size(fired) > 0, F.concat(lead, F.lit("; adjusted for "), tail)).otherwise(lead)


def score_risk(cfg: RiskConfig, score: str = "anomaly_score", explained: bool = True):
    """Transform adding the risk columns: ``df.transform(score_risk(cfg))``.

    Needs ``score`` and the six ``edge_*`` context columns (NULL when unknown).
    """

    def run(df: DataFrame) -> DataFrame:
        names = list(cfg.weights)
        factors = factor_columns(score, cfg)
        # a filter on the score would copy all its terms into every use of it
        staged = bind(df, **{f"_f_{n}": factors[n] for n in names})
        held = {n: F.col(f"_f_{n}") for n in names}
        final, fired = apply_rules(calibrate(raw_risk(held, cfg)), held["anomaly_severity"], cfg)
        staged = bind(staged, _final=final, rules_applied=fired)
        out = staged.withColumns({"risk_score": F.round("_final", 4), "risk_level": risk_level("_final")})
        if explained:
            # rounding goes through decimals: once per value, and the ranked list is made once for its two uses
            rounded = _rounded(held, cfg)
            out = bind(out, **{f"{k}_{n}": c for n, pair in rounded.items() for k, c in zip("_v _s".split(), pair)})
            out = bind(out, _ranked=_ranked({n: (F.col(f"_v_{n}"), F.col(f"_s_{n}")) for n in names}))
            out = out.withColumns(
                {
                    "factors": _shown(F.col("_ranked"), len(names)),
                    "reason": explain("_ranked", "rules_applied"),
                    "config_version": F.lit(cfg.version),
                }
            )
        return out.drop("_final", "_ranked", *[f"_{k}_{n}" for n in names for k in "fvs"])

    return run
