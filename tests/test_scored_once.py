"""Queries over several tables of scored flows: the flows are scored once, and only what is read is stored."""

import os

import pytest

from flowloom.functions.risk import score_risk
from flowloom.plans.catalog import QUERIES
from flowloom.plans.views import RISK
from flowloom.session import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,stored", [("c9", ["c9"]), ("d46", ["d46-actions", "d46-edges", "d46-scored"])])
def test_flows_are_scored_once(spark, name, stored):
    root = shared_dir(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = QUERIES[name](spark, SF)
    folders = {p.rsplit("-", 1)[0]: p for p in set(os.listdir(root)) - before if p.startswith(name)}
    assert sorted(folders) == stored
    kept = spark.read.parquet(f"{root}/{folders[stored[-1]]}").columns
    assert "risk_score" in kept and not {"factors", "reason"} & set(kept)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "10.1.0." not in plan  # no flow address is made again
    assert out.count() > 0


def test_the_explanation_is_compiled(spark):
    """A lambda over the factors is interpreted for every row; the ranked list is made once for its two uses."""
    context = "CAST(0.5 AS DOUBLE) edge_attack_ratio, 5L edge_attack_flow_count, 9L edge_flow_count, TIMESTAMP'2024-01-01' edge_first_seen, TIMESTAMP'2024-01-03' edge_last_seen, 2L edge_attack_label_count"
    rows = spark.sql(f"SELECT id / 10 AS anomaly_score, {context} FROM range(4)")
    out = rows.transform(score_risk(RISK))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and plan.count("transform(") == 1  # that of the fired rules
    for r in out.collect():
        assert [f.contribution for f in r.factors] == sorted((f.contribution for f in r.factors), reverse=True) and len(r.factors) == 5
        assert r.reason and not any(c.startswith("_") for c in out.columns)


def test_three_sinks_read_flows_that_are_scored_once(spark):
    """Each sink made the scores of all flows again; ids are hex text, which only a real coder makes smaller."""
    root = shared_dir(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = QUERIES["a11"](spark, SF)
    folders = {p.rsplit("-", 1)[0]: p for p in set(os.listdir(root)) - before if p.startswith("a11")}
    assert sorted(folders) == ["a11", "a11-scored"]
    scored = spark.read.parquet(f"{root}/{folders['a11-scored']}").count()
    for sink in ("events", "detections", "risk_assessments"):
        assert spark.read.parquet(f"{root}/{folders['a11']}/{sink}").count() == scored
        names = [f for _, _, files in os.walk(f"{root}/{folders['a11']}/{sink}") for f in files if f.endswith(".parquet")]
        assert names and all(".zstd." in f for f in names)
    assert out.count() == scored > 0
