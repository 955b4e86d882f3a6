"""All registered queries."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from flowloom.operators import graph
from flowloom.plans import views
from flowloom.plans.registry import ORACLES, QUERIES

for _module in ("q_sources", "q_clean", "q_graph", "q_profile", "q_metrics", "q_dashboard", "q_risk", "q_packets", "q_models", "q_streams"):
    importlib.import_module(f"flowloom.plans.{_module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top attack sources with the totals of their nodes."""
    edges = views.edges(spark, sf_dir)
    top = graph.top_by_attack(edges, "src_ip")
    nodes = graph.build_nodes(edges).withColumnRenamed("attack_flow_count", "node_attack_flow_count")
    return nodes.join(top, "ip").orderBy(top.attack_flow_count.desc(), "ip")


__all__ = ["ORACLES", "QUERIES", "flagship"]
