"""Edge and node tables, components, top lists and subgraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import components, graph
from flowloom.operators.clean import clean_flows, within_window
from flowloom.plans import views
from flowloom.plans.oracle import EDGE_AGG, EDGE_OUT, big, n, ts
from flowloom.plans.registry import query
from flowloom.plans.views import plain


def both(spark, sf):
    edges = views.edges(spark, sf)
    return graph.build_nodes(edges), edges


@query("d1", f"SELECT {EDGE_OUT} FROM edges", "edges")
def d1(spark, sf):
    """Edge aggregate per (source, destination)."""
    return plain(views.edges(spark, sf))


@query("d1_cleaned", f"SELECT {EDGE_OUT} FROM (SELECT src_ip, dst_ip, {EDGE_AGG} FROM clean GROUP BY 1, 2)", "clean")
def d1_cleaned(spark, sf):
    """The whole graph build: raw text rows, rejects, edges."""
    return plain(graph.build_edges(clean_flows(views.raw_flows(spark, sf))))


@query(
    "d1_window",
    f"SELECT {EDGE_OUT} FROM (SELECT src_ip, dst_ip, {EDGE_AGG} FROM flows WHERE ts BETWEEN '1998-03-01' AND '1998-06-01' GROUP BY 1, 2)",
    "flows",
)
def d1_window(spark, sf):
    """Edges of one time window, inclusive at both ends."""
    return plain(graph.build_edges(views.flows(spark, sf).filter(within_window("ts", "1998-03-01", "1998-06-01"))))


@query("d2", "SELECT ip, total_flow_count, benign_flow_count, attack_flow_count, attack_ratio FROM nodes", "nodes")
def d2(spark, sf):
    """Node totals over both ends of every edge."""
    nodes, _ = both(spark, sf)
    return plain(nodes.select("ip", "total_flow_count", "benign_flow_count", "attack_flow_count", "attack_ratio"))


@query(
    "d3",
    """SELECT ip, in_degree, out_degree, degree, unique_source_count, unique_destination_count FROM nodes
    UNION ALL SELECT 'isolated-' || r_regionkey, 0, 0, 0, 0, 0 FROM region""",
    "nodes",
)
def d3(spark, sf):
    """Degrees; isolated nodes get 0."""
    nodes, edges = both(spark, sf)
    alone = views.table(spark, sf, "region").select(F.concat(F.lit("isolated-"), F.col("r_regionkey").cast("string")).alias("ip"))
    return plain(graph.annotate_degrees(nodes.select("ip").unionAll(alone), edges))


REACH = """und AS (SELECT src_ip AS a, dst_ip AS b FROM {0} UNION SELECT dst_ip, src_ip FROM {0}),
  reach(node, r) AS (SELECT a, a FROM und UNION SELECT reach.node, und.b FROM reach JOIN und ON reach.r = und.a),
  comp AS (SELECT node, min(r) AS component FROM reach GROUP BY node)"""


@query(
    "d4",
    f"""WITH {REACH.format('edges')}, sizes AS (SELECT count(*) AS size FROM comp GROUP BY component)
    SELECT {big('(SELECT count(*) FROM nodes)', 'node_count')}, {n('', 'edge_count')}, {big('sum(flow_count)', 'total_flows')},
      {big('sum(benign_flow_count)', 'benign_flows')}, {big('sum(attack_flow_count)', 'attack_flows')},
      round(sum(attack_flow_count) / CAST(sum(flow_count) AS DOUBLE), 6) AS attack_flow_ratio,
      round(count(*) / CAST((SELECT count(*) FROM nodes) AS DOUBLE), 4) AS avg_in_degree,
      round(count(*) / CAST((SELECT count(*) FROM nodes) AS DOUBLE), 4) AS avg_out_degree,
      {big('(SELECT count(*) FROM sizes)', 'component_count')}, {big('(SELECT max(size) FROM sizes)', 'largest_component')},
      array_to_string((SELECT list_sort(list(size), 'DESC')[1:10] FROM sizes), ',') AS component_sizes_top FROM edges""",
    "edges nodes",
    recursive=True,
)
def d4(spark, sf):
    """Graph summary with component structure."""
    nodes, edges = both(spark, sf)
    return plain(graph.summarize(nodes, edges, components.component_sizes(edges)))


@query("d5", f"WITH {REACH.format('sparse')} SELECT node, component FROM comp", "sparse", recursive=True)
def d5(spark, sf):
    """Weakly connected components of a thin graph."""
    return components.connected_components(views.sparse_edges(spark, sf))


@query("d5_sizes", f"WITH {REACH.format('sparse')} SELECT component, {n('', 'size')} FROM comp GROUP BY 1", "sparse", recursive=True)
def d5_sizes(spark, sf):
    return plain(components.component_sizes(views.sparse_edges(spark, sf)))


@query("d6", f"SELECT label, {n('', 'edge_count')} FROM (SELECT unnest(attack_labels) AS label FROM edges) GROUP BY 1", "edges")
def d6(spark, sf):
    return plain(graph.attack_type_distribution(views.edges(spark, sf)))


@query("d7", "SELECT ip FROM nodes WHERE attack_flow_count > 0", "nodes")
def d7(spark, sf):
    return graph.attack_nodes(both(spark, sf)[0])


@query(
    "e4",
    f"""SELECT {ts('window_start')}, {EDGE_OUT} FROM (SELECT date_trunc('hour', ts) AS window_start, src_ip, dst_ip, {EDGE_AGG} FROM flows GROUP BY 1, 2, 3)""",
    "flows",
)
def e4(spark, sf):
    """Edges of all consecutive hourly windows in one pass."""
    return plain(graph.hourly_edges(views.flows(spark, sf)))


@query(
    "e4_range",
    f"""SELECT {ts('window_start')}, {ts("least(window_start + INTERVAL 1 HOUR, TIMESTAMP '1998-02-01 00:30:00')", 'window_end')}, src_ip, dst_ip, flow_count FROM (
      SELECT TIMESTAMP '1998-01-01 00:30:00' + INTERVAL 1 HOUR * CAST(floor(epoch(ts - TIMESTAMP '1998-01-01 00:30:00') / 3600) AS BIGINT) AS window_start,
        src_ip, dst_ip, count(*) AS flow_count FROM flows WHERE ts >= '1998-01-01 00:30:00' AND ts < '1998-02-01 00:30:00' GROUP BY 1, 2, 3)""",
    "flows",
)
def e4_range(spark, sf):
    """Windows counted from a start, the last one clipped at the end."""
    w = graph.window_edges(views.flows(spark, sf), "1998-01-01 00:30:00", "1998-02-01 00:30:00")
    return plain(w.select("window_start", "window_end", "src_ip", "dst_ip", "flow_count"))


@query("f1", "SELECT * FROM nodes ORDER BY total_flow_count DESC, ip LIMIT 10", "nodes")
def f1(spark, sf):
    return plain(graph.high_activity_nodes(both(spark, sf)[0]))


def _top(end: str) -> str:
    return f"""SELECT {end} AS ip, {big('sum(attack_flow_count)', 'attack_flow_count')} FROM edges GROUP BY 1
      HAVING sum(attack_flow_count) > 0 ORDER BY 2 DESC, 1 LIMIT 10"""


@query("f2", _top("src_ip"), "edges")
def f2(spark, sf):
    return plain(graph.top_by_attack(views.edges(spark, sf), "src_ip"))


@query("f3", _top("dst_ip"), "edges")
def f3(spark, sf):
    return plain(graph.top_by_attack(views.edges(spark, sf), "dst_ip"))


@query("f4", "SELECT ip, unique_destination_count FROM nodes ORDER BY 2 DESC, 1 LIMIT 10", "nodes")
def f4(spark, sf):
    return plain(graph.widest_sources(both(spark, sf)[0]))


@query("f5", f"SELECT {EDGE_OUT} FROM (SELECT * FROM edges WHERE flow_count >= 5 AND attack_ratio > 0 ORDER BY attack_ratio DESC, src_ip, dst_ip LIMIT 10)", "edges")
def f5(spark, sf):
    return plain(graph.high_ratio_edges(views.edges(spark, sf)))


def _chosen(body: str, select: str = "'edge' AS part, src_ip || '>' || dst_ip AS key, flow_count AS n") -> str:
    return f"""WITH chosen AS ({body}) SELECT {select} FROM chosen
      UNION ALL SELECT 'node', ip, total_flow_count FROM nodes WHERE ip IN (SELECT src_ip FROM chosen UNION SELECT dst_ip FROM chosen)"""


def _shown(pair):
    nodes, edges = pair
    e = edges.select(F.lit("edge").alias("part"), F.concat_ws(">", "src_ip", "dst_ip").alias("key"), F.col("flow_count").alias("n"))
    return plain(e.unionAll(nodes.select(F.lit("node"), "ip", "total_flow_count")))


@query("f6", _chosen("SELECT * FROM edges WHERE attack_flow_count > 0 ORDER BY attack_flow_count DESC, attack_ratio DESC, src_ip, dst_ip LIMIT 30"), "edges nodes")
def f6(spark, sf):
    """Subgraph of the edges with most attack flows."""
    return _shown(graph.select_subgraph(*both(spark, sf)))


@query("f7", _chosen("SELECT * FROM edges WHERE attack_flow_count >= 8"), "edges nodes")
def f7(spark, sf):
    return _shown(graph.select_subgraph(*both(spark, sf), strategy="min_attack_threshold", min_attack_flows=8))


@query("f8", _chosen("SELECT * FROM edges WHERE src_ip = '10.0.0.7' OR dst_ip = '10.0.0.7' ORDER BY flow_count DESC, src_ip, dst_ip LIMIT 20"), "edges nodes")
def f8(spark, sf):
    return _shown(graph.select_subgraph(*both(spark, sf), strategy="neighborhood", ip="10.0.0.7", max_edges=20))


@query(
    "c8",
    "SELECT * FROM nodes WHERE ip IN (SELECT src_ip FROM edges WHERE attack_ratio >= 0.75 UNION SELECT dst_ip FROM edges WHERE attack_ratio >= 0.75)",
    "edges nodes",
)
def c8(spark, sf):
    """Nodes touched by selected edges (semi join)."""
    nodes, edges = both(spark, sf)
    return plain(graph.touched_nodes(nodes, edges.filter("attack_ratio >= 0.75")))


QUERY = "SELECT * FROM edges WHERE attack_flow_count >= 3 AND (src_ip = '10.1.0.7' OR dst_ip = '10.1.0.7')"


@query(
    "f10",
    f"""WITH kept AS ({QUERY}), chosen AS (SELECT * FROM kept ORDER BY attack_flow_count DESC, src_ip, dst_ip LIMIT 25)
    SELECT {big('(SELECT count(*) FROM kept)', 'total_edge_count')}, {big('(SELECT count(*) FROM nodes)', 'total_node_count')},
      {big('(SELECT count(*) FROM chosen)', 'returned_edge_count')},
      {big('(SELECT count(*) FROM nodes WHERE ip IN (SELECT src_ip FROM chosen UNION SELECT dst_ip FROM chosen))', 'returned_node_count')},
      'neighborhood(node_ip=10.1.0.7, min_attack_flow_count=3)' AS filter_applied""",
    "edges nodes",
)
def f10(spark, sf):
    """Graph query: counts before and after the limit."""
    return plain(graph.query_graph(*both(spark, sf), limit=25, min_attack_flows=3, ip="10.1.0.7")[2])


@query("f10_rows", _chosen(f"{QUERY} ORDER BY attack_flow_count DESC, src_ip, dst_ip LIMIT 25"), "edges nodes")
def f10_rows(spark, sf):
    """Graph query: the returned edges and their nodes."""
    return _shown(graph.query_graph(*both(spark, sf), limit=25, min_attack_flows=3, ip="10.1.0.7")[:2])


def _totals(end: str) -> str:
    return f"""SELECT {end} AS ip, {big('sum(attack_flow_count)', 'attack_flow_count')}, {big('sum(flow_count)', 'total_flow_count')}
      FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


@query("f11", _totals("src_ip"), "edges")
def f11(spark, sf):
    return plain(graph.top_totals(views.edges(spark, sf), "src_ip"))


@query("f12", _totals("dst_ip"), "edges")
def f12(spark, sf):
    return plain(graph.top_totals(views.edges(spark, sf), "dst_ip"))


@query(
    "flagship",
    f"""WITH top AS ({_top('src_ip')})
    SELECT n.ip, n.total_flow_count, n.benign_flow_count, n.attack_flow_count AS node_attack_flow_count, n.attack_ratio, n.in_degree, n.out_degree,
      n.degree, n.unique_source_count, n.unique_destination_count, top.attack_flow_count FROM top JOIN nodes n ON n.ip = top.ip""",
    "edges nodes",
)
def flagship_query(spark, sf):
    from flowloom.plans.catalog import flagship

    return plain(flagship(spark, sf))
