"""Edge and node tables of the communication graph, and their analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.labels import attack_label_bit, labels_from_bits
from flowloom.schemas import BENIGN

_PROTOCOL_WORDS = 4  # 4 x 64 bits hold protocol numbers 0..255


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.round(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), 6), F.lit(0.0))


def _protocols(words: list[Column]) -> Column:
    """Sorted protocol numbers behind the bit words, in one step per number that is set."""

    def numbers(word: Column, base: int) -> Column:
        def step(s: Column, _: Column) -> Column:
            rest = s["rest"]
            less = F.coalesce(F.try_subtract(rest, F.lit(1)), F.lit(2**63 - 1))  # bit 63 alone is the smallest long
            lowest = F.bit_count(rest.bitwiseXOR(less)) - 1 + base
            return F.struct(rest.bitwiseAND(less).alias("rest"), F.array_append(s["found"], lowest).alias("found"))

        none = F.array().cast("array<int>")
        start = F.struct(word.alias("rest"), none.alias("found"))
        return F.when(word != 0, F.reduce(F.sequence(F.lit(1), F.bit_count(word)), start, step, lambda s: s["found"])).otherwise(none)

    return F.concat(*[numbers(w, 64 * i) for i, w in enumerate(words)])


def build_edges(flows: DataFrame, keys: tuple = ("src_ip", "dst_ip")) -> DataFrame:
    """One row per (source, destination); extra keys (a window) may be added.

    Ports and protocols are sets of bounded size (at most 65,536 ports), so every task
    sends one partial row per edge: the flows are shuffled once and none is multiplied,
    and even an edge holding a third of all flows is merged from as many rows as there are tasks.
    """
    attack = F.col("canonical_label") != BENIGN
    words = [
        F.bit_or(F.when(F.floor(F.col("protocol") / 64) == w, F.expr("shiftleft(1L, protocol % 64)")).otherwise(F.lit(0).cast("long")))
        for w in range(_PROTOCOL_WORDS)
    ]
    grouped = flows.groupBy(*keys).agg(
        F.count("*").alias("flow_count"),
        F.count_if(~attack).alias("benign_flow_count"),
        F.count_if(attack).alias("attack_flow_count"),
        F.size(F.collect_set("src_port")).cast("long").alias("unique_source_ports"),
        F.size(F.collect_set("dst_port")).cast("long").alias("unique_destination_ports"),
        *[w.alias(f"_p{i}") for i, w in enumerate(words)],
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.sum(F.col("fwd_bytes").cast("long")).alias("total_forward_bytes"),
        F.sum(F.col("bwd_bytes").cast("long")).alias("total_backward_bytes"),
        F.bit_or(attack_label_bit("canonical_label")).alias("_labels"),
    )
    names = [k if isinstance(k, str) else "window" for k in keys]
    return grouped.select(
        *names,
        "flow_count",
        "benign_flow_count",
        "attack_flow_count",
        _ratio("attack_flow_count", "flow_count").alias("attack_ratio"),
        "unique_source_ports",
        "unique_destination_ports",
        _protocols([F.col(f"_p{i}") for i in range(_PROTOCOL_WORDS)]).alias("protocols_seen"),
        "first_seen",
        "last_seen",
        "total_forward_bytes",
        "total_backward_bytes",
        labels_from_bits(F.col("_labels")).alias("attack_labels"),
    )


def hourly_edges(flows: DataFrame, hours: int = 1) -> DataFrame:
    """Edge tables of all consecutive half-open hourly windows in one pass."""
    sliced = flows.withColumn("window_start", F.window("ts", f"{hours} hours")["start"])
    return build_edges(sliced, ("window_start", "src_ip", "dst_ip"))


def window_edges(flows: DataFrame, start: str, end: str, hours: int = 1) -> DataFrame:
    """As ``hourly_edges`` but counted from ``start``, the last window clipped at ``end``."""
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    step = F.expr(f"INTERVAL {hours} HOURS")
    index = F.floor(F.timestamp_diff("SECOND", low, F.col("ts")) / (3600 * hours))
    kept = flows.filter((F.col("ts") >= low) & (F.col("ts") < high))
    edges = build_edges(kept.withColumn("window_index", index), ("window_index", "src_ip", "dst_ip"))
    opened = F.timestamp_add("HOUR", (F.col("window_index") * hours).cast("int"), low)
    return edges.withColumns({"window_start": opened, "window_end": F.least(opened + step, high)}).drop("window_index")


def edge_ends(edges: DataFrame, *measures: str) -> DataFrame:
    """Every edge twice, once per end: ``ip``, ``is_source`` and the measures."""
    ends = F.array(
        F.struct(F.col("src_ip").alias("ip"), F.lit(1).alias("is_source")),
        F.struct(F.col("dst_ip").alias("ip"), F.lit(0).alias("is_source")),
    )
    return edges.select(F.explode(ends).alias("end"), *measures).select("end.ip", "end.is_source", *measures)


def build_nodes(edges: DataFrame) -> DataFrame:
    """Node totals and degrees in one aggregate over both ends of every edge.

    A self-loop counts twice. Since edges are unique per pair, the degrees are
    also the numbers of distinct sources and destinations.
    """
    ends = edge_ends(edges, "flow_count", "benign_flow_count", "attack_flow_count")
    nodes = ends.groupBy("ip").agg(
        F.sum("flow_count").alias("total_flow_count"),
        F.sum("benign_flow_count").alias("benign_flow_count"),
        F.sum("attack_flow_count").alias("attack_flow_count"),
        F.count_if(F.col("is_source") == 0).alias("in_degree"),
        F.count_if(F.col("is_source") == 1).alias("out_degree"),
    )
    return nodes.select(
        "ip",
        "total_flow_count",
        "benign_flow_count",
        "attack_flow_count",
        _ratio("attack_flow_count", "total_flow_count").alias("attack_ratio"),
        "in_degree",
        "out_degree",
        (F.col("in_degree") + F.col("out_degree")).alias("degree"),
        F.col("in_degree").alias("unique_source_count"),
        F.col("out_degree").alias("unique_destination_count"),
    )


def annotate_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees for a given node table; nodes without edges get 0."""
    degrees = edge_ends(edges).groupBy("ip").agg(
        F.count_if(F.col("is_source") == 0).alias("in_degree"), F.count_if(F.col("is_source") == 1).alias("out_degree")
    )
    base = nodes.drop("in_degree", "out_degree", "degree", "unique_source_count", "unique_destination_count")
    joined = base.join(degrees, "ip", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree")})
    return filled.withColumns(
        {
            "degree": F.col("in_degree") + F.col("out_degree"),
            "unique_source_count": F.col("in_degree"),
            "unique_destination_count": F.col("out_degree"),
        }
    )


def summarize(nodes: DataFrame, edges: DataFrame, component_sizes: DataFrame, top: int = 10) -> DataFrame:
    """One row of graph totals; ``component_sizes`` holds one size per component."""
    counted = nodes.agg(F.count("*").alias("n")).scalar()
    largest = component_sizes.orderBy(F.desc("size")).limit(top).agg(
        F.sort_array(F.collect_list("size"), asc=False).alias("s")
    )
    e = edges.agg(
        F.count("*").alias("edge_count"),
        F.coalesce(F.sum("flow_count"), F.lit(0)).alias("total_flows"),
        F.coalesce(F.sum("benign_flow_count"), F.lit(0)).alias("benign_flows"),
        F.coalesce(F.sum("attack_flow_count"), F.lit(0)).alias("attack_flows"),
    ).withColumn("node_count", counted)
    average = F.coalesce(F.round(F.try_divide(F.col("edge_count").cast("double"), F.col("node_count").cast("double")), 4), F.lit(0.0))
    return e.select(
        "node_count",
        "edge_count",
        "total_flows",
        "benign_flows",
        "attack_flows",
        _ratio("attack_flows", "total_flows").alias("attack_flow_ratio"),
        average.alias("avg_in_degree"),
        average.alias("avg_out_degree"),
        component_sizes.agg(F.count("*")).scalar().alias("component_count"),
        F.coalesce(component_sizes.agg(F.max("size")).scalar(), F.lit(0)).alias("largest_component"),
        largest.scalar().alias("component_sizes_top"),
    )


def attack_type_distribution(edges: DataFrame) -> DataFrame:
    """Distinct edges per attack label, most first."""
    return (
        edges.select(F.explode("attack_labels").alias("label"))
        .groupBy("label")
        .agg(F.count("*").alias("edge_count"))
        .orderBy(F.desc("edge_count"), "label")
    )


def attack_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("attack_flow_count") > 0).select("ip")


def high_activity_nodes(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.orderBy(F.desc("total_flow_count"), "ip").limit(n)


def top_by_attack(edges: DataFrame, end: str, n: int = 10) -> DataFrame:
    """Top sources (``end='src_ip'``) or destinations by summed attack flows above 0."""
    sums = edges.groupBy(F.col(end).alias("ip")).agg(F.sum("attack_flow_count").alias("attack_flow_count"))
    return sums.filter(F.col("attack_flow_count") > 0).orderBy(F.desc("attack_flow_count"), "ip").limit(n)


def top_totals(edges: DataFrame, end: str, n: int | None = 10) -> DataFrame:
    """Ends by attack flows with their total flows; zeros are kept."""
    sums = edges.groupBy(F.col(end).alias("ip")).agg(
        F.sum("attack_flow_count").alias("attack_flow_count"), F.sum("flow_count").alias("total_flow_count")
    )
    return sums if n is None else sums.orderBy(F.desc("attack_flow_count"), "ip").limit(n)


def widest_sources(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.select("ip", "unique_destination_count").orderBy(F.desc("unique_destination_count"), "ip").limit(n)


def high_ratio_edges(edges: DataFrame, min_flows: int = 5, n: int = 10) -> DataFrame:
    kept = edges.filter((F.col("flow_count") >= min_flows) & (F.col("attack_ratio") > 0))
    return kept.orderBy(F.desc("attack_ratio"), "src_ip", "dst_ip").limit(n)


# --- subgraphs: each selection gives (nodes, edges) --------------------------
def touched_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at either end of the given edges."""
    return nodes.join(edge_ends(edges).select("ip").distinct(), "ip", "left_semi")


def top_attack_edges(nodes: DataFrame, edges: DataFrame, n: int = 30) -> tuple[DataFrame, DataFrame]:
    order = (F.desc("attack_flow_count"), F.desc("attack_ratio"), "src_ip", "dst_ip")
    chosen = edges.filter(F.col("attack_flow_count") > 0).orderBy(*order).limit(n)
    return touched_nodes(nodes, chosen), chosen


def min_attack_threshold(nodes: DataFrame, edges: DataFrame, min_attack_flows: int = 1) -> tuple[DataFrame, DataFrame]:
    chosen = edges.filter(F.col("attack_flow_count") >= min_attack_flows)
    return touched_nodes(nodes, chosen), chosen


def neighborhood(nodes: DataFrame, edges: DataFrame, ip: str, max_edges: int = 50) -> tuple[DataFrame, DataFrame]:
    around = edges.filter((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    chosen = around.orderBy(F.desc("flow_count"), "src_ip", "dst_ip").limit(max_edges)
    return touched_nodes(nodes, chosen), chosen


SUBGRAPHS = {
    "top_attack_edges": top_attack_edges,
    "min_attack_threshold": min_attack_threshold,
    "neighborhood": neighborhood,
}


def select_subgraph(nodes: DataFrame, edges: DataFrame, strategy: str = "top_attack_edges", **options):
    if strategy not in SUBGRAPHS:
        raise ValueError(f"unknown strategy {strategy!r}, choose from {sorted(SUBGRAPHS)}")
    return SUBGRAPHS[strategy](nodes, edges, **options)


def query_graph(
    nodes: DataFrame, edges: DataFrame, limit: int = 50, min_attack_flows: int = 0, ip: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges by attack flows with their nodes, and one row of counts before the limit."""
    kept = edges.filter(F.col("attack_flow_count") >= min_attack_flows)
    note = f"top_by_attack_flow_count(min_attack_flow_count={min_attack_flows})"
    if ip:
        kept = kept.filter((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
        note = f"neighborhood(node_ip={ip}, min_attack_flow_count={min_attack_flows})"
    chosen = kept.orderBy(F.desc("attack_flow_count"), "src_ip", "dst_ip").limit(limit)
    touched = touched_nodes(nodes, chosen)
    counts = kept.agg(F.count("*").alias("total_edge_count")).select(
        "total_edge_count",
        nodes.agg(F.count("*")).scalar().alias("total_node_count"),
        chosen.agg(F.count("*")).scalar().alias("returned_edge_count"),
        touched.agg(F.count("*")).scalar().alias("returned_node_count"),
        F.lit(note).alias("filter_applied"),
    )
    return touched, chosen, counts
