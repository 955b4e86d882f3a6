"""Spark views that map the supplied tables onto the network-flow model.

Every view is a projection of a whole table; the same definitions exist as SQL
in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.labels import canonical_label, traffic_class
from flowloom.functions.policy import response_actions
from flowloom.functions.risk import score_risk
from flowloom.operators.context import attach_context
from flowloom.operators.graph import build_edges
from flowloom.operators.runs import content_hash
from flowloom.schemas import PolicyConfig, RiskConfig, SessionLimits
from flowloom.session import tune
from flowloom.sources.tables import detection_rows, event_rows, risk_rows

THRESHOLD = 0.05
RISK = RiskConfig(anomaly_threshold=THRESHOLD, attack_activity_scale=10.0, temporal_scale_hours=40_000.0)
POLICY = PolicyConfig(alert_threshold=4.0, block_threshold=6.0, lab_cidrs="10.0.0.0/27,192.168.56.0/24")  # suppliers below 32
# Events of one client are hours apart, so the close rules are stretched.
LIMITS = SessionLimits(idle_seconds=86_400.0, max_duration_seconds=129_600.0, max_packets=6)
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def row_uid() -> Column:
    """Unique id of a lineitem row, for tables that need a key."""
    return F.md5(
        F.concat_ws(
            "|",
            *[_text(F.col(c)) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
            _text(F.round(F.col("l_extendedprice") * 100).cast("long")),
            _text(F.col("l_quantity").cast("long")),
            F.date_format("l_shipdate", "yyyy-MM-dd"),
        )
    )


def raw_label() -> Column:
    n = F.col("l_linenumber")
    attack = (
        F.when(n == 1, "DDoS").when(n == 2, "PortScan").when(n == 3, "Bot").when(n == 4, "Web Attack � XSS").otherwise("DoS Hulk")
    )
    return F.when(F.col("l_returnflag") == "R", attack).otherwise("BENIGN")


def source_ip() -> Column:
    s = F.col("l_suppkey")
    return F.concat(F.lit("10.0."), _text(F.floor(s / 256).cast("long")), F.lit("."), _text(s % 256))


def destination_ip() -> Column:
    return F.concat(F.lit("10.1.0."), _text(F.col("l_partkey") % 50))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The FLOW schema over lineitem, with the raw columns and a row id."""
    return flows_from(table(spark, sf_dir, "lineitem"))


def flows_from(lineitem: DataFrame) -> DataFrame:
    base = lineitem.select(
        "*",
        source_ip().alias("src_ip"),
        (F.lit(1024) + F.col("l_orderkey") % 64000).cast("int").alias("src_port"),
        destination_ip().alias("dst_ip"),
        (F.lit(20) + F.col("l_linenumber")).cast("int").alias("dst_port"),
        F.when(F.col("l_linestatus") == "O", 6).otherwise(17).alias("protocol"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("fwd_bytes"),
        F.col("l_extendedprice").alias("bwd_bytes"),
        raw_label().alias("original_label"),
        F.concat(F.lit("capture_"), _text(F.col("l_linenumber") % 3), F.lit(".csv")).alias("source_file"),
        (F.col("l_discount") * F.col("l_quantity") / 50.0).alias("anomaly_score"),
        row_uid().alias("event_id"),
    )
    labelled = base.withColumn("canonical_label", canonical_label("original_label"))
    return labelled.withColumn("traffic_class", traffic_class("canonical_label"))


def raw_flows(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """Flows as raw text rows with faults: bad addresses, ports, times, bytes, blank rows.

    ``more`` are further text columns of the same rows; blank rows have none.
    """
    f = flows(spark, sf_dir)
    k = F.col("l_orderkey")
    broken = f.select(
        F.col("event_id").alias("Flow ID"),
        F.when(k % 97 == 0, "10.0.300.1")
        .when(k % 73 == 0, F.concat(F.lit("fd00::"), _text(F.col("l_suppkey") % 10)))
        .otherwise(F.col("src_ip"))
        .alias("Source IP"),
        F.when(k % 89 == 0, "70000").otherwise(_text(F.col("src_port"))).alias("Source Port"),
        F.col("dst_ip").alias("Destination IP"),
        _text(F.col("dst_port")).alias("Destination Port"),
        _text(F.col("protocol")).alias("Protocol"),
        F.when(k % 83 == 0, "not-a-time").otherwise(F.date_format("ts", "d/M/yyyy H:mm:ss")).alias("Timestamp"),
        F.when(k % 79 == 0, "n/a").otherwise(_text(F.col("fwd_bytes").cast("long"))).alias("Total Length of Fwd Packets"),
        _text(F.col("bwd_bytes").cast("long")).alias("Total Length of Bwd Packets"),
        F.col("original_label").alias("Label"),
        *[c.alias(n) for n, c in more.items()],
        "source_file",
    )
    blank = f.filter(k % 101 == 0).select(
        *[F.lit(None).cast("string").alias(c) for c in broken.columns if c != "source_file"], "source_file"
    )
    return broken.unionByName(blank)


def statistics_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric flow columns with duplicates across files and a few Inf and NaN."""
    f = flows(spark, sf_dir)
    k = F.col("l_orderkey")
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "canonical_label", "source_file"]
    again = f.filter(k % 50 == 0).select(*cols[:-1], F.lit("recapture.csv").alias("source_file"))
    both = f.select(*cols).unionByName(again)
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    return both.withColumns(
        {
            "Flow Bytes/s": F.when(k % 311 == 0, float("inf")).when(k % 457 == 0, float("nan")).otherwise(rate),
            "Flow Packets/s": F.when(k % 613 == 0, float("-inf")).otherwise(F.col("l_quantity") * 2.0),
        }
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets between clients (``user_id``) and one server over the events table."""
    return packets_from(table(spark, sf_dir, "events"))


def packets_from(e: DataFrame) -> DataFrame:
    u, n = F.col("user_id"), F.col("event_id")
    client = F.concat(F.lit("172.16."), _text(F.floor(u / 256).cast("long")), F.lit("."), _text(u % 256))
    client_port = (F.lit(40000) + u % 20000).cast("int")
    out = n % 2 == 0
    kind = F.col("event_type")
    flags = F.struct(
        (kind == "purchase").alias("fin"),
        (kind == "signup").alias("syn"),
        (kind == "error").alias("rst"),
        (kind == "view").alias("psh"),
        kind.isin("click", "view").alias("ack"),
        F.lit(False).alias("urg"),
        F.lit(False).alias("ece"),
        F.lit(False).alias("cwr"),
    )
    length = F.col("value").cast("int")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(out, client).otherwise("192.168.10.50").alias("src_ip"),
        F.when(out, F.lit("192.168.10.50")).otherwise(client).alias("dst_ip"),
        F.when(out, client_port).otherwise(443).alias("src_port"),
        F.when(out, F.lit(443)).otherwise(client_port).alias("dst_port"),
        F.lit(6).alias("protocol"),
        length.alias("total_length"),
        (F.lit(20) + (n % 4) * 4).cast("int").alias("transport_header_length"),
        F.greatest(F.lit(0), length - 20).alias("payload_length"),
        flags.alias("tcp_flags"),
        F.when(n % 5 != 0, (n % 65536).cast("int")).alias("tcp_window"),
        n.alias("seq"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_edges(flows(spark, sf_dir))


def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thin graph of all line items with many components: orders around the first of their eight.

    Some items tie their eight to the next, which makes chains of chance length.
    """
    order = F.col("l_orderkey")
    first = order - order % 8
    tied = (F.col("l_linenumber") == 4) & (F.col("l_partkey") % 8 == 0)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), _text(order)).alias("src_ip"), F.concat(F.lit("o"), _text(F.when(tied, first + 8).otherwise(first))).alias("dst_ip")
    ).distinct()


def tagged(flows: DataFrame) -> DataFrame:
    """Flows as events before a risk is known: anomaly flag, source and ingestion time added."""
    n = F.col("l_linenumber") % 3
    return flows.withColumns(
        {
            "is_anomaly": F.col("anomaly_score") >= THRESHOLD,
            "threshold_used": F.lit(THRESHOLD),
            "source": F.when(n == 0, "live").when(n == 1, "offline_demo").otherwise("test_event"),
            "created_at": F.col("ts") + F.make_dt_interval(mins=F.col("l_linenumber")),
        }
    )


def scored(spark: SparkSession, sf_dir: str, explained: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Risk-scored flows as events: id, source and ingestion time added. ``known`` are edges written before."""
    f = flows(spark, sf_dir)
    return attach_context(tagged(f), build_edges(f) if known is None else known).transform(score_risk(RISK, explained=explained))


#: What events, detections, risks and actions hold of a scored flow, without the explanation; the line number says which rows exist.
EVENT_COLUMNS = (
    "event_id", "source", "ts", "created_at", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "canonical_label", "traffic_class",
    "anomaly_score", "is_anomaly", "threshold_used", "risk_score", "risk_level", "rules_applied", "l_linenumber",
)


def relational(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, detections, risks); some events lack the latter two. ``known`` are scored flows written before.

    Only risks need the edges: events and detections are made where the flows lie.
    """
    s = scored(spark, sf_dir) if known is None else known
    seen = tagged(flows(spark, sf_dir)) if known is None else known
    return event_rows(seen), detection_rows(seen.filter("l_linenumber <> 7")), risk_rows(s.filter("l_linenumber < 6"))


def actions(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Response audit rows of all scored events."""
    s = scored(spark, sf_dir, explained=False) if known is None else known
    return response_actions(s.withColumnRenamed("src_ip", "source_ip"), POLICY).withColumn("id", F.col("event_id"))


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model run records over orders: two components, changing artefacts."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_custkey") % 2 == 0, "autoencoder").otherwise("knn").alias("component"),
        content_hash("o_orderstatus", "o_orderpriority").alias("content_hash"),
        (F.col("o_totalprice") / 1e6).alias("f1"),
        F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")).alias("metrics"),
        F.col("o_orderdate").alias("created_at"),
    )


def agent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations (sign-ups) and heartbeats of agents over the events table."""
    e = table(spark, sf_dir, "events")
    n, register = F.col("event_id"), F.col("event_type") == "signup"
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("agent-"), _text(F.col("user_id"))).alias("agent_id"),
        "ts",
        F.when(register, F.concat(F.lit("host-"), _text(n % 7))).alias("hostname"),
        F.when(register | (n % 3 == 0), F.concat(F.lit("10.9.0."), _text(n % 200))).when(n % 3 == 1, "").alias("ip_address"),
        F.when(register, F.concat(F.lit("1."), _text(n % 4))).alias("agent_version"),
    )


def telemetry_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection batches over the events table: none to three connections each."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    states = F.array(*[F.lit(s) for s in ("established", "LISTEN", "TIME_WAIT", "BOGUS", None)])

    def connection(i: Column) -> Column:
        k = n + i
        return F.struct(
            F.when(k % 11 == 0, "300.1.1.1").otherwise(F.concat(F.lit("10.9.0."), _text(k % 200))).alias("local_ip"),
            F.when(k % 13 == 0, 70000).otherwise((k % 60000).cast("int")).alias("local_port"),
            F.when(k % 4 != 0, F.concat(F.lit("10.8.0."), _text(k % 250))).alias("remote_ip"),
            F.when(k % 4 != 0, (k % 50000).cast("int")).alias("remote_port"),
            F.when(k % 17 == 0, "SCTP").when(k % 2 == 0, "TCP").otherwise("UDP").alias("protocol"),
            F.element_at(states, (k % 5 + 1).cast("int")).alias("status"),
        )

    few = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n % 4)), lambda i: connection(i))
    connections = F.when(n % 4 == 0, F.slice(few, 1, 0)).otherwise(few)
    return e.select(
        F.concat(F.lit("agent-"), _text(F.col("user_id"))).alias("agent_id"),
        F.col("ts").alias("collected_at"),
        F.concat(F.lit("host-"), _text(n % 7)).alias("hostname"),
        connections.alias("connections"),
        n.alias("id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, queries) of embeddings, class 1 for labels from 5 on."""
    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))
    return e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0")


# --- presentation shared by all registered queries ---------------------------
def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: doubles rounded, times and arrays as text, integers long."""
    shown = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind.startswith("array<") and "struct" not in kind:
            c = F.array_join(c.cast("array<string>"), ",")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        shown.append(c.alias(name))
    return df.select(*shown)
