"""Fixed values, table schemas and configuration records."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

# --- fixed values ------------------------------------------------------------
BENIGN = "BENIGN"
ATTACK = "ATTACK"

CLEAN_LABELS = (
    "BENIGN",
    "DDoS",
    "PortScan",
    "Bot",
    "Infiltration",
    "FTP-Patator",
    "SSH-Patator",
    "DoS Hulk",
    "DoS GoldenEye",
    "DoS slowloris",
    "DoS Slowhttptest",
    "Heartbleed",
)
REPLACEMENT_CHAR_LABELS = {
    "Web Attack � Brute Force": "Web Attack - Brute Force",
    "Web Attack � XSS": "Web Attack - XSS",
    "Web Attack � Sql Injection": "Web Attack - Sql Injection",
}
CONTROL_CHAR_LABELS = {
    "Web Attack \x96 Brute Force": "Web Attack - Brute Force",
    "Web Attack \x96 Sql Injection": "Web Attack - Sql Injection",
    "Web Attack \x96 XSS": "Web Attack - XSS",
}
CANONICAL_LABELS = CLEAN_LABELS + tuple(REPLACEMENT_CHAR_LABELS.values())

TOPOLOGY_COLUMNS = (
    "Flow ID",
    "Source IP",
    "Source Port",
    "Destination IP",
    "Destination Port",
    "Protocol",
    "Timestamp",
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
    "Label",
)
REQUIRED_TOPOLOGY_FIELDS = (
    "Flow ID",
    "Source IP",
    "Source Port",
    "Destination IP",
    "Destination Port",
    "Protocol",
    "Timestamp",
    "Label",
)
PLAUSIBLE_PROTOCOLS = (0, 1, 2, 6, 17, 41, 47, 50, 51, 58, 132)
LABEL_NAME_HINTS = ("label", "class", "attack")
REPEATED_HEADER_COLUMN = "Fwd Header Length.1"
INF_PRONE_COLUMNS = ("Flow Bytes/s", "Flow Packets/s")
METADATA_ONLY_COLUMNS = ("Label", "canonical_label", "source_file")
STRUCTURALLY_REDUNDANT_COLUMNS = ("Subflow Fwd Packets", "Subflow Bwd Packets")
INF_DROP_LIMIT = 0.01

IANA_PROTOCOL_NAMES = {
    1: "ICMP",
    2: "IGMP",
    6: "TCP",
    17: "UDP",
    41: "IPv6-ENCAP",
    47: "GRE",
    50: "ESP",
    51: "AH",
    58: "ICMPv6",
    89: "OSPF",
    132: "SCTP",
}
NAMED_PROTOCOL_NUMBERS = {"TCP": 6, "UDP": 17, "ICMP": 1}

CONNECTION_STATES = (
    "ESTABLISHED",
    "SYN_SENT",
    "SYN_RECV",
    "FIN_WAIT1",
    "FIN_WAIT2",
    "TIME_WAIT",
    "CLOSE",
    "CLOSE_WAIT",
    "LAST_ACK",
    "LISTEN",
    "CLOSING",
    "NONE",
)

FLOW_FEATURES = (
    "Destination Port",
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
    "Fwd Packet Length Max",
    "Fwd Packet Length Min",
    "Fwd Packet Length Mean",
    "Fwd Packet Length Std",
    "Bwd Packet Length Max",
    "Bwd Packet Length Min",
    "Bwd Packet Length Mean",
    "Bwd Packet Length Std",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Flow IAT Mean",
    "Flow IAT Std",
    "Flow IAT Max",
    "Flow IAT Min",
    "Fwd IAT Total",
    "Fwd IAT Mean",
    "Fwd IAT Std",
    "Fwd IAT Max",
    "Fwd IAT Min",
    "Bwd IAT Total",
    "Bwd IAT Mean",
    "Bwd IAT Std",
    "Bwd IAT Max",
    "Bwd IAT Min",
    "Fwd PSH Flags",
    "Fwd URG Flags",
    "Fwd Header Length",
    "Bwd Header Length",
    "Fwd Packets/s",
    "Bwd Packets/s",
    "Min Packet Length",
    "Max Packet Length",
    "Packet Length Mean",
    "Packet Length Std",
    "Packet Length Variance",
    "FIN Flag Count",
    "SYN Flag Count",
    "RST Flag Count",
    "PSH Flag Count",
    "ACK Flag Count",
    "URG Flag Count",
    "CWE Flag Count",
    "ECE Flag Count",
    "Down/Up Ratio",
    "Average Packet Size",
    "Avg Fwd Segment Size",
    "Avg Bwd Segment Size",
    "Subflow Fwd Bytes",
    "Subflow Bwd Bytes",
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
    "act_data_pkt_fwd",
    "min_seg_size_forward",
    "Active Mean",
    "Active Std",
    "Active Max",
    "Active Min",
    "Idle Mean",
    "Idle Std",
    "Idle Max",
    "Idle Min",
)
# Features whose formula is an approximation of the original exporter's.
APPROXIMATED_FEATURES = (
    "CWE Flag Count",
    "Subflow Fwd Bytes",
    "Subflow Bwd Bytes",
    "min_seg_size_forward",
    "Active Mean",
    "Active Std",
    "Active Max",
    "Active Min",
    "Idle Mean",
    "Idle Std",
    "Idle Max",
    "Idle Min",
)
# Features that may be -1, else an integer port or window size.
SENTINEL_FEATURES = ("Destination Port", "Init_Win_bytes_forward", "Init_Win_bytes_backward")

RISK_WEIGHTS = {
    "anomaly_severity": 0.40,
    "edge_attack_ratio": 0.25,
    "attack_activity": 0.15,
    "temporal_persistence": 0.10,
    "attack_context": 0.10,
}
RISK_LEVELS = ((2.0, "Very Low"), (4.0, "Low"), (6.0, "Moderate"), (8.0, "High"))
TOP_RISK_LEVEL = "Critical"
HIGH_RISK_SCORE = 7.0
FACTOR_WORDING = {
    "anomaly_severity": "anomaly deviation",
    "edge_attack_ratio": "attack-heavy communication",
    "attack_activity": "attack traffic volume",
    "temporal_persistence": "sustained activity over time",
    "attack_context": "history of diverse attack categories on this edge",
}
RULE_WORDING = {
    "repeated_attack_heavy_communication": "repeated attack-heavy communication",
    "very_high_anomaly": "an extreme anomaly deviation",
    "isolated_low_volume_weak_evidence": "isolated low-volume evidence (risk reduced)",
}
NO_FACTOR_WORDING = "No significant risk factors observed"
EVENT_SOURCES = ("offline_demo", "test_event", "live")
# --- end of fixed values -----------------------------------------------------


@dataclass(frozen=True)
class RiskConfig:
    """Weights, normalisation scales and rule thresholds of the risk score."""

    version: str = "risk-engine-v1"
    weights: dict[str, float] = field(default_factory=lambda: dict(RISK_WEIGHTS))
    anomaly_threshold: float = 0.106125
    attack_activity_scale: float = 100.0
    temporal_scale_hours: float = 96.0
    attack_label_cap: int = 3
    repeated_attack_edge_ratio: float = 0.7
    repeated_attack_min_flows: int = 10
    repeated_attack_bonus: float = 0.5
    high_anomaly_severity: float = 0.9
    high_anomaly_bonus: float = 0.5
    isolated_max_attack_flows: int = 1
    isolated_max_total_flows: int = 2
    isolated_max_anomaly_severity: float = 0.5
    isolated_penalty: float = 0.5

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1.0) > 1e-6:
            raise ValueError(f"risk weights must sum to 1, got {sum(self.weights.values())}")
        for name in ("anomaly_threshold", "attack_activity_scale", "temporal_scale_hours", "attack_label_cap"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class PolicyConfig:
    """Response thresholds on the 1-10 scale and the allowed target ranges."""

    alert_threshold: float = 7.0
    block_threshold: float = 9.0
    enabled: bool = True
    dry_run: bool = True
    lab_cidrs: str = "192.168.56.0/24"
    allow_loopback: bool = False
    adapter: str = "lab"

    def __post_init__(self) -> None:
        for value in (self.alert_threshold, self.block_threshold):
            if not 1.0 <= value <= 10.0:
                raise ValueError(f"threshold {value} is outside the 1-10 scale")
        if self.block_threshold < self.alert_threshold:
            raise ValueError("block_threshold must not be below alert_threshold")


@dataclass(frozen=True)
class SessionLimits:
    """Close rules of the flow sessionizer, in seconds and packets."""

    idle_seconds: float = 30.0
    max_duration_seconds: float = 300.0
    max_packets: int = 200_000


TCP_FLAG_NAMES = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")
TCP_FLAGS = T.StructType([T.StructField(n, T.BooleanType()) for n in TCP_FLAG_NAMES])

PACKET = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("total_length", T.IntegerType()),
        T.StructField("transport_header_length", T.IntegerType()),
        T.StructField("payload_length", T.IntegerType()),
        T.StructField("tcp_flags", TCP_FLAGS),
        T.StructField("tcp_window", T.IntegerType()),
    ]
)

EDGE_COLUMNS = (
    "src_ip",
    "dst_ip",
    "flow_count",
    "benign_flow_count",
    "attack_flow_count",
    "attack_ratio",
    "unique_source_ports",
    "unique_destination_ports",
    "protocols_seen",
    "first_seen",
    "last_seen",
    "total_forward_bytes",
    "total_backward_bytes",
    "attack_labels",
)
NODE_COLUMNS = (
    "ip",
    "total_flow_count",
    "benign_flow_count",
    "attack_flow_count",
    "attack_ratio",
    "in_degree",
    "out_degree",
    "degree",
    "unique_source_count",
    "unique_destination_count",
)
