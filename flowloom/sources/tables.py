"""Readers and writers: flow CSVs, packet records, graph snapshots, scored events."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.parsing import pack_id, unpack_id
from flowloom.schemas import EDGE_COLUMNS, NODE_COLUMNS, PACKET, REPEATED_HEADER_COLUMN
from flowloom.session import shared_dir
from flowloom.sources import snapshots

LATIN1 = "ISO-8859-1"


# --- flow CSVs ---------------------------------------------------------------
def unique_names(header: Sequence[str]) -> list[str]:
    """Stripped names; a repeated one gets ``.1``, ``.2`` as suffix."""
    seen: dict[str, int] = {}
    names = []
    for raw in header:
        name = raw.strip()
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(name if n == 0 else f"{name}.{n}")
    return names


def csv_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(source_path, source_file, block_start, line)`` of all CSV files; the text source keeps bytes as they are."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.csv")
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("value").alias("line"),
    )


def header_names(line: Column | str) -> Column:
    """A header line as raw column names; a comma or a doubled quote may stand inside quotes."""
    parts = F.split(F.regexp_replace(line, "^\ufeff", ""), r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(parts, lambda p: F.when(p.rlike(r'^\s*".*"\s*$'), F.replace(F.regexp_extract(p, r'^\s*"(.*)"\s*$', 1), F.lit('""'), F.lit('"'))).otherwise(p))


def csv_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(source_path, source_file, encoding, header)`` per file, from one scan.

    ``encoding`` is ``utf-8`` when every line decodes as such, else ``latin1``; files are
    told apart by their paths. A file without a line is not listed.
    """
    numbered = csv_lines(spark, path, recursive).withColumn("_i", F.monotonically_increasing_id())
    opens = F.col("block_start") == 0
    found = numbered.groupBy("source_path", "source_file").agg(
        F.when(F.bool_and(F.call_function("is_valid_utf8", F.col("line"))), "utf-8").otherwise("latin1").alias("encoding"),
        F.min_by("line", F.when(opens, F.col("_i"))).alias("_head"),
    )
    head = F.when(F.col("encoding") == "utf-8", F.col("_head")).otherwise(F.decode(F.col("_head").cast("binary"), LATIN1))
    return found.select("source_path", "source_file", "encoding", header_names(head).alias("header"))


def _as_utf8(cell: Column) -> Column:
    """A cell whose bytes were read as Latin-1; only cells beyond ASCII are converted."""
    wide = F.octet_length(cell) > F.char_length(cell)
    return F.when(wide, F.decode(F.encode(cell, LATIN1), "UTF-8")).otherwise(cell)


def read_flow_csvs(
    spark: SparkSession, path: str, recursive: bool = False, columns: Sequence[str] | None = None, with_path: bool = False
) -> DataFrame:
    """All flow files as text columns under stripped names, with ``source_file``.

    Each file is decoded as UTF-8 if the whole of it allows that, else as Latin-1;
    ``columns`` keeps only these names, ``with_path`` adds ``source_path``. Nothing is inferred.

    One scan makes the table of files (stored, one row per file), a second one reads
    all files alike as Latin-1, which keeps every byte. Where files differ in layout or
    encoding, rows meet their file's row by path, and the optimizer broadcasts the stored
    table while it is below its limit. Only the distinct layouts reach the driver.
    """
    stored = f"{shared_dir(spark)}/csv-files-{uuid.uuid4().hex}"
    csv_files(spark, path, recursive).write.parquet(stored)
    files = spark.read.parquet(stored)
    kinds = files.select("header", "encoding").distinct().collect()
    layouts = sorted({tuple(r["header"]) for r in kinds})
    if not layouts:
        raise FileNotFoundError(f"no CSV files under {path}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(map(len, layouts)))])
    reader = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.csv")
        .option("encoding", LATIN1)
    )
    rows = reader.csv(path).select("*", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"))
    utf8 = F.lit(kinds[0]["encoding"] == "utf-8")
    if len(kinds) > 1:
        number = F.coalesce(*[F.when(F.col("header") == F.array(*map(F.lit, h)), F.lit(i)) for i, h in enumerate(layouts)])
        rows = rows.join(files.select("source_path", "encoding", number.alias("_layout")), "source_path")
        utf8 = F.col("encoding") == "utf-8"
    places: dict[str, dict[int, int]] = {}
    for i, layout in enumerate(layouts):
        for at, name in enumerate(unique_names(layout)):
            if name != REPEATED_HEADER_COLUMN and (columns is None or name in columns):
                places.setdefault(name, {})[i] = at

    def cell(at: dict[int, int]) -> Column:
        if len(at) == len(layouts) and len(set(at.values())) == 1:
            raw = F.col(f"c{at[0]}")
        else:
            raw = F.coalesce(*[F.when(F.col("_layout") == i, F.col(f"c{k}")) for i, k in at.items()])
        return F.when(utf8, _as_utf8(raw)).otherwise(raw)

    return rows.select(*[cell(at).alias(name) for name, at in places.items()], "source_file", *(["source_path"] if with_path else []))


# --- packets -----------------------------------------------------------------
_RECORD = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        *[T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType) for f in PACKET.fields if f.name != "ts"],
        T.StructField("ip_header_length", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def parse_packet_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines to ``kind`` and packet columns; works on batch and stream.

    ``kind`` is ``packet``, ``malformed_line`` (no JSON), ``malformed_packet``
    (a required field missing), ``parse_error`` (reported by the sender) or
    ``other``. Nothing fails: bad records are kept for counting.
    """
    r = F.from_json(F.trim(line), _RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    staged = lines.filter(F.trim(line) != "").select("*", r.alias("r"))
    needed = ("timestamp", "src_ip", "dst_ip", "protocol", "total_length", "ip_header_length", "transport_header_length", "payload_length")
    complete = F.lit(True)
    for n in needed:
        complete = complete & F.col(f"r.{n}").isNotNull()
    kind = (
        F.when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "malformed_line")
        .when(F.col("r.type") == "parse_error", "parse_error")
        .when(F.coalesce(F.col("r.type"), F.lit("")) != "packet", "other")
        .when(~complete, "malformed_packet")
        .otherwise("packet")
    )
    out = staged.withColumn("kind", kind)
    return out.select(
        *[c for c in lines.columns if c != line],
        "kind",
        F.timestamp_micros(F.round(F.col("r.timestamp") * 1_000_000).cast("long")).alias("ts"),
        *[F.col(f"r.{f.name}").cast(f.dataType).alias(f.name) for f in PACKET.fields if f.name != "ts"],
    )


def packet_line_counts(parsed: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return parsed.agg(
        F.count("*").alias("lines"),
        F.count_if(kind == "packet").alias("packets_received"),
        F.count_if(kind == "malformed_line").alias("malformed_lines"),
        F.count_if(kind == "malformed_packet").alias("malformed_packets"),
        F.count_if(kind.isin("malformed_line", "malformed_packet", "parse_error")).alias("parse_errors"),
    )


def flags_from_letters(letters: Column | str) -> Column:
    """Flag letters such as ``SA`` as the boolean struct; NULL stays NULL."""
    c = F.col(letters) if isinstance(letters, str) else letters
    by_letter = {"fin": "F", "syn": "S", "rst": "R", "psh": "P", "ack": "A", "urg": "U", "ece": "E", "cwr": "C"}
    return F.when(c.isNotNull(), F.struct(*[c.contains(x).alias(n) for n, x in by_letter.items()]))


# --- sinks -------------------------------------------------------------------
def export_table(df: DataFrame, columns: Sequence[str], order: Sequence, separator: str = ";") -> DataFrame:
    """Columns in order, arrays joined, rows sorted: ready for ``write.csv``."""
    types = dict(df.dtypes)
    shown = [F.array_join(F.col(c).cast("array<string>"), separator).alias(c) if types[c].startswith("array") else F.col(c) for c in columns]
    return df.select(*shown).orderBy(*order)


def node_export(nodes: DataFrame) -> DataFrame:
    return export_table(nodes, NODE_COLUMNS, ["ip"])


def edge_export(edges: DataFrame) -> DataFrame:
    return export_table(edges, EDGE_COLUMNS, ["src_ip", "dst_ip"])


def map_to_json(df: DataFrame) -> DataFrame:
    """Map and struct columns as JSON text, for CSV sinks."""
    types = dict(df.dtypes)
    return df.select(*[F.to_json(c).alias(c) if types[c].startswith(("map", "struct")) else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_split(df: DataFrame, scaler: DataFrame, path: str) -> None:
    """Features and metadata in the same row, one folder per split, scaler beside."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").filter(F.col("split") == split)


def replace_graph(nodes: DataFrame, edges: DataFrame, path: str, version: str) -> int:
    """Replace one version of the stored graph, nodes and edges together; other versions stay. Edge count back."""
    snapshots.replace({"nodes": nodes, "edges": edges}, path, version, "graph_version")
    return read_graph(nodes.sparkSession, path, "edges", version).count()


def read_graph(spark: SparkSession, path: str, table: str, version: str | None = None) -> DataFrame:
    """``nodes`` or ``edges`` of one stored version, or of all, with ``graph_version``."""
    return snapshots.read(spark, path, table, version)


UID_PREFIX = {"offline_demo": "offline-demo-", "live": "live-", "test_event": "test-"}


def event_rows(flows: DataFrame) -> DataFrame:
    """Event rows of flows with ``event_id`` and ``source``; they hold nothing of a score."""
    prefix = F.create_map(*[F.lit(x) for pair in UID_PREFIX.items() for x in pair])
    return flows.select(
        F.col("event_id").alias("id"),
        F.concat(F.element_at(prefix, F.col("source")), F.col("event_id")).alias("event_uid"),
        F.col("ts").alias("timestamp"),
        F.col("src_ip").alias("source_ip"),
        F.col("src_port").alias("source_port"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("dst_port").alias("destination_port"),
        "protocol",
        F.col("canonical_label").alias("canonical_attack_label"),
        "traffic_class",
        "source",
        F.lit("processed").alias("status"),
        "created_at",
    )


def detection_rows(flows: DataFrame) -> DataFrame:
    """Detection rows of flows with an anomaly score; they hold nothing of a risk."""
    return flows.select(
        F.col("event_id").alias("id"), "event_id", "anomaly_score", F.col("anomaly_score").alias("reconstruction_error"),
        "is_anomaly", "threshold_used",
    )


def risk_rows(scored: DataFrame) -> DataFrame:
    return scored.select(
        F.col("event_id").alias("id"), "event_id", F.col("event_id").alias("detection_id"), "risk_score", "risk_level",
        *[c for c in ("factors", "rules_applied", "reason", "config_version") if c in scored.columns], "created_at",
    )


def scored_fan_out(scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored flows to event, detection and risk rows sharing one key.

    Needs ``event_id`` and ``source`` beside the scored columns. The key is part
    of the row, so writing again after a failure gives the same rows. Scores that were not
    explained give risk rows without the explanation.
    """
    return event_rows(scored), detection_rows(scored), risk_rows(scored)


def write_scored(scored: DataFrame, path: str, batch: str) -> None:
    """Append one batch idempotently: its folder is overwritten on a retry."""
    for name, table in zip(("events", "detections", "risk_assessments"), scored_fan_out(scored)):
        (
            table.withColumn("batch", F.lit(batch))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")  # ids are hex text, which snappy leaves as it is
            .partitionBy("batch")
            .parquet(f"{path}/{name}")
        )


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored events of the three sinks side by side, under their one key.

    Ids are shuffled as bytes, and an event's uid without the id that it ends with.
    """
    e, d, x = (spark.read.parquet(f"{path}/{t}") for t in ("events", "detections", "risk_assessments"))
    ends = F.col("event_uid").endswith(F.col("id"))
    lead = F.when(ends, F.left("event_uid", F.length("event_uid") - F.length("id")))
    e = e.select(pack_id("id").alias("_key"), lead.alias("_lead"), F.when(~ends, F.col("event_uid")).alias("_uid"))
    d = d.select(pack_id("event_id").alias("_key"), "anomaly_score", "is_anomaly")
    x = x.select(pack_id("event_id").alias("_key"), "risk_score", "risk_level")
    uid = F.coalesce("_uid", F.concat("_lead", unpack_id("_key")))
    return e.join(d, "_key").join(x, "_key").select(uid.alias("event_uid"), "anomaly_score", "is_anomaly", "risk_score", "risk_level")


def without_source(events: DataFrame, children: Sequence[DataFrame], source: str = "offline_demo") -> tuple[DataFrame, ...]:
    """Events without those of one source, and the children of what is left."""
    gone = events.filter(F.col("source") == source).select(F.col("id").alias("event_id"))
    kept = events.filter(F.col("source") != source)
    return (kept, *[c.join(gone, "event_id", "left_anti") for c in children])
