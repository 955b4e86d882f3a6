"""Session settings every job relies on."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Only settings that may change on a live session; cluster sizing (executors,
# memory, shuffle service) stays with the deployment.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even where the split costs an extra exchange:
    # one edge of a flow table may hold a third of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def stream_partitions(spark: SparkSession, per_core: int = 2) -> Iterator[None]:
    """Streams started inside have ``per_core`` state partitions a core, and never more than the session's.

    A micro-batch opens a state store and Python workers for each of its partitions, whatever it holds, and
    adaptive execution does not join small ones in a stream. A stream takes the settings it is started with.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), per_core * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def _with_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """What is run inside leaves no shuffle files: for tables that are written and then only read back.

    Otherwise they stay on disk until the driver happens to collect its garbage. A stream takes the
    settings it is started with.
    """
    return _with_setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def joined_where_they_lie(spark: SparkSession):
    """Rows dealt by some of a join's keys are not dealt again by all of them.

    For steps that go from key to finer key, and whose hot keys are bounded otherwise.
    """
    return _with_setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def local_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and cut points.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local (tests, bench) is a temporary folder made.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="flowloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, inside the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark) + "/lineage")
