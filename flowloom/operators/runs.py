"""Run logs, agents and response state: folds over ordered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.ordered import id_chunk, previous_value, running_before

ONLINE_SECONDS = 45


def content_hash(*columns: str) -> Column:
    """sha256 over the serialized artefact columns in a fixed order, NULL if one is missing."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return F.when(~missing, F.sha2(F.concat(*[F.col(c).cast("string") for c in columns]), 256))


def changed_runs(runs: DataFrame, component: str = "component", order: str = "id", hash_column: str = "content_hash") -> DataFrame:
    """Append-only log: rows whose content differs from the run before.

    Rows without a hash (nothing trained yet) are no runs.
    """
    known = runs.filter(F.col(hash_column).isNotNull())
    seen = previous_value(known, [component], [order], id_chunk(order), {"_before": hash_column})
    return seen.filter(~F.col(hash_column).eqNullSafe(F.col("_before"))).drop("_before")


def run_trend(log: DataFrame, component: str = "component", order: str = "id", least: int = 2) -> DataFrame:
    """Run index per component, oldest first, for components with several runs."""
    ranked = running_before(log, [component], [order], id_chunk(order), {"_ahead": ("count", None)}, totals={"_runs": "_ahead"})
    return ranked.filter(F.col("_runs") >= least).withColumn("run_index", F.col("_ahead") + 1).drop("_ahead", "_runs")


def training_history(log: DataFrame, component: str | None = None, limit: int = 50) -> DataFrame:
    kept = log if component is None else log.filter(F.col("component") == component)
    return kept.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def latest_agents(messages: DataFrame, agent: str = "agent_id", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """State per agent after all messages; NULL or empty fields overwrite nothing.

    Every field is a ``max_by`` over its non-empty values, so an agent with very
    many heartbeats is reduced on the map side.
    """
    when = F.struct(*order)

    def newest(column: str) -> Column:
        filled = F.when(F.col(column) != "", when)
        return F.max_by(column, filled).alias(column)

    return messages.groupBy(agent).agg(
        newest("hostname"), newest("ip_address"), newest("agent_version"), F.max(order[0]).alias("last_seen"), F.count("*").alias("messages")
    )


def is_online(last_seen: Column | str, as_of: Column, seconds: int = ONLINE_SECONDS) -> Column:
    seen = F.col(last_seen) if isinstance(last_seen, str) else last_seen
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(seen.cast("timestamp"))
    return F.coalesce(age <= seconds * 1_000_000, F.lit(False))


def currently_blocked(actions: DataFrame) -> DataFrame:
    """Sources whose last block or unblock was a block."""
    decisive = actions.filter(F.col("actual_action").isin("blocked", "unblocked"))
    last = decisive.groupBy("source_ip").agg(F.max_by("actual_action", F.struct("created_at", "id")).alias("state"))
    return last.filter(F.col("state") == "blocked").select("source_ip")
