"""Exact k-nearest-neighbour classification against all labelled rows.

A matrix of labelled rows of up to ``max_matrix_bytes`` is shipped to every task, and queries are
mapped batch by batch where they lie. A larger table stays on the executors: labelled
rows and queries are dealt to blocks of ``block_bytes``, each pair of blocks is searched in a
task, and the nearest of all blocks are kept. Pairs grow with the product of the two tables, memory
with a pair of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import shared_dir


@dataclass(frozen=True)
class KnnConfig:
    k: int = 5
    max_matrix_bytes: int = 64 << 20
    block_bytes: int = 32 << 20


@dataclass(frozen=True)
class LabelledRows:
    """The fitted classifier: vectors, ids and labels in order of id."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray


def _labelled(train: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    return train.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("int").alias("y"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), len(flat[0]))


def fit(train: DataFrame, vector: str, key: str, label: str) -> LabelledRows:
    """Collect all labelled rows, for tables whose matrix may be shipped."""
    table = _labelled(train, vector, key, label).toArrow()
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    return LabelledRows(_matrix(table["v"])[order], table["id"].to_numpy()[order], table["y"].to_numpy()[order])


def _search(q: np.ndarray, rows: LabelledRows, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distances of the k nearest rows of each query, ties by id."""
    t = rows.vectors
    k = min(k, len(t))
    rough = (q * q).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2.0 * (q @ t.T)
    # a few more than k by the fast formula, then exact distances decide
    spare = min(len(t), k + 16)
    near = np.sort(np.argpartition(rough, spare - 1, axis=1)[:, :spare], axis=1)
    exact = np.sqrt(((t[near] - q[:, None, :]) ** 2).sum(2))
    best = np.argsort(exact, axis=1, kind="stable")[:, :k]
    chosen, found = np.take_along_axis(near, best, 1), np.take_along_axis(exact, best, 1)
    limit = np.take_along_axis(rough, near, 1).max(axis=1)
    slack = 1e-9 * (1.0 + np.abs(rough).max(axis=1))
    unsure = np.flatnonzero((spare < len(t)) & (found[:, -1] ** 2 >= limit - slack))
    for i in unsure:  # many equal distances: measure that query against all rows
        d = np.sqrt(((t - q[i]) ** 2).sum(1))
        chosen[i] = np.argsort(d, kind="stable")[:k]
        found[i] = d[chosen[i]]
    return chosen, found


def _pair_search(k: int):
    """The k nearest rows of a block of labelled rows for each query of a block."""

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"]
        q, t = table.filter(asks), table.filter(pc.invert(asks)).sort_by("id")
        if not (q.num_rows and t.num_rows):
            return pa.table({"row": pa.array([], "int64"), "train_id": pa.array([], "int64"), "label": pa.array([], "int32"), "distance": pa.array([], "float64")})
        rows, asked = LabelledRows(_matrix(t["v"]), t["id"].combine_chunks(), t["y"].combine_chunks()), _matrix(q["v"])
        step = max(1, (32 << 20) // (8 * t.num_rows))
        parts = [_search(asked[at : at + step], rows, k) for at in range(0, len(asked), step)]
        chosen, found = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        taken = pa.array(chosen.ravel())
        owner = q["row"].combine_chunks().take(pa.array(np.repeat(np.arange(len(asked)), chosen.shape[1])))
        return pa.table({"row": owner, "train_id": rows.ids.take(taken), "label": rows.labels.take(taken), "distance": found.ravel()})

    return search


def _nearest_of_blocks(rows: DataFrame, blocks: int, queries: DataFrame, vector: str, key: str, width: int, cfg: KnnConfig, keep: tuple[str, ...]) -> DataFrame:
    """``nearest_neighbours`` of labelled rows in ``blocks`` blocks; nothing passes through the driver."""
    spark = queries.sparkSession
    path = f"{shared_dir(spark)}/knn-{uuid.uuid4().hex}"
    # ids may repeat, so a query is named by its place; stored, so that the name is given once
    numbered = queries.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("query_id"), *keep, F.col(vector).cast("array<double>").alias("v"))
    numbered.write.parquet(path)
    asked = spark.read.parquet(path)
    ask_blocks = max(1, -(-asked.count() * width * 8 // cfg.block_bytes))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.lit(True).alias("asks"), "row", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("y"), "v", F.pmod(F.xxhash64("row"), F.lit(ask_blocks)).cast("int").alias("a"), upto(blocks).alias("b"))
    dealt = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("b")
    right = rows.select(F.lit(False).alias("asks"), F.lit(None).cast("long").alias("row"), "id", "y", "v", upto(ask_blocks).alias("a"), dealt)
    found = left.unionByName(right).groupBy("a", "b").applyInArrow(_pair_search(cfg.k), "row long, train_id long, label int, distance double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "train_id", "label"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= cfg.k)
    return asked.select("row", "query_id", *keep).join(best, "row").select("query_id", *keep, "train_id", "label", "distance", "rank")


def nearest_neighbours(
    train: DataFrame, queries: DataFrame, vector: str, key: str, label: str, cfg: KnnConfig = KnnConfig(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(query_id, *keep, train_id, label, distance, rank)`` of the k nearest of all labelled rows.

    ``key`` is a long id in both tables.
    """
    n, width = train.agg(F.count("*"), F.max(F.size(vector))).first()
    if not n:
        raise ValueError("no training rows")
    if n * width * 8 > cfg.max_matrix_bytes:
        return _nearest_of_blocks(_labelled(train, vector, key, label), -(-n * width * 8 // cfg.block_bytes), queries, vector, key, width, cfg, keep)
    shared = queries.sparkSession.sparkContext.broadcast(fit(train, vector, key, label))
    asked = queries.select(F.col(key).cast("long").alias("query_id"), *keep, F.col(vector).alias("_vector"))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    schema = ", ".join([f"query_id long, {''.join(f'{c} {kinds[c]}, ' for c in keep)}train_id long", "label int", "distance double", "rank int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        step = max(1, (32 << 20) // (8 * len(rows.ids)))
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                chosen, found = _search(np.stack([np.asarray(x, dtype=np.float64) for x in part["_vector"]]), rows, cfg.k)
                k = chosen.shape[1]
                out = part.drop(columns="_vector").loc[part.index.repeat(k)].reset_index(drop=True)
                yield out.assign(train_id=rows.ids[chosen].ravel(), label=rows.labels[chosen].ravel(), distance=found.ravel(), rank=np.tile(np.arange(1, k + 1), len(part)))

    return asked.mapInPandas(run, schema)


def vote(neighbours: DataFrame) -> DataFrame:
    """Inverse-distance vote per query; zero distances outvote all others.

    Adds ``attack_probability`` and ``predicted_class`` (ties go to class 0).
    """
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query_id")) == 1
    weight = F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
    weighted = neighbours.withColumn("w", weight)
    summed = weighted.groupBy("query_id").agg(
        (F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("attack_probability")
    )
    return summed.withColumns(
        {
            "predicted_class": (F.col("attack_probability") > 0.5).cast("int"),
            "predicted_label": F.when(F.col("attack_probability") > 0.5, "ATTACK").otherwise("BENIGN"),
        }
    )


def classify(train: DataFrame, queries: DataFrame, vector: str, key: str, label: str, cfg: KnnConfig = KnnConfig()) -> DataFrame:
    return vote(nearest_neighbours(train, queries, vector, key, label, cfg))
