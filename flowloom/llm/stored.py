"""Intermediate tables written to the shared folder, so that lost executors cost no rework."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from flowloom.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under the folder named by ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
