"""The corpus pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.stages import decontaminate, drop_near_copies, encode_pieces, keep_known_language, keep_quality
from flowloom.session import shared_dir

STAGES = [
    ("language_id", keep_known_language),
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]

#: Signatures, hashing order and piece scores have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
