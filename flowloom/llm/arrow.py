"""mapInArrow with the Arrow schema handed to the function."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, fn, out: StructType, *args) -> DataFrame:
    """``fn(batches, *args, schema)`` over the Arrow batches of each partition."""
    schema = to_arrow_schema(out)
    return df.mapInArrow(lambda batches: fn(batches, *args, schema), out)


def column_at(batch: pa.RecordBatch, path: tuple[str, ...]) -> pa.Array:
    """A column, or a field inside a struct column, so that a row's text need not be sent beside the row."""
    column = batch.column(path[0])
    return pc.struct_field(column, list(path[1:])) if path[1:] else column
