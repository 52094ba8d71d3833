"""Append-only tables of the streams.

Every micro-batch writes its own folder `batch=<n>`, named by the batch id and replaced as a
whole. A replayed batch therefore rewrites the same folder: effects happen once without a
transactional store. No batch reads these folders; what batches read is in `buckets`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pagetide.files import exists


def write_delta(df: DataFrame, state: str, table: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{state}/{table}/batch={batch}")


def read_deltas(spark: SparkSession, state: str, table: str, schema: T.StructType) -> DataFrame:
    """All rows written so far, with their `batch`; an unwritten table is empty."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    folder = f"{state}/{table}"
    if not exists(spark, folder):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(folder)
