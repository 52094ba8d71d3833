"""Draining the attempt log as a file stream.

Files are read at least once and attempts stored once. Unlike a queue file that is read and
then emptied, the checkpoint of a file source loses no line written in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from pagetide.model import MISSED_RUN
from pagetide.plans.ingest import stage
from pagetide.sources.attempts import insert_or_ignore, parse_attempts
from pagetide.streaming.buckets import BucketTable


def _attempts(spark: SparkSession, state: str) -> BucketTable:
    return BucketTable(spark, f"{state}/missed_run", MISSED_RUN, ("attempted_at", "reason"))


def drain_available(spark: SparkSession, queue: str, state: str, drained_at: Column) -> None:
    """Store the attempts of files that arrived since the last call."""

    def work(lines: DataFrame, batch_id: int) -> None:
        incoming = stage(parse_attempts(lines, drained_at), f"{state}/_work/batch={batch_id}")
        table = _attempts(spark, state)
        version, numbers = table.touched(batch_id, incoming)
        stored = table.read(version, numbers)
        table.write(batch_id, version, numbers, stored.unionByName(insert_or_ignore(stored, incoming)))

    (
        spark.readStream.text(queue)
        .writeStream.foreachBatch(work)
        .option("checkpointLocation", f"{state}/_checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def stored_attempts(spark: SparkSession, state: str) -> DataFrame:
    return _attempts(spark, state).current()
