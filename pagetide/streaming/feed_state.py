"""Running state per feed, kept by the stream itself.

Each feed has one value: the largest reliable date it has shown so far, and the verdict of its
last run. A run is held against the value as it was before it; then its own date enters. State
is as large as the number of feeds, whatever their histories. To ask for a value and to store it
costs far more than the runs that it is held against, so feeds lie together in `SLOTS` slots,
whose values are asked for at once; a batch touches the slots of the feeds that ran in it. The
input is one narrow row a run (`newly_sighted_maximum` has the dates), so the runs of a slot in
one batch, a thousandth of all, and those of one feed may meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

RUNS = "feed_id long, run_id long, run_order long, oldest timestamp, run_max timestamp"
TOLD = (
    "feed_id long, run_id long, prev_max_published timestamp, overlaps boolean, last_overlaps boolean, n_runs long"
)
# Fixed for a state: a feed must be found in its slot again.
SLOTS = 1024
# Stands for NULL on the way to the processor and back: pandas would turn longs beside NULL into floats.
ABSENT = (1 << 63) - 1
# The store that keyed values of this kind need.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor() -> StatefulProcessor:
    """Made in a function, so that it is sent by value and executors need no copy of the package."""

    class FeedState(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            # one list a column, in the same order of feeds
            kinds = "feed_id array<long>, max_published array<long>, overlaps array<boolean>, n_runs array<long>"
            self.value = handle.getValueState("feeds", kinds)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            stored = self.value.get() if self.value.exists() else None
            feeds = {feed: values for feed, *values in zip(*stored, strict=True)} if stored else {}
            batch = pd.concat(list(rows)).sort_values(["run_order", "run_id"], kind="stable")
            columns = (batch[c].tolist() for c in ("feed_id", "run_id", "oldest_us", "max_us"))
            told = []
            for feed, run_id, oldest, newest in zip(*columns, strict=True):
                known, overlaps, n_runs = feeds.get(feed, (ABSENT, None, 0))
                held = None if ABSENT in (known, oldest) else oldest <= known
                told.append((feed, run_id, known, held, overlaps, n_runs))
                if newest != ABSENT:
                    known = newest if known == ABSENT else max(known, newest)
                feeds[feed] = (known, overlaps if held is None else held, n_runs + 1)
            self.value.update((list(feeds), *map(list, zip(*feeds.values(), strict=True))))
            names = ["feed_id", "run_id", "known_us", "overlaps", "last_overlaps", "n_runs"]
            frame = pd.DataFrame(told, columns=names)
            yield frame.astype({"overlaps": "boolean", "last_overlaps": "boolean"})

        def close(self) -> None:
            pass

    return FeedState()


def with_feed_state(runs: DataFrame) -> DataFrame:
    """The rows of a stream of `RUNS`, each with what was known of its feed before it (`TOLD`)."""
    sent = {
        "feed_id": F.col("feed_id"),
        "run_id": F.col("run_id"),
        "run_order": F.col("run_order"),
        "oldest_us": F.unix_micros("oldest"),
        "max_us": F.unix_micros("run_max"),
    }
    narrow = runs.select(
        F.pmod(F.xxhash64("feed_id"), F.lit(SLOTS)).alias("slot"),
        *(F.coalesce(value, F.lit(ABSENT)).alias(name) for name, value in sent.items()),
    )
    told = narrow.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=_processor(),
        outputStructType="feed_id long, run_id long, known_us long, overlaps boolean, last_overlaps boolean, n_runs long",
        outputMode="append",
        timeMode="none",
    )
    feed_id, run_id, known = (F.nullif(F.col(c), F.lit(ABSENT)) for c in ("feed_id", "run_id", "known_us"))
    return told.select(
        feed_id.alias("feed_id"),
        run_id.alias("run_id"),
        F.timestamp_micros(known).alias("prev_max_published"),
        "overlaps",
        "last_overlaps",
        "n_runs",
    )


def tell_available(spark: SparkSession, landed: str, state: str, *, files_per_batch: int | None = None) -> None:
    """Assess the runs in the files that arrived below `landed` since the last call."""
    reader = spark.readStream.schema(RUNS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = _started(with_feed_state(reader.parquet(landed)), state)
    query.awaitTermination()


def _started(told: DataFrame, state: str) -> StreamingQuery:
    """Start with the store that the state needs; the session keeps its own setting."""
    spark = told.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return (
            told.writeStream.format("parquet")
            .option("path", f"{state}/told")
            .option("checkpointLocation", f"{state}/_checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def told_runs(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.schema(TOLD).parquet(f"{state}/told")
