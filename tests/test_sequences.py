"""The segmented computations against plain Python, with one key holding most rows."""

from __future__ import annotations

import random
import statistics
from datetime import timedelta

import pytest
from support import at, utc

from pyspark.sql import functions as F

from pagetide.operators.sequences import (
    cumulative_counts,
    grouped_median,
    running_max_before,
    segmented,
    successors,
)

BASE = at("2024-01-01T00:00:00")


def skewed_times(rng, n=600):
    """Two thirds of the rows belong to key 0; equal times and long silences occur."""
    rows = []
    for _ in range(n):
        key = 0 if rng.random() < 0.67 else rng.randint(1, 5)
        rows.append((key, BASE + timedelta(seconds=rng.choice([rng.randint(0, 900_000), 86_400 * rng.randint(0, 9)]))))
    return rows


@pytest.mark.parametrize(("seconds", "full"), [(60, 50_000), (86_400, 50_000), (86_400, 3), (864_000, 20)])
def test_successors(spark, seconds, full):
    rows = skewed_times(random.Random(1))
    frame = spark.createDataFrame(rows, "key int, t timestamp")
    got = sorted((r["key"], utc(r["start"]), utc(r["end"]) or BASE.max.replace(tzinfo=BASE.tzinfo))
                 for r in successors(frame, "key", "t", seconds=seconds, rows=full).collect())
    wanted = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key)
        wanted += [(key, a, b) for a, b in zip(times, [*times[1:], BASE.max.replace(tzinfo=BASE.tzinfo)], strict=True)]
    assert got == sorted(wanted)


def test_one_day_of_one_key_is_many_pieces(spark):
    """All runs of one feed in one day, most of them in one hour: no task has more than its share."""
    frame = spark.sql("SELECT 1 AS key, timestamp_micros(1704067200000000 + IF(id < 800, id, id * 4000000)) AS t FROM range(16000)")
    cut = segmented(frame, "key", "t", "segment", seconds=86_400, rows=100)
    sizes = [r["count"] for r in cut.groupBy("segment").count().collect()]
    assert sum(sizes) == 16_000 and len(sizes) >= 200 and max(sizes) <= 160
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        followed = successors(frame, "key", "t", rows=100).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in followed.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(tasks) == 16_000 and len(tasks) >= 8 and max(tasks) <= 3 * 16_000 / 16


def test_an_instant_of_many_rows(spark):
    frame = spark.sql("SELECT 1 AS key, timestamp_micros(IF(id < 25000, 5, id)) AS t FROM range(25010)")
    rows = successors(frame, "key", "t").groupBy("start", "end").count().collect()
    assert sorted(r["count"] for r in rows)[-1] == 24_999 and len(rows) == 12


@pytest.mark.parametrize("width", [1, 50])
def test_grouped_median(spark, width):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 9), rng.choice([7, 7, rng.randint(-500, 500)])) for _ in range(500)]
    rows += [(20, 3), (21, 1), (21, 4)]
    frame = spark.createDataFrame(rows, "key int, v long")
    got = {r["key"]: r["m"] for r in grouped_median(frame, "key", "v", "m", width=width).collect()}
    assert got == {k: statistics.median([v for kk, v in rows if kk == k]) for k in {k for k, _ in rows}}


def test_running_max_before(spark):
    rng = random.Random(3)
    rows = [(k, i, i // 4, rng.choice([None, rng.randint(0, 99)])) for k in range(3) for i in range(30)]
    frame = spark.createDataFrame(rows, "key int, i int, seg int, v int")
    got = {(r["key"], r["i"]): r["m"] for r in running_max_before(frame, "key", "seg", "i", "v", "m").collect()}
    for key, i, _, _ in rows:
        earlier = [v for k, j, _, v in rows if k == key and j < i and v is not None]
        assert got[key, i] == (max(earlier) if earlier else None)


@pytest.mark.parametrize("seconds", [10, 3600])
def test_cumulative_counts(spark, seconds):
    rng = random.Random(4)
    points = [(BASE + timedelta(seconds=rng.randint(0, 20_000)), rng.randint(0, 1)) for _ in range(400)]
    frame = spark.createDataFrame(points, "t timestamp, n int")
    got = {utc(r["t"]): r["c"] for r in cumulative_counts(frame, "t", "n", "c", seconds=seconds).collect()}
    assert got == {t: sum(n for u, n in points if u <= t) for t, _ in points}
