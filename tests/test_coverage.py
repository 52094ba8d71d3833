from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from support import at, utc

from pagetide.operators import coverage

NOW = at("2026-08-29T12:00:00")
STEP = timedelta(hours=6)
RUNS = "feed_id long, started_at timestamp, status string, gap_status string"


def report(spark, runs, attempts=(), planned=STEP, now=NOW, feeds=((1, "sain", True),)):
    return coverage.build_coverage(
        spark.createDataFrame(list(feeds), "feed_id long, slug string, is_active boolean"),
        spark.createDataFrame(list(runs), RUNS),
        spark.createDataFrame([(a,) for a in attempts], "attempted_at timestamp"),
        now=F.lit(now).cast("timestamp"),
        planned=planned,
    )


def every_step(start, count, status="ok", gap="none", feed=1):
    return [(feed, start + i * STEP, status, gap) for i in range(count)]


def one(frame):
    (row,) = frame.collect()
    return row


def test_current_silence_is_a_gap_although_all_closed_intervals_are_regular(spark):
    done = report(spark, every_step(NOW - timedelta(days=12), 8))
    feed, gap = one(done.feeds), one(done.gaps)
    assert feed["has_ongoing_gap"] and feed["n_gaps"] == 1
    assert gap["ongoing"] and utc(gap["end"]) == NOW
    assert feed["worst_interval_us"] > 9 * 86_400_000_000
    assert feed["median_interval_us"] == 6 * 3_600_000_000


def test_regular_collection_has_no_gap(spark):
    done = report(spark, every_step(NOW - timedelta(days=2), 9))
    assert done.gaps.count() == 0
    assert not one(done.feeds)["has_ongoing_gap"]


def test_three_day_gap_is_located_exactly(spark):
    start = NOW - timedelta(days=10)
    resumed = start + 3 * STEP + timedelta(days=3)
    done = report(spark, every_step(start, 4) + every_step(resumed, int((NOW - resumed) / STEP) + 1))
    gap = one(done.gaps)
    assert (utc(gap["start"]), utc(gap["end"]), gap["ongoing"]) == (start + 3 * STEP, resumed, False)
    assert gap["duration_us"] == 3 * 86_400_000_000


def test_errors_close_nothing_and_unchanged_pages_do(spark):
    start = NOW - timedelta(days=6)
    failing = [(1, start, "ok", "none"), (1, NOW - timedelta(hours=1), "ok", "none")]
    failing += [(1, start + timedelta(days=i), "error", "unknown") for i in range(1, 4)]
    done = report(spark, failing)
    assert one(done.feeds)["n_runs"] == 2 and one(done.gaps)["duration_us"] > 4 * 86_400_000_000
    assert report(spark, every_step(NOW - timedelta(days=2), 9, "not_modified")).gaps.count() == 0


def test_threshold_is_strict_and_configured(spark):
    runs = [(1, NOW - timedelta(hours=h), "ok", "none") for h in (32, 12, 6, 0)]
    assert report(spark, runs).gaps.count() == 1
    assert report(spark, runs, planned=timedelta(hours=24)).gaps.count() == 0
    assert report(spark, runs, planned=timedelta(hours=10)).gaps.count() == 0


def test_few_runs_are_not_observed(spark):
    feed = one(report(spark, [(1, NOW - timedelta(seconds=7), "ok", "none"), (1, NOW, "ok", "none")]).feeds)
    assert feed["n_runs"] == 2 and not feed["observed"]


def test_feed_that_never_ran_has_no_invented_gap(spark):
    done = report(spark, [])
    feed = one(done.feeds)
    assert (feed["n_runs"], feed["first_run"], feed["median_interval_us"]) == (0, None, None)
    assert done.gaps.count() == 0
    assert one(done.summary)["window_start"] is None


def test_attempts_explain_gaps(spark):
    start = NOW - timedelta(days=6)
    runs = [(1, start, "ok", "none"), (1, NOW, "ok", "none"), (2, start, "ok", "none")]
    attempts = [start + i * STEP for i in range(1, 15)] + [start, NOW + STEP]
    done = report(spark, runs, attempts, feeds=[(1, "a", True), (2, "b", False)])
    assert {(g["feed_id"], g["missed_attempts"]) for g in done.gaps.collect()} == {(1, 14), (2, 14)}
    assert one(done.summary).asDict() | {"window_start": None} == {
        "window_start": None, "n_feeds": 2, "n_feeds_with_ongoing_gap": 1, "missed_total": 16,
    }


def test_many_feeds_silent_since_the_same_instant(spark):
    """All open gaps end at one instant, the hot key of the count lookup."""
    start = NOW - timedelta(days=3)
    runs = [(feed, start, "ok", "none") for feed in range(500)]
    done = report(spark, runs, [start + STEP, NOW])
    assert [(g["missed_attempts"], g["ongoing"]) for g in done.gaps.collect()] == [(2, True)] * 500


def test_suspected_runs_are_counted_whatever_their_status(spark):
    runs = every_step(NOW - timedelta(days=1), 2, gap="suspected") + every_step(NOW, 1, "error", "suspected")
    assert one(report(spark, runs).feeds)["n_suspected"] == 3


def test_now_before_the_last_run_gives_a_negative_open_interval(spark):
    feed = one(report(spark, [(1, NOW + STEP, "ok", "none")]).feeds)
    assert feed["worst_interval_us"] == -6 * 3_600_000_000


def test_display_tables(spark):
    done = report(spark, every_step(NOW - timedelta(days=12), 8), feeds=[(1, "b", True), (2, "a", False), (3, "a-jamais", True)])
    rows = coverage.coverage_table(done.feeds, now=F.lit(NOW).cast("timestamp")).collect()
    assert [r["slug"] for r in rows] == ["a-jamais", "b", "a"]
    assert rows[0]["first_run"] == "jamais" and rows[0]["median_interval"] == "—"
    assert rows[1]["median_interval"] == "6 h"
    gap = one(coverage.gap_table(done.gaps, spark.createDataFrame([(1, "b", True)], "feed_id long, slug string, is_active boolean")))
    assert gap["until"] == "en cours" and gap["missed_attempts"] == "—"


def test_zoneless_run_times_are_refused(spark):
    runs = spark.sql("SELECT 1L AS feed_id, timestamp_ntz'2024-01-01 00:00:00' AS started_at, 'ok' AS status")
    with pytest.raises(TypeError, match="time zone"):
        coverage.run_intervals(runs, F.lit(NOW))
