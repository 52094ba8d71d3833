"""Temporal coverage of the collection.

The observation window of a feed ends at `now`, never at its last run, so the current silence
is visible. Only runs that reached the feed close a gap. Nothing is expressed as a percentage:
the results are intervals and dated periods.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.dates import absolute_date, datetime_attr, duration, relative_date
from pagetide.model import CLOSING_STATUSES
from pagetide.operators.sequences import DAY, cumulative_counts, grouped_median, successors
from pagetide.session import require_zoned

# Gap threshold in planned intervals; runs needed for a meaningful median.
THRESHOLD_FACTOR = 2
MIN_OBSERVED_RUNS = 3

# Bucket of the median search. The intervals of one feed add up to its history, so a feed has
# at most a few thousand distinct minutes among them.
MEDIAN_BUCKET_MICROS = 60_000_000

# Open gaps of all feeds end at the same instant: that one join key is spread over these slots.
OPEN_END_SLOTS = 32


@dataclass(frozen=True)
class Coverage:
    gaps: DataFrame
    feeds: DataFrame
    summary: DataFrame


def run_intervals(runs: DataFrame, now: Column, *, segment_seconds: int = DAY) -> DataFrame:
    """Intervals (feed_id, start, end, ongoing) between closing runs; the last ends at `now`."""
    require_zoned(runs, "started_at")
    closing = runs.filter(F.col("status").isin(*CLOSING_STATUSES))
    return successors(closing, "feed_id", "started_at", seconds=segment_seconds).select(
        "feed_id",
        "start",
        F.coalesce("end", now).alias("end"),
        F.col("end").isNull().alias("ongoing"),
    )


def _length_micros() -> Column:
    return F.unix_micros("end") - F.unix_micros("start")


def _is_gap(planned: timedelta) -> Column:
    threshold = THRESHOLD_FACTOR * planned
    return _length_micros() > threshold // timedelta(microseconds=1)


def with_attempt_counts(gaps: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Add `missed_attempts`: aborted attempts after each gap's start, up to its end.

    A gap's count is the difference of two cumulative counts, looked up by equality at its
    two ends, so the work is gaps + attempts and never gaps x attempts.
    """
    ends = gaps.select(F.explode(F.array("start", "end")).alias("at"), F.lit(0).alias("n"))
    points = attempts.select(F.col("attempted_at").alias("at"), F.lit(1).alias("n"))
    counts = cumulative_counts(points.unionByName(ends), "at", "n", "through")

    slot = F.when(F.col("ongoing"), F.pmod(F.xxhash64("feed_id"), F.lit(OPEN_END_SLOTS))).otherwise(0)
    slots = F.when(F.col("at") == now, F.sequence(F.lit(0), F.lit(OPEN_END_SLOTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    at_end = counts.withColumn("slot", F.explode(slots)).select(
        F.col("at").alias("end"), F.col("slot").cast("long"), F.col("through").alias("by_end")
    )
    at_start = counts.select(F.col("at").alias("start"), F.col("through").alias("by_start"))
    return (
        gaps.withColumn("slot", slot.cast("long"))
        .join(at_start, "start")
        .join(at_end, ["end", "slot"])
        .withColumn("missed_attempts", F.col("by_end") - F.col("by_start"))
        .drop("slot", "by_start", "by_end")
    )


def coverage_gaps(
    runs: DataFrame, attempts: DataFrame, *, now: Column, planned: timedelta, segment_seconds: int = DAY
) -> DataFrame:
    """Periods without a successful run longer than twice the planned interval."""
    gaps = run_intervals(runs, now, segment_seconds=segment_seconds).filter(_is_gap(planned))
    return with_attempt_counts(gaps, attempts, now).withColumn("duration_us", _length_micros())


def feed_coverage(
    feeds: DataFrame, runs: DataFrame, *, now: Column, planned: timedelta, segment_seconds: int = DAY
) -> DataFrame:
    """One row per feed, including feeds that never ran; inactive feeds are kept."""
    intervals = (
        run_intervals(runs, now, segment_seconds=segment_seconds)
        .withColumn("length", _length_micros())
        .withColumn("gap", _is_gap(planned))
    )
    measured = intervals.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.min("start").alias("first_run"),
        F.max("start").alias("last_run"),
        F.max("length").alias("worst_interval_us"),
        F.count_if("gap").alias("n_gaps"),
        F.bool_or(F.col("gap") & F.col("ongoing")).alias("has_ongoing_gap"),
    )
    # The open interval is not finished: counting it would bias the median.
    median = grouped_median(
        intervals.filter(~F.col("ongoing")),
        "feed_id",
        "length",
        "median_interval_us",
        width=MEDIAN_BUCKET_MICROS,
    )
    suspected = runs.groupBy("feed_id").agg(
        F.count_if(F.col("gap_status") == "suspected").alias("n_suspected")
    )
    joined = feeds
    for part in (measured, median, suspected):
        joined = joined.join(part, "feed_id", "left")
    return joined.select(
        *feeds.columns,
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        "first_run",
        "last_run",
        "median_interval_us",
        "worst_interval_us",
        F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
        F.coalesce("has_ongoing_gap", F.lit(False)).alias("has_ongoing_gap"),
        (F.coalesce("n_runs", F.lit(0)) >= MIN_OBSERVED_RUNS).alias("observed"),
        F.coalesce("n_suspected", F.lit(0)).alias("n_suspected"),
    )


def coverage_summary(coverage: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row: window start, number of feeds, feeds in an open gap, attempts in total."""
    of_feeds = coverage.agg(
        F.min("first_run").alias("window_start"),
        F.count(F.lit(1)).alias("n_feeds"),
        F.count_if("has_ongoing_gap").alias("n_feeds_with_ongoing_gap"),
        F.lit(None).cast("long").alias("missed_total"),
    )
    of_attempts = attempts.agg(
        F.lit(None).cast("timestamp").alias("window_start"),
        F.lit(None).cast("long").alias("n_feeds"),
        F.lit(None).cast("long").alias("n_feeds_with_ongoing_gap"),
        F.count(F.lit(1)).alias("missed_total"),
    )
    both = of_feeds.unionByName(of_attempts)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def build_coverage(
    feeds: DataFrame, runs: DataFrame, attempts: DataFrame, *, now: Column, planned: timedelta
) -> Coverage:
    per_feed = feed_coverage(feeds, runs, now=now, planned=planned)
    return Coverage(
        gaps=coverage_gaps(runs, attempts, now=now, planned=planned),
        feeds=per_feed,
        summary=coverage_summary(per_feed, attempts),
    )


def coverage_table(per_feed: DataFrame, *, now: Column) -> DataFrame:
    """Displayed form of the feed rows: active feeds first, then by slug."""
    return per_feed.select(
        "slug",
        "is_active",
        "n_runs",
        F.coalesce(absolute_date(F.col("first_run")), F.lit("jamais")).alias("first_run"),
        F.coalesce(relative_date(F.col("last_run"), now), F.lit("jamais")).alias("last_run"),
        # Over too few runs a median means nothing and must not be readable as if it did.
        F.when(F.col("observed"), duration(F.col("median_interval_us").cast("long")))
        .otherwise("—")
        .alias("median_interval"),
        duration(F.col("worst_interval_us")).alias("worst_interval"),
        "n_gaps",
        "n_suspected",
        "has_ongoing_gap",
    ).orderBy(F.col("is_active").desc(), "slug")


def gap_table(gaps: DataFrame, feeds: DataFrame) -> DataFrame:
    """Displayed form of the gaps."""
    return gaps.join(feeds.select("feed_id", "slug", "is_active"), "feed_id").select(
        "slug",
        "is_active",
        F.col("start").alias("start"),
        datetime_attr(F.col("start")).alias("start_attr"),
        absolute_date(F.col("start")).alias("since"),
        F.when(F.col("ongoing"), "en cours").otherwise(absolute_date(F.col("end"))).alias("until"),
        duration(F.col("duration_us")).alias("duration"),
        F.when(F.col("missed_attempts") > 0, F.col("missed_attempts").cast("string"))
        .otherwise("—")
        .alias("missed_attempts"),
    )
