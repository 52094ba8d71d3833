"""Ordered computations over keys of any size.

A window partitioned by a feed or a URL alone puts that key's whole history in one task, and
one key may hold a third of all rows. Here every ordered computation works on short *segments*
of a key's history (an hour, a day, or a counted piece of a day that is too full), which spread
over the cluster; what crosses a segment border is carried by one summary row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = 3600
DAY = 24 * HOUR

# Rows of a key that may meet in one task, and the pieces that a fuller time slice is cut into.
SEGMENT_ROWS = 50_000
PIECES = 256
# At most so many slices can hold more than their share of all rows.
FULL_SLICES = 1024


def time_segment(at: Column, seconds: int) -> Column:
    """Number of the time slice of `seconds` that holds `at`."""
    return F.floor(F.unix_seconds(at) / seconds).cast("long")


def segmented(df: DataFrame, key: str, at: str, into: str, *, seconds: int, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add the segment of a key's history that holds `at`: a time slice, or a piece of a full one.

    Slices are those of the calendar, and most keys have few rows in each. Where a key has more
    than `rows` in a slice, and over a thousandth of all, its slice is cut at quantiles counted
    there. At most `FULL_SLICES` slices can hold that much, so they and their cuts are small
    whatever the input (2 MB), and may be sent to every task. Segments are ordered by time.
    """
    cut = df.withColumn("__slice", time_segment(F.col(at), seconds))
    counts = cut.groupBy(key, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    share = counts.agg(F.ceil(F.sum("__n") / FULL_SLICES).alias("share")).scalar()
    full = F.broadcast(counts.filter(F.col("__n") > F.greatest(F.lit(rows), share)).select(key, "__slice"))
    quantiles = F.array(*(F.lit((i + 1) / PIECES) for i in range(PIECES - 1)))
    cuts = (
        cut.select(key, "__slice", F.unix_micros(at).alias("__at"))
        .join(full, [key, "__slice"], "left_semi")
        .groupBy(key, "__slice")
        .agg(F.array_distinct(F.percentile_approx("__at", quantiles, 10_000)).alias("__cuts"))
    )
    below = F.size(F.filter("__cuts", lambda c: c < F.unix_micros(at)))
    return (
        cut.join(F.broadcast(cuts), [key, "__slice"], "left")
        .withColumn(into, F.struct(F.col("__slice").alias("slice"), F.coalesce(below, F.lit(0)).alias("piece")))
        .drop("__slice", "__cuts")
    )


def successors(df: DataFrame, key: str, at: str, *, seconds: int = DAY, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows (key, start, end): each time of a key with the key's next one, NULL for the last.

    Equal times are counted before anything is ordered: all but one of them follow each other at
    once, so an instant that a key has any number of times is one row until the end.
    """
    times = df.groupBy(key, F.col(at).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    cut = segmented(times, key, "start", "segment", seconds=seconds, rows=rows)
    # One row per segment: the first time of the key's next segment follows its last time.
    following = (
        cut.groupBy(key, "segment")
        .agg(F.min("start").alias("opens_at"))
        .select(key, "segment", F.lead("opens_at").over(W.partitionBy(key).orderBy("segment")).alias("beyond"))
    )
    inside = F.lead("start").over(W.partitionBy(key, "segment").orderBy("start"))
    followed = cut.withColumn("inside", inside).join(following, [key, "segment"])
    return _repeated(followed.select(key, "start", F.coalesce("inside", "beyond").alias("end"), "n"))


def _repeated(counted: DataFrame) -> DataFrame:
    """A row for each of the `n` equal starts; all but the last end where they start."""
    step = 10_000  # an array of row numbers stays small
    return (
        counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))))
        .withColumn("i", F.explode(F.sequence(F.col("block") * step + 1, F.least(F.col("block") * step + step, "n"))))
        .withColumn("end", F.when(F.col("i") == F.col("n"), F.col("end")).otherwise(F.col("start")))
        .drop("n", "block", "i")
    )


def running_max_before(
    df: DataFrame, key: str, segment: str, order: str, value: str, into: str
) -> DataFrame:
    """Add the largest `value` among the rows of `key` that come strictly before, by `order`.

    `segment` must grow with `order`.
    """
    earlier = (W.unboundedPreceding, -1)
    inner = F.max(value).over(W.partitionBy(key, segment).orderBy(order).rowsBetween(*earlier))
    carried = (
        df.groupBy(key, segment)
        .agg(F.max(value).alias("__top"))
        .select(
            key,
            segment,
            F.max("__top").over(W.partitionBy(key).orderBy(segment).rowsBetween(*earlier)).alias("__carry"),
        )
    )
    return (
        df.withColumn("__inner", inner)
        .join(carried, [key, segment])
        .withColumn(into, F.greatest("__inner", "__carry"))
        .drop("__inner", "__carry")
    )


def grouped_median(df: DataFrame, key: str, value: str, into: str, *, width: int) -> DataFrame:
    """Exact median of an integer column per key, mean of the middle two.

    Equal values are counted before anything is ordered. The middle ranks are located among
    buckets `width` wide, and only the values of the buckets holding them are ordered.
    """
    counted = (
        df.groupBy(key, value)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.floor(F.col(value) / width).cast("long"))
    )
    by_bucket = W.partitionBy(key).orderBy("bucket")
    ranked = (
        counted.groupBy(key, "bucket")
        .agg(F.sum("n").alias("n"))
        .select(
            key,
            "bucket",
            (F.sum("n").over(by_bucket) - F.col("n")).alias("before"),
            F.sum("n").over(by_bucket).alias("through"),
            F.sum("n").over(W.partitionBy(key)).alias("total"),
        )
    )
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = ranked.filter((F.col("before") <= high) & (F.col("through") > low)).drop("through")
    through = F.col("before") + F.sum("n").over(W.partitionBy(key, "bucket").orderBy(value))
    placed = counted.join(middle, [key, "bucket"]).withColumn("through", through)

    def value_at(rank: Column) -> Column:
        return F.min(F.when(F.col("through") > rank, F.col(value)))

    return placed.groupBy(key).agg(((value_at(low) + value_at(high)) / F.lit(2.0)).alias(into))


def cumulative_counts(points: DataFrame, at: str, weight: str, into: str, *, seconds: int = HOUR) -> DataFrame:
    """Distinct times with the total weight of all points up to and including each.

    Points are summed per distinct time first, so a busy instant is one row. Three levels add up:
    slices of `seconds` over all history, seconds within a slice, times within a second. So only
    the times of one second meet in a task.
    """
    distinct = (
        points.groupBy(at)
        .agg(F.sum(weight).alias("n"))
        .withColumn("segment", time_segment(F.col(at), seconds))
        .withColumn("second", time_segment(F.col(at), 1))
    )
    ticks = distinct.groupBy("segment", "second").agg(F.sum("n").alias("total"))
    within = F.sum("total").over(W.partitionBy("segment").orderBy("second")) - F.col("total")
    # Bounded by the calendar: ten years of hours are 87,600 rows, whatever the data volume.
    slices = (
        ticks.groupBy("segment")
        .agg(F.sum("total").alias("total"))
        .select("segment", (F.sum("total").over(W.orderBy("segment")) - F.col("total")).alias("before"))
    )
    earlier = (
        ticks.withColumn("within", within)
        .join(slices, "segment")
        .select("second", (F.col("before") + F.col("within")).alias("earlier"))
    )
    inner = F.sum("n").over(W.partitionBy("second").orderBy(at))
    return (
        distinct.withColumn("inner", inner)
        .join(earlier, "second")
        .select(at, (F.col("earlier") + F.col("inner")).alias(into))
    )
