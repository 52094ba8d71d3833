"""Log of aborted ingestion attempts, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions.dates import parse_zoned
from pagetide.model import MISSED_REASONS

# Reason of an unreadable or missing one; longest detail kept.
FALLBACK_REASON = "wrapper_error"
DETAIL_LENGTH = 2000

# A detail that is no text and counts as none: zero, false, an empty list or object.
_EMPTY_DETAIL = r"^(?:-?0(?:\.0*)?(?:[eE][+-]?[0-9]+)?|false|\[\s*\]|\{\s*\})$"
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def parse_attempts(lines: DataFrame, drained_at: Column, *, line: str = "value") -> DataFrame:
    """Attempts (attempted_at, reason, detail, drained_at) of a text column.

    Lines that are no JSON object and nothing else, or whose time is missing, unreadable or without offset, are
    dropped. A missing or unknown reason becomes the fallback.
    """
    # As the only element of an array, an object with anything behind it is malformed.
    alone = F.concat(F.lit("["), F.col(line), F.lit("]"))
    objects = F.from_json(alone, "array<struct<attempted_at: string, reason: string, detail: string>>", _STRICT)
    typed = F.from_json(alone, "array<struct<detail: variant>>", _STRICT)
    parsed = lines.select(
        F.when(F.size(objects) == 1, F.get(objects, 0)).alias("f"),
        F.coalesce(F.to_json(F.get(typed, 0)["detail"]).rlike(_EMPTY_DETAIL), F.lit(False)).alias("no_detail"),
    )
    reason = F.col("f.reason")
    attempt = F.struct(
        parse_zoned(F.col("f.attempted_at")).alias("attempted_at"),
        F.when(reason.isin(*MISSED_REASONS), reason).otherwise(FALLBACK_REASON).alias("reason"),
        F.when(
            (F.col("f.detail") != "") & ~F.col("no_detail"), F.substring("f.detail", 1, DETAIL_LENGTH)
        ).alias("detail"),
    )
    # Filtering the generated rows keeps the planner from parsing each line once more below.
    read = parsed.select(F.inline_outer(F.array(attempt)))
    return read.filter(F.col("attempted_at").isNotNull()).withColumn("drained_at", drained_at)


def read_attempts(spark: SparkSession, path: str, drained_at: Column) -> DataFrame:
    return parse_attempts(spark.read.text(path), drained_at)


def insert_or_ignore(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming attempts whose (attempted_at, reason) is not stored, one per key.

    Of lines with equal keys one with a detail is preferred, then the smallest, so that a replay
    picks the same.
    """
    unique = incoming.groupBy("attempted_at", "reason").agg(
        F.min_by(F.struct("detail", "drained_at"), F.struct(F.col("detail").isNull(), "detail")).alias("kept")
    )
    fresh = unique.join(stored.select("attempted_at", "reason"), ["attempted_at", "reason"], "left_anti")
    return fresh.select("attempted_at", "reason", "kept.detail", "kept.drained_at")
