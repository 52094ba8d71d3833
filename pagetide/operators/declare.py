"""Synchronizing declared feeds with the feed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns a declaration governs; any other column of a feed is kept.
SYNCED = ("name", "url", "lang", "topic", "source_type")
# What a synchronization can do with a feed.
ACTIONS = ("created", "updated", "unchanged", "deactivated")


def sync_actions(feeds: DataFrame, declarations: DataFrame) -> DataFrame:
    """Per slug the action to take: created, updated, unchanged, deactivated or absent.

    'absent' is a feed neither declared nor active: it stays as it is.
    """
    existing = feeds.select(
        F.col("slug"), F.col("is_active"), F.struct(*SYNCED).alias("stored"), F.lit(True).alias("exists")
    )
    wanted = declarations.select(
        F.col("id").alias("slug"), F.struct(*SYNCED).alias("declared"), F.lit(True).alias("is_declared")
    )
    joined = existing.join(wanted, "slug", "full")
    action = (
        F.when(F.col("exists").isNull(), "created")
        .when(F.col("is_declared").isNull() & F.col("is_active"), "deactivated")
        .when(F.col("is_declared").isNull(), "absent")
        .when(~F.col("stored").eqNullSafe(F.col("declared")) | ~F.col("is_active"), "updated")
        .otherwise("unchanged")
    )
    return joined.select("slug", action.alias("action"), "declared")


def sync_report(actions: DataFrame) -> DataFrame:
    """Number of feeds per action, also of actions that nothing needed."""
    counted = actions.agg(*(F.count_if(F.col("action") == name).alias(name) for name in ACTIONS))
    rows = (F.struct(F.lit(name).alias("action"), F.col(name).alias("n_feeds")) for name in ACTIONS)
    return counted.select(F.inline(F.array(*rows)))


def apply_sync(feeds: DataFrame, declarations: DataFrame, now: Column) -> DataFrame:
    """The feed table after synchronization; feeds are deactivated, never deleted.

    New feeds get an id derived from their slug, so that a rerun gives the same one.
    """
    actions = sync_actions(feeds, declarations)
    joined = feeds.join(actions, "slug", "full")
    takes = F.col("action").isin("created", "updated")
    touched = F.col("action").isin("created", "updated", "deactivated")

    def governed(column: str) -> Column:
        return F.when(takes, F.col(f"declared.{column}")).otherwise(F.col(column)).alias(column)

    return joined.select(
        F.coalesce("feed_id", F.xxhash64("slug")).alias("feed_id"),
        "slug",
        *(governed(c) for c in SYNCED),
        F.when(F.col("action") == "deactivated", False)
        .when(takes, True)
        .otherwise(F.col("is_active"))
        .alias("is_active"),
        "etag",
        "last_modified",
        F.coalesce("created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def match_declarations(declarations: DataFrame, feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared feeds with their stored row, and those that must be synchronized first."""
    stored = feeds.select(F.col("slug").alias("id"), "feed_id")
    return declarations.join(stored, "id"), declarations.join(stored, "id", "left_anti")
