"""Constraint audit and cascade preview.

Parquet enforces no constraints, so the rules the tables must obey are queries: each yields the
offending keys, and an empty result is a clean table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide import model


@dataclass(frozen=True)
class Rules:
    """Constraints of one table; `key` names the columns shown for an offending row."""

    key: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    domains: tuple[tuple[str, tuple[str, ...]], ...] = ()
    max_lengths: tuple[tuple[str, int], ...] = ()
    exact_lengths: tuple[tuple[str, int], ...] = ()
    # (column, referenced table, referenced column)
    references: tuple[tuple[str, str, str], ...] = ()


# The constraints of the data model.
TABLE_RULES = {
    "feed": Rules(
        key=("slug",),
        not_null=("slug", "name", "url", "lang", "topic", "source_type", "is_active", "created_at", "updated_at"),
        unique=(("slug",), ("url",)),
        domains=(
            ("lang", model.LANGS),
            ("topic", model.TOPICS),
            ("source_type", model.SOURCE_TYPES),
        ),
        max_lengths=(("slug", 64), ("name", 200)),
    ),
    "article": Rules(
        key=("url_canonical",),
        not_null=(
            "url_canonical",
            "first_feed_id",
            "title",
            "content_hash",
            "published_at",
            "date_source",
            "first_seen_at",
            "last_seen_at",
            "updated_at",
        ),
        unique=(("url_canonical",),),
        domains=(("date_source", model.DATE_SOURCES),),
        exact_lengths=(("content_hash", model.CONTENT_HASH_LENGTH),),
        references=(("first_feed_id", "feed", "feed_id"),),
    ),
    "article_feed": Rules(
        key=("url_canonical", "feed_id"),
        not_null=("url_canonical", "feed_id", "url_original", "first_seen_at", "last_seen_at"),
        unique=(("url_canonical", "feed_id"),),
        references=(("url_canonical", "article", "url_canonical"), ("feed_id", "feed", "feed_id")),
    ),
    "feed_run": Rules(
        key=("feed_id", "started_at"),
        not_null=("feed_id", "started_at", "status", "n_new", "n_seen", "gap_status"),
        domains=(("status", model.RUN_STATUSES), ("gap_status", model.GAP_STATUSES)),
        references=(("feed_id", "feed", "feed_id"),),
    ),
    "missed_run": Rules(
        key=("attempted_at", "reason"),
        not_null=("attempted_at", "reason", "drained_at"),
        unique=(("attempted_at", "reason"),),
        domains=(("reason", model.MISSED_REASONS),),
    ),
}


def _key_text(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def row_violations(table: DataFrame, name: str, rules: Rules) -> DataFrame:
    """Rows breaking a rule that a row can break alone; all rules are tested in one scan."""
    broken = [(f"not_null:{c}", F.col(c).isNull()) for c in rules.not_null]
    broken += [(f"domain:{c}", ~F.col(c).isin(*allowed)) for c, allowed in rules.domains]
    broken += [(f"max_length:{c}", F.length(c) > limit) for c, limit in rules.max_lengths]
    broken += [(f"exact_length:{c}", F.length(c) != size) for c, size in rules.exact_lengths]
    named = F.filter(
        F.array(*(F.when(test, F.lit(rule)) for rule, test in broken)), lambda rule: rule.isNotNull()
    )
    return table.select(
        F.lit(name).alias("table_name"),
        F.explode(named).alias("rule"),
        _key_text(rules.key).alias("row_key"),
        F.lit(1).cast("long").alias("n_rows"),
    )


def duplicate_violations(table: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """Keys held by several rows; rows with a NULL in the key are distinct, as in SQL."""
    counted = table.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.filter("n_rows > 1").select(
        F.lit(name).alias("table_name"),
        F.lit("unique:" + ",".join(columns)).alias("rule"),
        _key_text(columns).alias("row_key"),
        "n_rows",
    )


def reference_violations(
    table: DataFrame, name: str, column: str, target: DataFrame, target_column: str
) -> DataFrame:
    """Referencing values without a referenced row, counted before the join."""
    used = table.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    known = target.select(F.col(target_column).alias(column))
    return used.join(known, column, "left_anti").select(
        F.lit(name).alias("table_name"),
        F.lit(f"reference:{column}").alias("rule"),
        _key_text((column,)).alias("row_key"),
        "n_rows",
    )


def audit(tables: dict[str, DataFrame], rules: dict[str, Rules] | None = None) -> DataFrame:
    """All violations (table_name, rule, row_key, n_rows) of the given tables."""
    parts = []
    for name, table in tables.items():
        rule = (rules or TABLE_RULES)[name]
        parts.append(row_violations(table, name, rule))
        parts += [duplicate_violations(table, name, columns) for columns in rule.unique]
        parts += [
            reference_violations(table, name, column, tables[target], target_column)
            for column, target, target_column in rule.references
            if target in tables
        ]
    return reduce(DataFrame.unionByName, parts)


def naive_columns(table: DataFrame, name: str) -> list[str]:
    """Columns holding timestamps without a zone; read from the schema, no job is run."""
    return [f"{name}.{f.name}" for f in table.schema if isinstance(f.dataType, T.TimestampNTZType)]


@dataclass(frozen=True)
class Purge:
    """What remains after feeds are deleted, with everything that hangs on them."""

    feeds: DataFrame
    runs: DataFrame
    articles: DataFrame
    sightings: DataFrame


def purge_feeds(
    deleted: DataFrame, feeds: DataFrame, runs: DataFrame, articles: DataFrame, sightings: DataFrame
) -> Purge:
    """Delete feeds (feed_id) with their runs, the articles they saw first, and all sightings
    of those articles, also by other feeds."""
    doomed_articles = articles.join(
        deleted.select(F.col("feed_id").alias("first_feed_id")), "first_feed_id", "left_semi"
    ).select("url_canonical")
    return Purge(
        feeds=feeds.join(deleted, "feed_id", "left_anti"),
        runs=runs.join(deleted, "feed_id", "left_anti"),
        articles=articles.join(doomed_articles, "url_canonical", "left_anti"),
        sightings=sightings.join(deleted, "feed_id", "left_anti").join(
            doomed_articles, "url_canonical", "left_anti"
        ),
    )
