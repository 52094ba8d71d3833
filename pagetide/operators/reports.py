"""Article listing and feed health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.dates import absolute_date, datetime_attr, relative_date
from pagetide.functions.labels import (
    error_kind,
    error_kind_label,
    gap_label,
    lang_label,
    source_label,
    topic_label,
)
from pagetide.functions.markup import excerpt
from pagetide.model import LANGS, TOPICS
from pagetide.operators.paging import from_position, newest_first

# Page size, and the topics a topic filter admits.
PAGE_SIZE = 50
TOPIC_EXPANSION = {"ai": ("ai", "both"), "sec": ("sec", "both"), "both": ("both",)}


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    info: DataFrame


def select_articles(
    articles: DataFrame, feeds: DataFrame, *, lang: str | None = None, topic: str | None = None
) -> DataFrame:
    """Articles with the feed that saw them first, under the listing's filters.

    The feed filter is applied to the small side before the join; whether that side is
    broadcast is left to the planner, which knows its size.
    """
    if lang is not None and lang not in LANGS:
        raise ValueError(f"lang must be one of {LANGS}")
    if topic is not None and topic not in TOPICS:
        raise ValueError(f"topic must be one of {TOPICS}")
    chosen = feeds.select("feed_id", "slug", "name", "lang", "topic", "source_type")
    if lang:
        chosen = chosen.filter(F.col("lang") == lang)
    if topic:
        chosen = chosen.filter(F.col("topic").isin(*TOPIC_EXPANSION[topic]))
    return articles.join(chosen, articles["first_feed_id"] == chosen["feed_id"]).drop("feed_id")


def _top(rows: DataFrame, size: int, tie: str, skipped: int = 0) -> DataFrame:
    ordered = rows.orderBy(F.col("published_at").desc_nulls_last(), F.col(tie).desc_nulls_last())
    return (ordered.offset(skipped) if skipped else ordered).limit(size)


def list_articles(
    articles: DataFrame,
    feeds: DataFrame,
    *,
    lang: str | None = None,
    topic: str | None = None,
    page: int = 1,
    page_size: int = PAGE_SIZE,
    tie: str = "first_seq",
) -> Page:
    """A page of the listing, newest first, ties by arrival; pages below 1 mean the first.

    Rows without a date come last. The first page is a lazy top; where a later one begins is
    counted, in a few small jobs, so no task holds more than a page.
    """
    page = max(1, page)
    chosen = select_articles(articles, feeds, lang=lang, topic=topic)
    following, skipped = chosen, 0
    if page > 1:
        order = newest_first(chosen, "published_at", tie)
        following, skipped = from_position(chosen, order, (page - 1) * page_size)
    rows = _top(following, page_size, tie, skipped)
    return Page(rows=rows, info=page_info(chosen, page, page_size))


def articles_after(
    articles: DataFrame, published_at: Column, tie_value: Column, *, size: int = PAGE_SIZE, tie: str = "first_seq"
) -> DataFrame:
    """The page following a known last row, without counting or skipping; its date may be NULL."""
    later = (
        (F.col("published_at") < published_at)
        | (published_at.isNotNull() & F.col("published_at").isNull())
        | (F.col("published_at").eqNullSafe(published_at) & (F.col(tie) < tie_value))
    )
    return _top(articles.filter(later), size, tie)


def page_info(chosen: DataFrame, page: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row: total, pages, has_previous, has_next."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / page_size))
    return chosen.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).cast("long").alias("page"),
        pages.cast("long").alias("pages"),
        F.lit(page > 1).alias("has_previous"),
        (F.lit(page) < pages).alias("has_next"),
    )


def listing_table(rows: DataFrame, *, now: Column) -> DataFrame:
    """Displayed columns of a listing page."""
    published = F.col("published_at")
    return rows.select(
        "url_canonical",
        "title",
        F.col("name").alias("source"),
        datetime_attr(published).alias("published_attr"),
        absolute_date(published).alias("published_absolute"),
        relative_date(published, now).alias("published_relative"),
        (F.col("date_source") == "fetched").alias("is_fallback"),
        lang_label(F.col("lang")).alias("lang"),
        topic_label(F.col("topic")).alias("topic"),
        excerpt(F.col("summary_clean")).alias("summary"),
    )


def newest_article(articles: DataFrame) -> DataFrame:
    return articles.agg(F.max("published_at").alias("latest_published_at"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Runs at each feed's greatest start time; equal times keep all their runs.

    The greatest time is a combinable aggregate; the runs are then looked up by equality.
    """
    latest = runs.groupBy("feed_id").agg(F.max("started_at").alias("started_at"))
    return runs.join(latest, ["feed_id", "started_at"], "left_semi")


def feed_health(feeds: DataFrame, runs: DataFrame, articles: DataFrame) -> DataFrame:
    """Last run of every feed, also of those that never ran, with the articles it saw first."""
    counts = articles.groupBy(F.col("first_feed_id").alias("feed_id")).agg(
        F.count(F.lit(1)).alias("n_articles")
    )
    last = latest_runs(runs).select(
        "feed_id",
        "started_at",
        "status",
        "http_status",
        "n_new",
        "n_seen",
        "error_message",
        "gap_status",
        "oldest_in_page",
        "prev_max_published",
    )
    failed = F.col("status") == "error"
    return (
        feeds.join(last, "feed_id", "left")
        .join(counts, "feed_id", "left")
        .withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))
        .withColumn("error_kind", F.when(failed, error_kind(F.col("error_message"))).otherwise(""))
    )


def health_table(health: DataFrame, *, now: Column) -> DataFrame:
    """Displayed form of feed health: active feeds first, then by slug."""
    dash = F.lit("—")
    return health.select(
        "slug",
        "name",
        "is_active",
        lang_label(F.col("lang")).alias("lang"),
        topic_label(F.col("topic")).alias("topic"),
        source_label(F.col("source_type")).alias("source_type"),
        F.coalesce(relative_date(F.col("started_at"), now), F.lit("jamais")).alias("last_run"),
        F.coalesce("status", dash).alias("status"),
        F.when(F.col("error_kind") != "", error_kind_label(F.col("error_message")))
        .otherwise("")
        .alias("error_kind_label"),
        F.when(F.col("started_at").isNotNull(), gap_label(F.col("gap_status")))
        .otherwise(dash)
        .alias("coverage"),
        F.coalesce(F.col("http_status").cast("string"), dash).alias("http_status"),
        F.coalesce(F.col("n_new").cast("string"), dash).alias("n_new"),
        F.coalesce(F.col("n_seen").cast("string"), dash).alias("n_seen"),
        "n_articles",
        F.coalesce("error_message", F.lit("")).alias("message"),
    ).orderBy(F.col("is_active").desc(), "slug")


def run_summary(runs: DataFrame) -> DataFrame:
    """One row: runs, runs that did not fail, new articles, and the verdict of the batch.

    Verdict 0: at least one feed succeeded; 1: all failed; 2: nothing was ingested.
    """
    totals = runs.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("status") != "error").alias("n_ok"),
        F.coalesce(F.sum("n_new"), F.lit(0)).cast("long").alias("n_new"),
    )
    return totals.withColumn(
        "verdict", F.when(F.col("n_runs") == 0, 2).when(F.col("n_ok") == 0, 1).otherwise(0)
    )


def select_feed(feeds: DataFrame, slug: str) -> DataFrame:
    """The feed with this slug; an unknown slug is an error, as a run on it would do nothing."""
    chosen = feeds.filter(F.col("slug") == slug)
    if chosen.isEmpty():
        raise LookupError(f"unknown feed: {slug}")
    return chosen
