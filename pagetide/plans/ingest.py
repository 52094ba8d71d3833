"""The ingestion job: a log of responses to articles, sightings and assessed runs.

A failing feed never stops the others: failure is a column of its run. Responses, parsed and
normalized in one pass over the log, are written once to the shared folder and read back, because
several aggregations follow and each would otherwise parse and clean every document again. Which
responses count is decided on narrow rows; their texts stay where they were written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.operators.observe import (
    OBSERVED,
    TEXTS,
    contents,
    first_in_page,
    fold_sightings,
    packed,
    run_counts,
    summarize,
    unpacked,
    with_pieces,
)
from pagetide.operators.saturation import (
    assess_gaps,
    demote_degenerate,
    newly_sighted_maximum,
    page_facts,
    previous_maximum,
)
from pagetide.operators.sequences import DAY, time_segment
from pagetide.session import require_zoned, stage
from pagetide.sources.fetchlog import classify_runs, is_empty, unknown_feed_runs
from pagetide.sources.pages import explode_entries, normalize_entries, parse_documents


@dataclass(frozen=True)
class Known:
    """What earlier batches stored: first observations per URL, feed pairs, feed maxima."""

    articles: DataFrame  # url_canonical, published_at, date_source
    sightings: DataFrame  # url_canonical, feed_id
    maxima: DataFrame  # feed_id, max_published


@dataclass(frozen=True)
class Landed:
    """A batch as it was parsed and normalized, before it is held against what is known."""

    log: DataFrame
    feeds: DataFrame
    pages: DataFrame
    responses: DataFrame  # every entry of every response, with its texts
    entries: DataFrame  # those of pages that count, without texts; rejected ones included
    usable: DataFrame  # OBSERVED without texts


@dataclass(frozen=True)
class Ingested:
    entries: DataFrame
    segments: DataFrame  # without texts
    contents: DataFrame  # url_canonical, seq, texts
    sightings: DataFrame
    runs: DataFrame
    maxima: DataFrame
    unknown: DataFrame  # runs of feeds that are not declared
    pieces: DataFrame  # usable observations, and the columns to place them by
    placed: tuple[str, ...]


def read_responses(log: DataFrame) -> DataFrame:
    """One row per entry of each logged response, normalized; one without entry where there is none.

    Documents are parsed and their entries cleaned where the log is read, in one pass; neither
    bodies nor items nor texts move. What a run's outcome needs of its response is on each row.
    """
    served = log.withColumn("is_empty", is_empty()).withColumn(
        "body", F.when(F.col("http_status") == 200, F.col("body"))
    )
    entries = normalize_entries(explode_entries(parse_documents(served), every_page=True))
    # Runs are ordered by time, then by position of the feed in its batch.
    return entries.withColumn(
        "seq", F.struct("fetched_at", "feed_pos", "feed_id", "entry_pos", "run_id", "attempt")
    )


def fetched_pages(responses: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row per run of a known feed, with what its document is worth where there is one."""
    log = responses.filter(F.coalesce("entry_pos", F.lit(0)) == 0)
    outcomes = classify_runs(log, feeds)
    documents = log.filter(F.col("http_status") == 200).select("feed_id", "run_id", "attempt", "parse_error", "warning")
    pages = outcomes.join(documents, ["feed_id", "run_id", "attempt"], "left")
    failed = (F.col("status") == "ok") & F.col("parse_error").isNotNull()
    return pages.withColumn(
        "error_message", F.when(failed, F.col("parse_error")).otherwise(F.col("error_message"))
    ).withColumn("status", F.when(failed, "error").otherwise(F.col("status")))


def observation_log(responses: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries of the responses that decided their runs, without texts, in total order of `seq`."""
    counted = pages.filter(F.col("status") == "ok").select("feed_id", "run_id", "attempt").distinct()
    entries = responses.filter(F.col("entry_pos").isNotNull() & (F.col("http_status") == 200))
    return (
        entries.select(*(c for c in OBSERVED if c not in (*TEXTS, "seen_at")), "attempt", "fetched_at", "reject_reason")
        .withColumn("seen_at", F.col("fetched_at"))
        .join(counted, ["feed_id", "run_id", "attempt"], "left_semi")
    )


def assessed_runs(pages: DataFrame, entries: DataFrame, known: Known | None = None) -> tuple[DataFrame, DataFrame]:
    """Run rows with counts and gap verdict, and the per-run maxima of newly sighted dates."""
    usable = entries.filter(F.col("url_canonical").isNotNull())
    sighted = usable.groupBy("url_canonical", "feed_id").agg(F.min_by("run_id", "seq").alias("run_id"))
    frozen = usable.groupBy("url_canonical").agg(
        F.min_by(F.struct("published_at", "date_source"), "seq").alias("first")
    ).select("url_canonical", "first.*")
    known_urls = None
    if known is not None:
        sighted = sighted.join(known.sightings, ["url_canonical", "feed_id"], "left_anti")
        stored = known.articles.select(
            "url_canonical",
            F.struct("published_at", "date_source").alias("stored"),
        )
        # An article keeps the date of its first observation of all, maybe batches ago.
        frozen = frozen.join(stored, "url_canonical", "left").select(
            "url_canonical",
            F.coalesce("stored.published_at", "published_at").alias("published_at"),
            F.coalesce("stored.date_source", "date_source").alias("date_source"),
        )
        known_urls = known.articles.select("url_canonical")
    maxima = newly_sighted_maximum(sighted, frozen)

    keys = ["feed_id", "run_id"]
    skipped = entries.filter(F.col("url_canonical").isNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_skipped")
    )
    joined = (
        pages.join(page_facts(usable, *keys), keys, "left")
        .join(run_counts(usable, known_urls), keys, "left")
        .join(skipped, keys, "left")
        .withColumn("n_new", F.coalesce("n_new", F.lit(0)))
        .withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
        .withColumn("day", time_segment(F.col("started_at"), DAY))
        .withColumn("run_order", F.struct("started_at", "run_id"))
    )
    before = previous_maximum(
        joined, maxima, order="run_order", segment="day", known=None if known is None else known.maxima
    )
    assessed = assess_gaps(before)
    warnings = F.concat_ws(
        " | ",
        F.col("warning"),
        F.when(F.col("n_skipped") > 0, F.concat(F.col("n_skipped").cast("string"), F.lit(" lien(s) inutilisable(s)"))),
    )
    ok = F.col("status") == "ok"
    runs = assessed.select(
        "feed_id",
        "run_id",
        "slug",
        "started_at",
        "finished_at",
        "status",
        "http_status",
        F.col("n_new").cast("int").alias("n_new"),
        F.col("n_seen").cast("int").alias("n_seen"),
        F.when(ok, F.nullif(warnings, F.lit(""))).otherwise(F.col("error_message")).alias("error_message"),
        "gap_status",
        "gap_reason",
        "oldest_in_page",
        # Runs that fetched nothing were not assessed: both bounds stay empty.
        F.when(ok, F.col("prev_max_published")).alias("prev_max_published"),
        "etag",
        "last_modified",
    )
    return runs, maxima


def land(log: DataFrame, feeds: DataFrame, workspace: str) -> Landed:
    """Parse and normalize a log of responses; `workspace` is a folder all executors share."""
    require_zoned(log, "started_at", "fetched_at")
    responses = unpacked(stage(packed(read_responses(log)), f"{workspace}/responses"))
    pages = stage(fetched_pages(responses, feeds), f"{workspace}/pages")
    entries = stage(observation_log(responses, pages), f"{workspace}/entries")
    demoted = demote_degenerate(
        entries.filter(F.col("url_canonical").isNotNull()), "feed_id", "run_id"
    )
    everything = demoted.unionByName(entries.filter(F.col("url_canonical").isNull()))
    usable = demoted.select(*(c for c in OBSERVED if c not in TEXTS))
    return Landed(log, feeds, pages, responses, everything, usable)


def settle(landed: Landed, known: Known | None = None) -> Ingested:
    """What a batch adds to what is known."""
    pieces, placed = with_pieces(landed.usable)
    deduplicated = first_in_page(pieces, placed)
    runs, maxima = assessed_runs(landed.pages, landed.entries, known)
    return Ingested(
        entries=landed.entries,
        segments=summarize(deduplicated, placed),
        contents=contents(landed.responses.filter(F.col("url_canonical").isNotNull())),
        # Of duplicates on a page only the first is stored, so its guid and URL are kept.
        sightings=fold_sightings(deduplicated),
        runs=runs,
        maxima=maxima.groupBy("feed_id").agg(F.max("run_max").alias("max_published")),
        unknown=unknown_feed_runs(landed.log, landed.feeds),
        pieces=pieces,
        placed=placed,
    )


def ingest(log: DataFrame, feeds: DataFrame, workspace: str, known: Known | None = None) -> Ingested:
    """Ingest a log of responses in one go."""
    return settle(land(log, feeds, workspace), known)
