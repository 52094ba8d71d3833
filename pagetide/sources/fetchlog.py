"""Log of received responses: reading, and the outcome of each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.model import FETCH_LOG

# The statuses worth another attempt.
RETRYABLE_STATUSES = (429, 500, 502, 503, 504)


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCH_LOG).parquet(path)


def stream_fetch_log(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FETCH_LOG)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _decides() -> Column:
    """Does this attempt end its run, wherever it stands? Failing all, the last one does."""
    retried = F.col("http_status").isin(*RETRYABLE_STATUSES)
    return F.col("transport_error").isNull() & ~F.coalesce(retried, F.lit(False))


def is_empty() -> Column:
    """Has the response no content?"""
    return F.coalesce(F.octet_length("body") == 0, F.lit(True))


def classify_runs(log: DataFrame, slugs: DataFrame) -> DataFrame:
    """One row per run: status, http_status, error_message, validators and deciding attempt.

    `slugs` has (feed_id, slug); runs of other feeds are those of `unknown_feed_runs`. A run has
    as many attempts as were logged. An answer without status is an error. Bodies stay out of the aggregation: only their emptiness is
    read, so no document is shuffled to classify its run. A log that has `is_empty` needs no bodies.
    """
    attempts = log if "is_empty" in log.columns else log.withColumn("is_empty", is_empty())
    answer = F.struct(
        "attempt", "http_status", "transport_error", "is_empty", "etag", "last_modified", "fetched_at"
    )
    decided = attempts.groupBy("feed_id", "run_id").agg(
        F.min("feed_pos").alias("feed_pos"),
        F.min("started_at").alias("started_at"),
        F.max("fetched_at").alias("finished_at"),
        F.coalesce(
            F.min_by(answer, F.when(_decides(), F.col("attempt"))), F.max_by(answer, "attempt")
        ).alias("answer"),
    )
    code, slug = F.col("answer.http_status"), F.col("slug")
    # A run that ends in a transport error has no response, whatever came before.
    lost = F.col("answer.transport_error").isNotNull()
    message = (
        F.when(lost, F.concat(F.lit("FetchError: "), slug, F.lit(" : "), F.col("answer.transport_error")))
        .when(code.isNull(), F.concat(F.lit("FetchError: "), slug, F.lit(" : reponse sans statut")))
        .when(code == 304, None)
        .when(code != 200, F.concat(F.lit("FetchError: "), slug, F.lit(" : HTTP "), code.cast("string")))
        .when(
            F.col("answer.is_empty"), F.concat(F.lit("FetchError: "), slug, F.lit(" : HTTP 200 sans contenu"))
        )
    )
    return decided.join(slugs.select("feed_id", "slug"), "feed_id").select(
        "feed_id",
        "run_id",
        "feed_pos",
        "slug",
        "started_at",
        "finished_at",
        F.col("answer.attempt").alias("attempt"),
        F.when(~lost, code).cast("short").alias("http_status"),
        F.when(message.isNotNull(), "error").when(code == 304, "not_modified").otherwise("ok").alias("status"),
        message.alias("error_message"),
        F.col("answer.etag").alias("etag"),
        F.col("answer.last_modified").alias("last_modified"),
        F.col("answer.fetched_at").alias("fetched_at"),
    )


def unknown_feed_runs(log: DataFrame, feeds: DataFrame) -> DataFrame:
    """Runs whose feed is not declared: what the log holds of them, as they cannot be ingested."""
    return (
        log.join(feeds.select("feed_id"), "feed_id", "left_anti")
        .groupBy("feed_id", "run_id")
        .agg(
            F.count(F.lit(1)).alias("n_attempts"),
            F.min("started_at").alias("started_at"),
            F.max("fetched_at").alias("finished_at"),
        )
    )


def updated_feeds(feeds: DataFrame, runs: DataFrame) -> DataFrame:
    """The feed table after these runs: validators and `updated_at` of each feed's last success."""
    moved = (
        runs.filter(F.col("status") == "ok")
        .groupBy("feed_id")
        .agg(
            F.max_by(
                F.struct("etag", "last_modified", F.col("finished_at").alias("updated_at")),
                F.struct("started_at", "run_id"),
            ).alias("__success")
        )
    )

    def after(column: str) -> Column:
        new = F.col(f"__success.{column}")
        return F.when(F.col("__success").isNotNull(), new).otherwise(F.col(column)).alias(column)

    governed = ("etag", "last_modified", "updated_at")
    return feeds.join(moved, "feed_id", "left").select(
        *(after(c) if c in governed else F.col(c) for c in feeds.columns)
    )


def current_validators(runs: DataFrame) -> DataFrame:
    """Validators each feed's next request must send: those of its last successful run.

    A success without headers clears them; unchanged pages and errors leave them alone.
    """
    return (
        runs.filter(F.col("status") == "ok")
        .groupBy("feed_id")
        .agg(F.max_by(F.struct("etag", "last_modified"), F.struct("started_at", "run_id")).alias("v"))
        .select("feed_id", "v.etag", "v.last_modified")
    )
