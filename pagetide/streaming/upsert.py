"""Incremental ingestion with Structured Streaming.

The state is what is known: articles, sightings and feed maxima, in buckets by URL or feed. A
batch folds its own observations as the batch job does, reads the buckets of its URLs and
feeds, merges, and writes these buckets anew. Articles name their content; the texts lie in a
table of their own, to which a batch adds those of the contents it brought. Runs are appended. Nothing is dropped as late: the
order that counts is the order of arrival, so there is no watermark.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagetide.operators.observe import (
    TEXTS,
    contents,
    first_in_page,
    fold_sightings,
    merge_articles,
    merge_sightings,
    narrow,
    packed,
    perhaps_of,
    sighting_rows,
    summarize,
    unpacked,
    with_pieces,
    with_texts,
)
from pagetide.plans.ingest import Known, land, settle, stage
from pagetide.sources.fetchlog import updated_feeds
from pagetide.streaming.buckets import ROWS, BucketTable
from pagetide.streaming.deltas import read_deltas, write_delta
from pagetide.files import finished

MAXIMA = T.StructType([T.StructField("feed_id", T.LongType()), T.StructField("max_published", T.TimestampType())])
URL = ("url_canonical",)
# Rows of a bucket of texts, which are wide.
TEXT_ROWS = 25_000


def _recorded(spark: SparkSession, state: str, table: str, schema: T.StructType | None) -> T.StructType:
    """The schema of a state table: the first batch records it beside the data."""
    folder = f"{state}/_schemas/{table}"
    if schema is not None and not finished(spark, folder):
        described = spark.createDataFrame([(schema.json(),)], "schema string")
        described.coalesce(1).write.mode("overwrite").text(folder)
    (row,) = spark.read.text(folder).collect()
    return T.StructType.fromJson(json.loads(row["value"]))


def _table(spark: SparkSession, state: str, name: str, schema: T.StructType | None = None) -> BucketTable:
    rows = TEXT_ROWS if name == "contents" else ROWS
    return BucketTable(spark, f"{state}/{name}", _recorded(spark, state, name, schema), URL, rows)


def _maxima(spark: SparkSession, state: str) -> BucketTable:
    return BucketTable(spark, f"{state}/maxima", MAXIMA, ("feed_id",))


def _run(
    stream: DataFrame, state: str, work: Callable[[DataFrame, int], None], *, available_now: bool
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{state}/_checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def updated_articles(stored: DataFrame, arrived: DataFrame, batch: int) -> DataFrame:
    """Stored articles after a batch that folds to `arrived` (articles without texts, `opening_hash`).

    A stored article keeps its origin. Its content changes if the batch changed it inside, or
    opened with another hash than the one stored. `content_batch` and `content_seq` name it.
    """
    new = arrived.select("url_canonical", F.struct(*(c for c in arrived.columns if c != "url_canonical")).alias("new"))
    old = stored.withColumn("__stored", F.lit(True))
    both = old.join(new.hint("shuffle_hash"), "url_canonical", "full_outer")
    came, there = F.col("new").isNotNull(), F.col("__stored").isNotNull()
    changed_inside = ~F.col("new.content_seq").eqNullSafe(F.col("new.first_seq"))
    differs = ~F.col("new.opening_hash").eqNullSafe(F.col("content_hash"))
    taken = came & (~there | changed_inside | differs)

    def first(name: str) -> Column:
        return F.when(there, F.col(name)).otherwise(F.col(f"new.{name}")).alias(name)

    def content(name: str, fresh: Column) -> Column:
        return F.when(taken, fresh).otherwise(F.col(name)).alias(name)

    return both.select(
        "url_canonical",
        *(first(c) for c in ("first_feed_id", "first_seq", "published_at", "date_source", "first_seen_at")),
        *(content(c, F.col(f"new.{c}")) for c in ("content_seq", "content_hash", "updated_at")),
        content("content_batch", F.lit(batch).cast("long")),
        F.coalesce("new.last_seen_at", "last_seen_at").alias("last_seen_at"),
        (F.coalesce("n_observations", F.lit(0)) + F.coalesce("new.n_observations", F.lit(0))).alias("n_observations"),
    )


def _folded(segments: DataFrame) -> DataFrame:
    """The batch's articles without texts, with the hash that each began with."""
    opened = segments.groupBy("url_canonical").agg(
        F.min_by(F.struct("opening.content_hash"), "segment").alias("__opened")
    )
    joined = merge_articles(segments).join(opened, "url_canonical")
    return joined.withColumn("opening_hash", F.col("__opened.content_hash")).drop("__opened")


def _article_schema(folded: DataFrame) -> T.StructType:
    kinds = {f.name: f.dataType for f in folded.schema} | {"content_batch": T.LongType()}
    names = (
        "url_canonical", "first_feed_id", "first_seq", "published_at", "date_source", "first_seen_at",
        "content_seq", "content_hash", "updated_at", "content_batch", "last_seen_at", "n_observations",
    )
    return T.StructType([T.StructField(name, kinds[name]) for name in names])


def _store_folded(
    state: str, batch: int, segments: DataFrame, texts: DataFrame, pieces: DataFrame, placed: tuple[str, ...]
) -> None:
    """Merge a batch into the buckets of its URLs. `segments` must be staged: they are read often."""
    spark = segments.sparkSession
    arrived = _folded(segments)
    articles = _table(spark, state, "articles", _article_schema(arrived))
    version, numbers = articles.touched(batch, segments)
    updated = updated_articles(articles.read(version, numbers), arrived, batch)
    updated = stage(updated, f"{state}/_work/batch={batch}/articles")
    # texts first: no version of the articles names a content that is not there
    _store_contents(state, batch, segments, updated, texts)
    articles.write(batch, version, numbers, updated)
    _store_sightings(state, batch, segments, pieces, placed)


def _store_contents(state: str, batch: int, segments: DataFrame, updated: DataFrame, texts: DataFrame) -> None:
    """Add the texts of the contents that a batch brought, as pieces of the buckets of its URLs.

    They travel once, to their buckets. A few that no article names may be among them; readers join
    by name. When the pieces of a bucket are merged, only texts that articles still name are kept.
    """
    spark = segments.sparkSession
    brought = updated.filter(F.col("content_batch") == batch).select("url_canonical", "content_seq")
    fresh = packed(perhaps_of(brought, texts)).withColumn("content_batch", F.lit(batch).cast("long"))
    table = _table(spark, state, "contents", fresh.schema)
    version, numbers = table.touched(batch, segments)
    full = version.many(numbers)
    if full:
        named = updated.select("url_canonical", F.col("content_seq").alias("seq"), "content_batch")
        stored = table.read(version, full).join(named, ["url_canonical", "seq", "content_batch"], "left_semi")
        fresh = fresh.unionByName(stored)
    table.write(batch, version, numbers, fresh, added=numbers - full)


def _store_sightings(
    state: str, batch: int, segments: DataFrame, pieces: DataFrame, placed: tuple[str, ...]
) -> None:
    """Add the sightings of a batch as pieces of the buckets of its URLs, which `segments` has too.

    Of duplicates on a page only the first is stored, so its guid and URL are kept. Unless crowded
    URLs are cut, rows are placed by bucket once, for the pages, the fold and the folders.
    """
    spark = segments.sparkSession
    pairs = _table(spark, state, "sightings", fold_sightings(pieces).schema)
    version, numbers = pairs.touched(batch, segments)
    if "segment" in placed:
        sightings = fold_sightings(first_in_page(pieces, placed)).withColumn("bucket", pairs.number(version))
        sightings = sightings.repartition("bucket")
    else:
        bucketed = pieces.withColumn("bucket", pairs.number(version))
        sightings = fold_sightings(first_in_page(bucketed, ("bucket",)), "bucket")
    full = version.many(numbers)
    if full:
        stored = pairs.read(version, full).withColumn("bucket", pairs.number(version))
        sightings = merge_sightings(stored.unionByName(sightings).repartition("bucket"), "bucket")
    pairs.write(batch, version, numbers, sightings, added=numbers - full)


def fold_available(
    spark: SparkSession, landed: str, schema: T.StructType, state: str, segment: Column | None = None
) -> None:
    """Fold the files of an observation log that arrived since the last call."""

    def work(batch: DataFrame, batch_id: int) -> None:
        work_folder = f"{state}/_work/batch={batch_id}"
        pieces, placed = with_pieces(narrow(batch), segment)
        segments = stage(summarize(first_in_page(pieces, placed), placed), f"{work_folder}/segments")
        _store_folded(state, batch_id, segments, contents(batch), pieces, placed)

    stream = spark.readStream.schema(schema).parquet(landed)
    _run(stream, state, work, available_now=True).awaitTermination()


def stored_articles(spark: SparkSession, state: str) -> DataFrame:
    """Articles over all batches, in order of arrival."""
    articles, contents_of = _table(spark, state, "articles"), _table(spark, state, "contents")
    last = max(articles.versions(), default=-1)
    texts = unpacked(contents_of.read(contents_of.version(last)))
    found = with_texts(articles.read(articles.version(last)), texts, "content_batch")
    return found.select(
        "url_canonical", "first_feed_id", "first_seq", "published_at", "date_source", "first_seen_at",
        *TEXTS, "content_hash", "updated_at", "last_seen_at", "n_observations",
    )


def stored_sightings(spark: SparkSession, state: str) -> DataFrame:
    return sighting_rows(merge_sightings(_table(spark, state, "sightings").current()))


def stored_runs(spark: SparkSession, state: str) -> DataFrame:
    return read_deltas(spark, state, "runs", _recorded(spark, state, "runs", None))


def stored_feeds(spark: SparkSession, state: str, feeds: DataFrame) -> DataFrame:
    """Feeds with the validators of their runs so far."""
    return updated_feeds(feeds, stored_runs(spark, state))


def known_before(spark: SparkSession, state: str, batch: int, urls: DataFrame, feed_ids: DataFrame) -> Known | None:
    """What earlier batches stored of these URLs and feeds; columns the verdicts need, and no texts."""
    if not batch:
        return None
    parts = []
    for table, keys in (
        (_table(spark, state, "articles"), urls),
        (_table(spark, state, "sightings"), urls),
        (_maxima(spark, state), feed_ids),
    ):
        parts.append(table.read(*table.touched(batch, keys)))
    articles, sightings, maxima = parts
    return Known(
        articles=articles.select("url_canonical", "published_at", "date_source"),
        sightings=sightings.select("url_canonical", "feed_id"),
        maxima=maxima,
    )


def ingest_stream(
    log: DataFrame, feeds: DataFrame, state: str, *, available_now: bool = True
) -> StreamingQuery:
    """Ingest a streamed fetch log. One query with one checkpoint is the single writer."""
    spark = log.sparkSession

    def work(batch: DataFrame, batch_id: int) -> None:
        folder = f"{state}/_work/batch={batch_id}"
        landed = land(batch, feeds, folder)
        urls, feed_ids = landed.usable.select("url_canonical"), landed.pages.select("feed_id")
        known = known_before(spark, state, batch_id, urls, feed_ids)
        done = settle(landed, known)
        runs = stage(done.runs, f"{folder}/runs")
        _recorded(spark, state, "runs", runs.schema)
        write_delta(runs, state, "runs", batch_id)
        segments = stage(done.segments, f"{folder}/segments")
        _store_folded(state, batch_id, segments, done.contents, done.pieces, done.placed)
        maxima = _maxima(spark, state)
        version, numbers = maxima.touched(batch_id, feed_ids)
        merged = maxima.read(version, numbers).unionByName(done.maxima)
        maxima.write(
            batch_id, version, numbers, merged.groupBy("feed_id").agg(F.max("max_published").alias("max_published"))
        )

    return _run(log, state, work, available_now=available_now)


def sweep(spark: SparkSession, state: str, keep: int) -> None:
    """Remove what only versions before batch `keep` need; that batch itself must be finished.

    Run it between triggers or from the stream's driver; the stream goes on.
    """
    for name in ("articles", "contents", "sightings"):
        _table(spark, state, name).sweep(keep)
    _maxima(spark, state).sweep(keep)
