"""Folding a log of observed entries into articles and per-feed sightings.

An observation log has the columns of `OBSERVED`: one row per entry of a fetched page, in the
total order of `seq`. Reading it in that order,

* the first entry of a page wins among entries of the page with the same canonical URL;
* the first observation of a URL fixes its feed, publication date and first-seen time;
* an observation whose hash differs from the one before replaces the article's content;
* the last observation gives the last-seen time.

The log is folded in two steps, so that one URL relayed by every feed for years never becomes
one task: `summarize` reduces each (URL, time segment) to a row, `merge_segments` joins the
segments of a URL. A streaming batch is just one more segment. Only URLs in crowded buckets are
cut into segments (`with_pieces`); all others are folded where one shuffle by URL puts them.

Which observation gives an article its content is decided on hashes and positions alone. The
texts are fetched at the end, by one join with the observations that won, so no text is sorted
or aggregated, and those of all other observations are read once and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.operators.sequences import FULL_SLICES, SEGMENT_ROWS, time_segment
from pagetide.session import require_zoned, stage

# Seconds of a segment: short enough that a URL relayed by every feed stays small within one,
# long enough that a URL seen without pause has some fifty thousand segments a year.
SEGMENT_SECONDS = 600
# Buckets in which the rows of URLs are counted, to find those that need segments.
URL_BUCKETS = 1 << 14
PLACED = ("url_canonical", "segment")
# Words of the bitmap of observations that won: 8 MB.
BITMAP_WORDS = 1 << 20

TEXTS = ("title", "author", "raw_summary", "summary_clean")
REVISABLE = (*TEXTS, "content_hash")
OBSERVED = (
    "feed_id",
    "run_id",
    "seq",
    "seen_at",
    "url_canonical",
    "url_original",
    "guid",
    *REVISABLE,
    "published_at",
    "date_source",
)

# What the fold decides on.
FOLDED = ("feed_id", "run_id", "seq", "seen_at", "url_canonical", "content_hash", "published_at", "date_source")


def with_segment(log: DataFrame, segment: Column | None = None) -> DataFrame:
    """Add the time segment; it must be the same for all entries of a page and grow with `seq`."""
    require_zoned(log, "seen_at", "published_at")
    return log.withColumn("segment", time_segment(F.col("seen_at"), SEGMENT_SECONDS) if segment is None else segment)


def with_pieces(
    log: DataFrame, segment: Column | None = None, *, rows: int = SEGMENT_ROWS
) -> tuple[DataFrame, tuple[str, ...]]:
    """The log with a time segment only where a URL may need it, and the columns to place it by.

    URLs are counted in buckets by hash. Where a bucket holds over `rows`, and over a thousandth of
    all, its URLs are cut into segments; every other URL is one segment. At most `FULL_SLICES`
    buckets can hold that much, and the driver sees their numbers alone. Where there is none, rows
    are placed by URL, and all that is done for a URL needs no other shuffle. The log is read once
    more for its URLs, so it should be one that is stored.
    """
    bucket = F.pmod(F.xxhash64("url_canonical"), F.lit(URL_BUCKETS))
    counts = log.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # one row a bucket: the window is small
    share = F.sum("n").over(W.partitionBy()) / FULL_SLICES
    full = counts.withColumn("share", share).filter((F.col("n") > rows) & (F.col("n") > F.col("share")))
    crowded = [row["bucket"] for row in full.select("bucket").collect()]
    if not crowded:
        return log.withColumn("segment", F.lit(0).cast("long")), ("url_canonical",)
    cut = with_segment(log, segment)
    return cut.withColumn("segment", F.when(bucket.isin(crowded), F.col("segment")).otherwise(F.lit(0))), PLACED


def first_in_page(log: DataFrame, placed: tuple[str, ...] = PLACED) -> DataFrame:
    """Keep the first entry per canonical URL of each page."""
    keys = ("url_canonical", "feed_id", "run_id", "segment")
    page = W.partitionBy(*(c for c in placed if c not in keys), *keys).orderBy("seq")
    # Placed by URL and segment, the rows serve this window and those of `summarize`.
    return (
        log.repartition(*placed)
        .withColumn("__rank", F.row_number().over(page))
        .filter("__rank = 1")
        .drop("__rank")
    )


def narrow(log: DataFrame) -> DataFrame:
    """The log without its texts: all that decides which observations win."""
    return log.drop(*TEXTS)


def contents(log: DataFrame) -> DataFrame:
    """(url_canonical, seq, texts): what an observation would give its article."""
    return log.select("url_canonical", "seq", *TEXTS)


def packed(texts: DataFrame) -> DataFrame:
    """For storage: a summary that cleaning left as it was is stored once."""
    plain = F.col("raw_summary").eqNullSafe(F.col("summary_clean"))
    return texts.withColumn("summary_is_plain", plain).withColumn(
        "summary_clean", F.when(~F.col("summary_is_plain"), F.col("summary_clean"))
    )


def unpacked(texts: DataFrame) -> DataFrame:
    """What `packed` was given."""
    clean = F.when(F.col("summary_is_plain"), F.col("raw_summary")).otherwise(F.col("summary_clean"))
    return texts.withColumn("summary_clean", clean).drop("summary_is_plain")


def _content() -> Column:
    """The place of a content: the observation that brought it, and its hash."""
    return F.struct("seq", "content_hash", "seen_at")


def summarize(log: DataFrame, placed: tuple[str, ...] = PLACED) -> DataFrame:
    """One row per (URL, segment) of a log deduplicated by page; per URL where it was placed by URL.

    `opening` is the first observation, `revision` the last one that changed the content inside
    the segment, `closing` what the segment leaves behind.
    """
    order = W.partitionBy(*placed).orderBy("seq")
    previous = F.lag(F.struct("content_hash")).over(order)
    changed = previous.isNotNull() & ~F.col("content_hash").eqNullSafe(previous["content_hash"])
    first = ("feed_id", "run_id", "seq", "published_at", "date_source", "content_hash", "seen_at")
    summary = (
        narrow(log)
        .withColumn("__changed", changed)
        .groupBy(*placed)
        .agg(
            F.min_by(F.struct(*first), "seq").alias("opening"),
            F.max_by(_content(), F.when(F.col("__changed"), F.col("seq"))).alias("revision"),
            F.max_by(F.struct("content_hash", "seen_at"), "seq").alias("closing"),
            F.count(F.lit(1)).alias("n_observations"),
        )
    )
    return summary if "segment" in placed else summary.withColumn("segment", F.lit(0).cast("long"))


def merge_segments(segments: DataFrame, *order: str) -> DataFrame:
    """One segment row per URL, from its segment rows taken in `order` (default: by segment).

    A segment changed the content if it did so inside, or by opening with another hash than
    the segment before left behind.
    """
    position = F.struct(*(order or ("segment",)))
    before = F.lag(F.struct("closing")).over(W.partitionBy("url_canonical").orderBy(position))
    differs = before.isNotNull() & ~F.col("opening.content_hash").eqNullSafe(before["closing"]["content_hash"])
    change = F.coalesce("revision", F.when(differs, opening_content()))
    return (
        segments.withColumn("__position", position)
        .withColumn("__change", change)
        .groupBy("url_canonical")
        .agg(
            F.min_by("segment", "__position").alias("segment"),
            F.min_by("opening", "__position").alias("opening"),
            F.max_by("__change", F.when(F.col("__change").isNotNull(), F.col("__position"))).alias("revision"),
            F.max_by("closing", "__position").alias("closing"),
            F.sum("n_observations").alias("n_observations"),
        )
    )


def opening_content() -> Column:
    return F.struct("opening.seq", "opening.content_hash", "opening.seen_at")


def merge_articles(segments: DataFrame, *order: str) -> DataFrame:
    """Articles without texts, from the segment rows of each URL; `content_seq` says whose texts."""
    merged = merge_segments(segments, *order).withColumn("content", F.coalesce("revision", opening_content()))
    return merged.select(
        "url_canonical",
        F.col("opening.feed_id").alias("first_feed_id"),
        F.col("opening.seq").alias("first_seq"),
        F.col("content.seq").alias("content_seq"),
        F.col("content.content_hash").alias("content_hash"),
        F.col("opening.published_at").alias("published_at"),
        F.col("opening.date_source").alias("date_source"),
        F.col("opening.seen_at").alias("first_seen_at"),
        F.col("closing.seen_at").alias("last_seen_at"),
        F.col("content.seen_at").alias("updated_at"),
        "n_observations",
    )


def with_texts(articles: DataFrame, texts: DataFrame, *also: str) -> DataFrame:
    """Give articles the texts of the observation that `content_seq` names, and these columns, if any.

    The articles, narrow and one a URL, are the side that is held in a hash table, partition by
    partition; the texts stream past it and are not sorted.
    """
    keys = ("url_canonical", "content_seq", *also)
    winners = articles.hint("shuffle_hash")
    found = texts.withColumnRenamed("seq", "content_seq").join(winners, list(keys))
    return found.select(*(c for c in articles.columns if c not in keys[1:]), *TEXTS)


def perhaps_of(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that may be those of these stored articles, by a bitmap of fixed size; no text is moved.

    No text of theirs is missing, and few others are there.
    """
    word, bit = _place("content_seq")
    bits = articles.groupBy(word.alias("__of")).agg(F.bit_or(bit).alias("__bits"))
    word, bit = _place("seq")
    met = (word == F.col("__of")) & (F.col("__bits").bitwiseAND(bit) != 0)
    return texts.join(F.broadcast(bits), met, "left_semi")


def with_stored_texts(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """`with_texts` for articles that are stored: a bitmap of them stops other texts before they travel."""
    return with_texts(articles, perhaps_of(articles, texts))


def _place(seq: str) -> tuple[Column, Column]:
    """Word and bit of an observation in the bitmap."""
    place = F.xxhash64("url_canonical", seq)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return F.pmod(F.shiftright(place, 6), F.lit(BITMAP_WORDS)), bit


def fold_articles(
    log: DataFrame,
    segment: Column | None = None,
    *,
    texts: bool = True,
    workspace: str | None = None,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Articles of a whole observation log.

    The log is read for its URLs, for the fold and for texts, so it should be one that is stored.
    With a `workspace`, a folder all executors share, the articles without texts are stored there.
    """
    require_zoned(log, "seen_at", "published_at")
    pieces, placed = with_pieces(log.select(*FOLDED), segment, rows=rows)
    articles = merge_articles(summarize(first_in_page(pieces, placed), placed))
    if not texts:
        return articles
    if workspace:
        return with_stored_texts(stage(articles, workspace), contents(log))
    return with_texts(articles, contents(log))


def fold_sightings(log: DataFrame, *placed: str) -> DataFrame:
    """Per (URL, feed): first and last seen; guid and original URL of the last, even if NULL.

    Columns that follow from the URL, by which the log is placed, are kept.
    """
    return (
        log.groupBy(*placed, "url_canonical", "feed_id")
        .agg(
            F.min_by(F.struct("run_id", "seen_at", "seq"), "seq").alias("first"),
            F.max_by(F.struct("guid", "url_original", "seen_at", "seq"), "seq").alias("last"),
        )
    )


def sighting_rows(folded: DataFrame) -> DataFrame:
    """Observation table columns of folded sightings."""
    return folded.select(
        "url_canonical",
        "feed_id",
        F.col("last.guid").alias("guid"),
        F.col("last.url_original").alias("url_original"),
        F.col("first.seen_at").alias("first_seen_at"),
        F.col("last.seen_at").alias("last_seen_at"),
    )


def merge_sightings(folded: DataFrame, *placed: str) -> DataFrame:
    """Fold sightings of several batches into one row per (URL, feed)."""
    return folded.groupBy(*placed, "url_canonical", "feed_id").agg(
        F.min_by("first", F.col("first.seq")).alias("first"),
        F.max_by("last", F.col("last.seq")).alias("last"),
    )


def with_flags(articles: DataFrame) -> DataFrame:
    """`is_fallback`: the date is not the feed's; `was_revised`: content changed since."""
    return articles.withColumn("is_fallback", F.col("date_source") == "fetched").withColumn(
        "was_revised", F.col("updated_at") > F.col("first_seen_at")
    )


def run_counts(log: DataFrame, known_urls: DataFrame | None = None) -> DataFrame:
    """Per run: `n_seen` distinct URLs, `n_new` of them unknown before, `n_duplicates` dropped.

    A URL is new in the run that holds its first observation of all, unless `known_urls` has it.
    """
    per_run = (
        log.groupBy("feed_id", "run_id", "url_canonical")
        .agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n_entries"))
    )
    firsts = per_run.groupBy("url_canonical").agg(
        F.min_by(F.struct("feed_id", "run_id"), "seq").alias("first")
    )
    if known_urls is not None:
        firsts = firsts.join(known_urls.select("url_canonical"), "url_canonical", "left_anti")
    new = firsts.groupBy(F.col("first.feed_id").alias("feed_id"), F.col("first.run_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_new")
    )
    seen = per_run.groupBy("feed_id", "run_id").agg(
        F.count(F.lit(1)).alias("n_seen"),
        (F.sum("n_entries") - F.count(F.lit(1))).alias("n_duplicates"),
    )
    return seen.join(new, ["feed_id", "run_id"], "left").select(
        "feed_id", "run_id", "n_seen", F.coalesce("n_new", F.lit(0)).alias("n_new"), "n_duplicates"
    )
