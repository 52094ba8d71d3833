"""The given tables in the roles of the data model.

Feeds and their runs come from `events` (a user is a feed, an event a run or an aborted
attempt), the observation log from `lineitem` and `orders` (a part is a URL, a supplier a feed,
a month a run), articles and page documents from `documents`, raw links and HTML from `pages`.
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.session import configure

PLANNED = timedelta(hours=6)
NOW_TEXT = "2024-02-01 00:00:00+00:00"
DOCUMENT_EPOCH_TEXT = "2024-01-01 00:00:00+00:00"
# Consecutive document numbers covered by a page: the bound of its entries.
PAGE_SPAN = 200


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; zoneless times are UTC and become zoned here, once."""
    configure(spark)
    read = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = {f.name for f in read.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return read.select(*(F.col(c).cast("timestamp").alias(c) if c in zoneless else c for c in read.columns))


def _property_k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").filter(kind != "signup").select(
        F.col("user_id").alias("feed_id"),
        F.col("event_id").alias("run_id"),
        F.col("ts").alias("started_at"),
        F.col("ts").alias("finished_at"),
        F.when(kind == "error", "error").when(kind == "view", "not_modified").otherwise("ok").alias("status"),
        F.when(kind == "error", 503).when(kind == "view", 304).otherwise(200).cast("short").alias("http_status"),
        F.when(kind == "purchase", _property_k()).otherwise(0).cast("int").alias("n_new"),
        _property_k().cast("int").alias("n_seen"),
        F.when((kind == "error") & (F.col("value") < 20), "FetchError: HTTP 503")
        .when((kind == "error") & (F.col("value") < 40), "FeedParseError: flux illisible")
        .when(kind == "error", "TypeError: valeur")
        .alias("error_message"),
        F.when(_property_k() >= 90, "suspected")
        .when(_property_k() >= 50, "none")
        .otherwise("unknown")
        .alias("gap_status"),
        F.lit(None).cast("timestamp").alias("oldest_in_page"),
        F.lit(None).cast("timestamp").alias("prev_max_published"),
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .filter(F.col("event_type") == "signup")
        .select(
            F.col("ts").alias("attempted_at"),
            F.lit("docker_unavailable").alias("reason"),
            F.col("props").alias("detail"),
            now().alias("drained_at"),
        )
    )


def _described(feeds: DataFrame) -> DataFrame:
    """Give feeds (feed_id) the remaining columns of the feed table, by their number."""
    number = F.col("feed_id")
    return feeds.select(
        "feed_id",
        F.concat(F.lit("feed-"), number.cast("string")).alias("slug"),
        F.concat(F.lit("Feed "), number.cast("string")).alias("name"),
        F.concat(F.lit("https://feed-"), number.cast("string"), F.lit(".example/rss")).alias("url"),
        F.when(number % 2 == 0, "fr").otherwise("en").alias("lang"),
        F.element_at(F.lit(["ai", "sec", "both"]), (number % 3 + 1).cast("int")).alias("topic"),
        F.element_at(
            F.lit(["media", "vendor", "official", "community"]), (number % 4 + 1).cast("int")
        ).alias("source_type"),
        (number % 10 != 9).alias("is_active"),
    )


def event_feeds(spark: SparkSession, folder: str) -> DataFrame:
    return _described(
        table(spark, folder, "events").select(F.col("user_id").alias("feed_id")).distinct()
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    text = F.concat_ws(" ", F.lit("Part"), "l_partkey", "l_returnflag", "l_linestatus")
    return joined.select(
        F.col("l_suppkey").alias("feed_id"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("long").alias("run_id"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("seq"),
        F.col("l_shipdate").alias("seen_at"),
        F.col("l_partkey").cast("string").alias("url_canonical"),
        F.concat_ws("/", F.lit("https://part"), "l_partkey", "l_orderkey").alias("url_original"),
        F.when(F.col("l_linenumber") > 1, F.col("l_orderkey").cast("string")).alias("guid"),
        text.alias("title"),
        F.col("o_orderpriority").alias("author"),
        F.lit(None).cast("string").alias("raw_summary"),
        F.lit(None).cast("string").alias("summary_clean"),
        F.concat("l_returnflag", "l_linestatus").alias("content_hash"),
        F.col("o_orderdate").alias("published_at"),
        F.when(F.col("l_quantity") > 40, "fetched").otherwise("published").alias("date_source"),
    )


def observation_segment() -> Column:
    """The month is the run, hence the narrowest slice that never splits a page."""
    return F.col("run_id")


def document_feed() -> Column:
    """Number in a document's source name."""
    return F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("doc_id")
    start = F.unix_micros(F.lit(DOCUMENT_EPOCH_TEXT).cast("timestamp"))
    return table(spark, folder, "documents").select(
        F.concat(F.lit("https://docs.example/"), number.cast("string")).alias("url_canonical"),
        document_feed().alias("first_feed_id"),
        number.alias("first_seq"),
        F.concat(F.lit("Document "), number.cast("string")).alias("title"),
        F.col("text").alias("summary_clean"),
        # Ten documents share a minute, so that the order needs its tie-break.
        F.timestamp_micros(start + F.floor(number / 10) * 60_000_000).alias("published_at"),
        F.when(F.col("lang") == "de", "fetched").otherwise("published").alias("date_source"),
    )


def document_feeds(spark: SparkSession, folder: str) -> DataFrame:
    return _described(
        table(spark, folder, "documents").select(document_feed().alias("feed_id")).distinct()
    )


def _escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    # Control characters are not allowed in XML.
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def document_log(spark: SparkSession, folder: str) -> DataFrame:
    """A fetch log whose responses are RSS pages of a source's consecutive documents.

    A page covers 200 document numbers, so its size is bounded whatever a source holds. Feeds
    of even number still show the documents of the page before; the others have moved on.
    """
    number = F.col("doc_id")
    start = F.unix_micros(F.lit(DOCUMENT_EPOCH_TEXT).cast("timestamp"))

    day = F.timestamp_micros(start + number * 3_600_000_000)
    item = F.concat(
        F.lit("<item><title>Document "),
        number.cast("string"),
        F.lit("</title><link>http://m.docs.example.com/"),
        F.col("lang"),
        F.lit("/"),
        number.cast("string"),
        F.lit("/?utm_source=rss&amp;id="),
        number.cast("string"),
        F.lit("</link><guid isPermaLink='false'>doc:"),
        number.cast("string"),
        F.lit("</guid><pubDate>"),
        F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss"),
        F.lit(" +0000</pubDate><description>"),
        _escaped(F.col("text")),
        F.lit("</description></item>"),
    )
    span = F.floor(number / PAGE_SPAN)
    shown_in = F.when(document_feed() % 2 == 0, F.array(span, span + 1)).otherwise(F.array(span))
    pages = (
        table(spark, folder, "documents")
        .select(
            document_feed().alias("feed_id"),
            F.explode(shown_in).alias("run_id"),
            "doc_id",
            "lang",
            "text",
        )
        # items are made after the runs are known, so that a filter by run comes before
        .select("feed_id", "run_id", F.struct(number.alias("doc_id"), item.alias("item")).alias("entry"))
        .groupBy("feed_id", "run_id")
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    )
    body = F.concat(
        F.lit("<?xml version='1.0' encoding='UTF-8'?><rss version='2.0'><channel><title>Docs</title>"),
        F.array_join(F.col("entries.item"), ""),
        F.lit("</channel></rss>"),
    )
    # A page is fetched when its last document number is reached; one number is one hour.
    fetched = F.timestamp_micros(start + (F.col("run_id") + 1) * F.lit(PAGE_SPAN * 3_600_000_000))
    served = pages.select(
        "feed_id",
        "run_id",
        F.col("feed_id").cast("int").alias("feed_pos"),
        fetched.alias("started_at"),
        F.lit(1).alias("attempt"),
        F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("transport_error"),
        body.cast("binary").alias("body"),
        F.concat(F.lit('"v'), F.col("run_id").cast("string"), F.lit('"')).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        fetched.alias("fetched_at"),
    )
    return served.unionByName(_unserved(pages.select("feed_id", "run_id"), fetched))


def _unserved(pages: DataFrame, fetched: Column) -> DataFrame:
    """After a third of the pages, a run that brings none: the page is unchanged, or two attempts fail.

    Such runs have negative numbers.
    """
    even = F.col("run_id") % 2 == 0
    later = fetched + F.expr("INTERVAL 1 HOUR")
    answers = F.when(even, F.array(F.lit(304))).otherwise(F.array(F.lit(503), F.lit(None).cast("int")))
    runs = pages.filter((F.col("feed_id") + F.col("run_id")) % 3 == 0).select(
        "feed_id", "run_id", later.alias("at"), F.posexplode(answers).alias("nth", "http_status")
    )
    return runs.select(
        "feed_id",
        (-F.col("run_id") - 1).alias("run_id"),
        F.col("feed_id").cast("int").alias("feed_pos"),
        F.col("at").alias("started_at"),
        (F.col("nth") + 1).alias("attempt"),
        "http_status",
        F.when(F.col("http_status").isNull(), "timed out").alias("transport_error"),
        F.lit(None).cast("binary").alias("body"),
        F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.col("at").alias("fetched_at"),
    )


def dialect_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each document on a page of its own, in one of six forms; links are relative where they can be."""
    number = F.col("doc_id")
    text = _escaped(F.coalesce("text", F.lit("")))
    day = F.timestamp_micros(F.unix_micros(F.lit(DOCUMENT_EPOCH_TEXT).cast("timestamp")) + number * 3_600_000_000)
    stamp = F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def page(form: str) -> Column:
        """The form with its marks filled in."""
        parts = re.split(r"\{(id|text|stamp)\}", form)
        marks = {"id": number.cast("string"), "text": text, "stamp": stamp}
        return F.concat(*(marks[part] if i % 2 else F.lit(part) for i, part in enumerate(parts)))

    entry = "<title>Document {id}</title><id>atom:{id}</id><updated>{stamp}</updated><summary>{text}</summary>"
    item = "<title>Document {id}</title><description>{text}</description>"
    forms = (
        "<feed xmlns='http://www.w3.org/2005/Atom' xml:base='https://atom.example/blog/'><title>A</title><entry>"
        f"<link rel='self' href='x'/><link rel='alternate' href='../e/{{id}}'/>{entry}</entry></feed>",
        "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' "
        "xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>R</title><link>http://rdf.example/site/</link></channel>"
        f"<item><link>/n/{{id}}</link><dc:date>{{stamp}}</dc:date>{item}</item></rdf:RDF>",
        "<rss version='2.0' xml:base='http://rss.example/a/b/'><channel><title>S</title><link>http://other.example/</link>"
        f"<item xml:base='../c/'><link>d.html?p={{id}}</link>{item}</item></channel></rss>",
        "<html><head><title>Document {id}</title></head><body><p>{text}</p></body></html>",
        f"<rss version='2.0'><channel><title>T</title><item><link>https://cut.example/{{id}}</link>{item}</item>",
        f"<feed xmlns='http://www.w3.org/2005/Atom'><link href='https://two.example/x/index.html'/><entry>{entry}</entry>"
        f"<entry><link href='y/{{id}}'/>{entry}</entry></feed>",
    )
    body = F.lit(None).cast("string")
    for turn, form in enumerate(forms):
        body = F.when(number % len(forms) == turn, page(form)).otherwise(body)
    return table(spark, folder, "documents").select(
        "doc_id", F.encode(body, "UTF-8").alias("body"), (day + F.expr("INTERVAL 1 DAY")).alias("fetched_at")
    )
