"""The registered queries: each operator over the given tables, whole.

Results carry times as integer microseconds, so that any engine compares them exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions import dates, labels, markup, sql, text, urls
from pagetide.operators import coverage, declare, observe, quality, reports, saturation, sequences, snapshot
from pagetide.plans import ingest, roles
from pagetide.session import shared_folder
from pagetide.sources import attempts as attempt_log
from pagetide.sources import declarations, fetchlog
from pagetide.sources.pages import decode_body, explode_entries, normalize_entries, parse_documents
from pagetide.streaming import drain, feed_state, upsert

Query = Callable[[SparkSession, str], DataFrame]

# Tables whose values print alike in every engine; vectors of floats do not.
FINGERPRINTED = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def micros(column: str, into: str | None = None) -> Column:
    return F.unix_micros(column).alias(into or f"{column}_us")


# --- coverage ---------------------------------------------------------------------------


def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    gaps = coverage.coverage_gaps(
        roles.runs(spark, folder), roles.attempts(spark, folder), now=roles.now(), planned=roles.PLANNED
    )
    return gaps.select(
        "feed_id", micros("start"), micros("end"), "ongoing", "missed_attempts", "duration_us"
    )


def _feed_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.feed_coverage(
        roles.event_feeds(spark, folder), roles.runs(spark, folder), now=roles.now(), planned=roles.PLANNED
    )


def feed_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return _feed_coverage(spark, folder).select(
        "feed_id",
        "slug",
        "n_runs",
        micros("first_run"),
        micros("last_run"),
        "median_interval_us",
        "worst_interval_us",
        "n_gaps",
        "has_ongoing_gap",
        "observed",
        "n_suspected",
    )


def coverage_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = coverage.coverage_summary(_feed_coverage(spark, folder), roles.attempts(spark, folder))
    return summary.select(
        micros("window_start"), "n_feeds", "n_feeds_with_ongoing_gap", "missed_total"
    )


def coverage_table(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.coverage_table(_feed_coverage(spark, folder), now=roles.now())


def gap_table(spark: SparkSession, folder: str) -> DataFrame:
    gaps = coverage.coverage_gaps(
        roles.runs(spark, folder), roles.attempts(spark, folder), now=roles.now(), planned=roles.PLANNED
    )
    shown = coverage.gap_table(gaps, roles.event_feeds(spark, folder))
    return shown.withColumn("start_us", F.unix_micros("start")).drop("start")


# --- reports ----------------------------------------------------------------------------


def _health(spark: SparkSession, folder: str) -> DataFrame:
    return reports.feed_health(
        roles.event_feeds(spark, folder), roles.runs(spark, folder), roles.articles(spark, folder)
    )


def feed_health(spark: SparkSession, folder: str) -> DataFrame:
    return _health(spark, folder).select(
        "feed_id", "slug", micros("started_at"), "status", "http_status", "n_articles", "error_kind", "gap_status"
    )


def health_table(spark: SparkSession, folder: str) -> DataFrame:
    return reports.health_table(_health(spark, folder), now=roles.now())


def article_listing(spark: SparkSession, folder: str) -> DataFrame:
    page = reports.list_articles(
        roles.articles(spark, folder), roles.document_feeds(spark, folder), lang="fr", topic="ai", page=2
    )
    return page.rows.select("url_canonical", "title", "slug", "lang", "topic", micros("published_at"), "first_seq")


def listing_table(spark: SparkSession, folder: str) -> DataFrame:
    page = reports.list_articles(roles.articles(spark, folder), roles.document_feeds(spark, folder))
    return reports.listing_table(page.rows, now=roles.now())


def article_listing_deep(spark: SparkSession, folder: str) -> DataFrame:
    """The last page of the whole listing."""
    articles, feeds = roles.articles(spark, folder), roles.document_feeds(spark, folder)
    last = reports.list_articles(articles, feeds).info.first()["pages"]
    page = reports.list_articles(articles, feeds, page=last)
    return page.rows.select(
        "url_canonical", "title", "slug", "lang", "topic", micros("published_at"), "first_seq"
    )


def listing_page_info(spark: SparkSession, folder: str) -> DataFrame:
    chosen = reports.select_articles(
        roles.articles(spark, folder), roles.document_feeds(spark, folder), topic="sec"
    )
    return reports.page_info(chosen, page=2)


def newest_article(spark: SparkSession, folder: str) -> DataFrame:
    return reports.newest_article(roles.articles(spark, folder)).select(micros("latest_published_at"))


def article_flags(spark: SparkSession, folder: str) -> DataFrame:
    folded = observe.fold_articles(_stored_log(spark, folder), roles.observation_segment(), texts=False)
    flags = observe.with_flags(folded)
    return flags.groupBy("is_fallback", "was_revised").agg(F.count(F.lit(1)).alias("n_articles"))


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.run_summary(roles.runs(spark, folder))


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    described = roles.runs(spark, folder).join(roles.event_feeds(spark, folder), "feed_id")
    return described.groupBy(
        labels.error_kind(F.col("error_message")).alias("error_kind"),
        labels.error_kind_label(F.col("error_message")).alias("error_kind_label"),
        labels.gap_label(F.col("gap_status")).alias("gap_label"),
        labels.lang_label(F.col("lang")).alias("lang_label"),
        labels.topic_label(F.col("topic")).alias("topic_label"),
        labels.source_label(F.col("source_type")).alias("source_label"),
    ).agg(F.count(F.lit(1)).alias("n_runs"))


# --- folding ----------------------------------------------------------------------------


def _article_columns(articles: DataFrame) -> DataFrame:
    return articles.select(
        "url_canonical",
        "first_feed_id",
        "title",
        "author",
        "content_hash",
        micros("published_at"),
        "date_source",
        micros("first_seen_at"),
        micros("last_seen_at"),
        micros("updated_at"),
        "n_observations",
    )


def _stored_log(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """What the fold decides on, and these columns, written once for all that read it."""
    log = roles.observations(spark, folder).select(*observe.FOLDED, *columns)
    return ingest.stage(log, shared_folder(spark, "log"))


def article_fold(spark: SparkSession, folder: str) -> DataFrame:
    log = _stored_log(spark, folder, *observe.TEXTS)
    workspace = shared_folder(spark, "fold")
    return _article_columns(observe.fold_articles(log, roles.observation_segment(), workspace=workspace))


def observation_fold(spark: SparkSession, folder: str) -> DataFrame:
    folded = observe.sighting_rows(observe.fold_sightings(roles.observations(spark, folder)))
    return folded.select(
        "url_canonical", "feed_id", "guid", "url_original", micros("first_seen_at"), micros("last_seen_at")
    )


def run_new_seen(spark: SparkSession, folder: str) -> DataFrame:
    return observe.run_counts(roles.observations(spark, folder))


def _dated_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with their oldest reliable date, and the largest date of the articles each showed."""
    # What both passes read, written once; rows of a run and URL are too few to fold them before.
    needed = ("feed_id", "run_id", "seq", "url_canonical", "published_at", "date_source")
    log = ingest.stage(roles.observations(spark, folder).select(*needed), shared_folder(spark, "prev-max"))
    frozen = (
        log.groupBy("url_canonical")
        .agg(F.min_by(F.struct("published_at", "date_source"), "seq").alias("first"))
        .select("url_canonical", "first.*")
    )
    return saturation.run_dates(log, frozen)


def prev_max_by_run(spark: SparkSession, folder: str) -> DataFrame:
    by_year = _dated_runs(spark, folder).withColumn("year", F.floor(F.col("run_id") / 12))
    before = sequences.running_max_before(by_year, "feed_id", "year", "run_id", "run_max", "prev_max_published")
    return before.select("feed_id", "run_id", micros("prev_max_published"))


def stream_feed_state(spark: SparkSession, folder: str) -> DataFrame:
    """The same runs, arriving in three parts; what was known of a feed is the stream's own state."""
    base = shared_folder(spark, "feed-state")
    rows = ingest.stage(
        _dated_runs(spark, folder).select(
            "feed_id", "run_id", F.col("run_id").alias("run_order"), "oldest", "run_max"
        ),
        f"{base}/rows",
    )
    year = F.floor(F.col("run_id") / 12)
    for part in (year < 1995, year.between(1995, 1997), year > 1997):
        rows.filter(part).write.mode("append").parquet(f"{base}/landed")
        feed_state.tell_available(spark, f"{base}/landed", f"{base}/state")
    return feed_state.told_runs(spark, f"{base}/state").select("feed_id", "run_id", micros("prev_max_published"))


def feed_maxima(spark: SparkSession, folder: str) -> DataFrame:
    log = _stored_log(spark, folder)
    articles = observe.fold_articles(log, roles.observation_segment(), texts=False)
    # a maximum is the same over repeated sightings
    maxima = saturation.feed_maximum(log.select("url_canonical", "feed_id"), articles)
    return maxima.select("feed_id", micros("max_published"))


def _event_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Events as page entries: a user's week is a page, dated up to four days back."""
    k = F.get_json_object("props", "$.k").cast("long")
    stamp = F.col("ts")
    return roles.table(spark, folder, "events").select(
        F.col("user_id").alias("feed_id"),
        F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(roles.DOCUMENT_EPOCH_TEXT).cast("timestamp"))) / 604_800_000_000)
        .alias("run_id"),
        F.struct("ts", "event_id").alias("seq"),
        F.concat_ws("-", F.col("user_id") % 10, k).alias("url_canonical"),
        F.timestamp_micros(F.unix_micros(stamp) - k * 3_600_000_000).alias("published_at"),
        F.when(F.col("event_type") == "error", "fetched").otherwise("published").alias("date_source"),
        "event_type",
    )


def gap_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    entries = _event_entries(spark, folder)
    kind = F.col("event_type")
    pages = entries.groupBy("feed_id", "run_id").agg(
        F.min("seq.ts").alias("started_at"),
        F.max("seq.ts").alias("finished_at"),
        F.when(F.count_if(kind == "error") >= 7, "error")
        .when(F.count_if(kind == "view") == 0, "not_modified")
        .otherwise("ok")
        .alias("status"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in (
            ("slug", "string"),
            ("http_status", "short"),
            ("error_message", "string"),
            ("warning", "string"),
            ("etag", "string"),
            ("last_modified", "string"),
            ("items", "string"),
        )),
    )
    # Runs that are not ok leave nothing behind.
    ok = pages.filter(F.col("status") == "ok").select("feed_id", "run_id")
    stored = entries.drop("event_type").join(ok, ["feed_id", "run_id"], "left_semi")
    runs, _ = ingest.assessed_runs(pages, stored)
    return runs.select(
        "feed_id",
        "run_id",
        "status",
        "n_new",
        "n_seen",
        "gap_status",
        "gap_reason",
        micros("oldest_in_page"),
        micros("prev_max_published"),
    )


def _ten_minute_pages(spark: SparkSession, folder: str) -> DataFrame:
    return roles.table(spark, folder, "events").select(
        "event_id",
        F.floor(F.unix_seconds("ts") / 600).alias("page_id"),
        F.col("ts").alias("published_at"),
        F.when(F.col("event_type") == "error", "fetched").otherwise("published").alias("date_source"),
        F.timestamp_seconds((F.floor(F.unix_seconds("ts") / 600) + 1) * 600).alias("fetched_at"),
    )


def degenerate_pages(spark: SparkSession, folder: str) -> DataFrame:
    facts = saturation.page_facts(_ten_minute_pages(spark, folder), "page_id")
    return facts.select(
        "page_id", "n_entries", "n_reliable", micros("oldest_reliable"), micros("newest_reliable"), "degenerate"
    )


def demoted_dates(spark: SparkSession, folder: str) -> DataFrame:
    demoted = saturation.demote_degenerate(_ten_minute_pages(spark, folder), "page_id")
    return demoted.select("event_id", "date_source", micros("published_at"))


# --- text, URLs, dates ------------------------------------------------------------------


def canonical_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = roles.table(spark, folder, "pages").select("page_id", "url")
    return urls.canonicalize(pages, "url").select("page_id", "url_canonical", "reject_reason")


def canonical_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The given addresses, written in thirteen ways that a canonical URL undoes or refuses."""
    page = F.col("page_id") % 13
    scheme = F.regexp_extract("url", "^(https?://)", 1)
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    rest = F.regexp_extract("url", "^https?://[^/?#]*(.*)$", 1)
    forms = {
        1: (F.lit("http://"), host, F.lit(":443"), rest),
        2: (scheme, host, F.lit(":8080"), rest),
        3: (scheme, host, F.lit("/zig/.."), rest),
        4: (scheme, host, F.lit("//."), rest),
        5: (scheme, F.lit("nom:mot@"), host, rest),
        6: (F.lit("//"), host, rest),
        7: (F.lit("ftp://"), host, rest),
        8: (scheme, F.lit("bücher."), host, rest),
        9: (scheme, host, F.lit("/%7Ez%2fz"), rest),
        10: (scheme, host, F.lit(":x9"), rest),
        11: (F.lit("  "),),
        12: (scheme, F.lit("/"), rest),
    }
    raw = F.col("url")
    for number, parts in forms.items():
        raw = F.when(page == number, F.concat(*parts)).otherwise(raw)
    pages = roles.table(spark, folder, "pages").select("page_id", raw.alias("raw"))
    return urls.canonicalize(pages, "raw").select("page_id", "url_canonical", "reject_reason")


def resolved_links(spark: SparkSession, folder: str) -> DataFrame:
    """References of eleven kinds in documents that lie at the given addresses."""
    references = (
        "https://o.example/a?b#c", "z/1.html", "/z/2?x=1", "../z3", "./z4", "?q=5", "#f6", "//o.example/x/./y",
        "../" * 40 + "z8", "..", "a/b/../../c/.",
    )
    kinds = F.array(*map(F.lit, references))
    reference = F.element_at(kinds, (F.col("page_id") % len(references) + 1).cast("int"))
    pages = roles.table(spark, folder, "pages").select("page_id", "url")
    return pages.select("page_id", urls.resolve(F.col("url"), reference).alias("resolved"))


def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The column functions as a user of SQL calls them."""
    sql.register(spark)
    tables = {name: roles.table(spark, folder, name) for name in ("pages", "documents", "events")}
    return spark.sql(
        """
        SELECT page_id, link.url_canonical, link.reject_reason, excerpt, absolute, attribute, lang
        FROM (
          SELECT p.page_id, canonicalize(p.url) AS link, excerpt(normalize_ws(d.text)) AS excerpt,
                 absolute_date(e.ts) AS absolute, datetime_attr(e.ts) AS attribute, lang_label(d.lang) AS lang
          FROM {pages} p JOIN {documents} d ON d.doc_id = p.page_id JOIN {events} e ON e.event_id = p.page_id
        )
        """,
        **tables,
    )


def canonical_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_urls(spark, folder).groupBy("url_canonical").agg(
        F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page_id")
    )


def _document_hash(title: Column) -> Column:
    return text.content_hash(title, F.col("text"))


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    documents = roles.table(spark, folder, "documents")
    return documents.select("doc_id", _document_hash(title).alias("content_hash"))


def duplicate_texts(spark: SparkSession, folder: str) -> DataFrame:
    hashed = roles.table(spark, folder, "documents").select("doc_id", _document_hash(F.lit("")).alias("content_hash"))
    copies = hashed.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_doc_id")
    )
    return copies.filter("n_copies > 1")


def double_escapes(spark: SparkSession, folder: str) -> DataFrame:
    pages = roles.table(spark, folder, "pages")
    return pages.select("page_id", F.md5(text.fix_double_escaping(F.col("html"))).alias("fixed_md5"))


def strip_tags_native(spark: SparkSession, folder: str) -> DataFrame:
    pages = roles.table(spark, folder, "pages")
    return pages.select("page_id", markup.strip_tags_native(F.col("html")).alias("text"))


def clean_titles(spark: SparkSession, folder: str) -> DataFrame:
    pages = roles.table(spark, folder, "pages")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", text.clean_title(title).alias("title"))


def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    documents = roles.table(spark, folder, "documents")
    return documents.select(
        "doc_id", markup.excerpt_of_text(text.normalize_ws(F.col("text"))).alias("excerpt")
    )


def _written_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's time written in one of eleven ways, some of them unreadable or implausible."""
    stamp = F.col("ts")
    forms = (
        F.concat(F.date_format(stamp, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200")),
        F.concat(F.date_format(stamp, "d MMM yyyy HH:mm"), F.lit(" EST")),
        F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("-07:30")),
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"),
        F.date_format(stamp, "dd/MM/yyyy HH:mm:ss"),
        F.date_format(stamp, "yyyy-MM-dd"),
        F.date_format(stamp, "dd/MM/yyyy"),
        F.lit("la semaine derniere"),
        F.lit("Thu, 01 Jan 1970 00:00:00 +0000"),
        F.concat(F.lit("Fri, 19 Aug 2129 08:30:00 +"), F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lit("00")),
        F.lit("30 Feb 2024 10:00:00 GMT"),
    )
    turn = F.col("event_id") % len(forms)
    published = F.lit(None).cast("string")
    for number, form in enumerate(forms):
        published = F.when(turn == number, form).otherwise(published)
    return roles.table(spark, folder, "events").select(
        "event_id",
        published.alias("published"),
        F.when(F.col("event_type") == "view", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"),
        F.timestamp_micros(F.unix_micros(stamp) + 3_600_000_000).alias("fetched_at"),
    )


def dates_resolved(spark: SparkSession, folder: str) -> DataFrame:
    written = _written_dates(spark, folder)
    resolved = dates.resolve_published(
        dates.parse_datetime(F.col("published")), dates.parse_datetime(F.col("updated")), F.col("fetched_at")
    )
    return written.withColumn("r", resolved).select(
        "event_id", F.unix_micros("r.published_at").alias("published_us"), "r.date_source"
    )


def report_times(spark: SparkSession, folder: str) -> DataFrame:
    events = roles.table(spark, folder, "events")
    age = F.unix_micros(roles.now()) - F.unix_micros("ts")
    # Squeezing ages spreads them over minutes, hours and days.
    squeezed = F.floor(age / (F.col("event_id") % 997 + 1)).cast("long")
    shifted = F.timestamp_micros(F.unix_micros(roles.now()) - squeezed)
    return events.select(
        "event_id",
        dates.absolute_date(F.col("ts")).alias("absolute"),
        dates.datetime_attr(F.col("ts")).alias("attribute"),
        dates.relative_date(shifted, roles.now()).alias("relative"),
        dates.duration(squeezed).alias("duration"),
    )


# --- declarations, attempts, audits, snapshots ------------------------------------------


def _stored_and_declared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as stored feeds, and as declarations after some left, joined or changed."""
    suppliers = roles.table(spark, folder, "supplier").join(
        roles.table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    balance = F.col("s_acctbal")
    shared = suppliers.select(
        F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("slug"),
        F.col("s_suppkey").alias("feed_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example/feed")).alias("url"),
        F.when(F.col("n_regionkey") < 3, "fr").otherwise("en").alias("lang"),
        F.lit("sec").alias("topic"),
        F.lit("vendor").alias("source_type"),
        balance.alias("balance"),
        "n_name",
    )
    stored = shared.filter(F.col("balance") > 500).select(
        "feed_id", "slug", "name", "url", "lang", "topic", "source_type", (F.col("balance") < 9000).alias("is_active"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in (
            ("etag", "string"), ("last_modified", "string"), ("created_at", "timestamp"), ("updated_at", "timestamp"),
        )),
    )
    declared = shared.filter(F.col("balance") < 9500).select(
        F.col("slug").alias("id"),
        F.when(F.col("balance").between(3000, 5000), F.concat_ws(" ", "name", "n_name"))
        .otherwise(F.col("name"))
        .alias("name"),
        "url",
        "lang",
        "topic",
        "source_type",
    )
    return stored, declared


def declaration_sync(spark: SparkSession, folder: str) -> DataFrame:
    stored, declared = _stored_and_declared(spark, folder)
    return declare.sync_actions(stored, declared).select("slug", "action")


def sync_report(spark: SparkSession, folder: str) -> DataFrame:
    stored, declared = _stored_and_declared(spark, folder)
    return declare.sync_report(declare.sync_actions(stored, declared))


def synced_feeds(spark: SparkSession, folder: str) -> DataFrame:
    stored, declared = _stored_and_declared(spark, folder)
    synced = declare.apply_sync(stored, declared, roles.now())
    return synced.select("slug", "name", "lang", "is_active", micros("updated_at"))


def declaration_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as declarations: segment as topic, nation as language, shared names as URLs."""
    customers = roles.table(spark, folder, "customer").select(
        F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("id"),
        F.col("c_name").alias("name"),
        F.concat(
            F.when(F.col("c_acctbal") < 0, "ftp").otherwise("https"),
            F.lit("://nation-"),
            F.col("c_nationkey").cast("string"),
            F.lit(".example/"),
            F.floor("c_acctbal").cast("string"),
        ).alias("url"),
        F.when(F.col("c_nationkey") < 20, "fr").otherwise("it").alias("lang"),
        F.when(F.col("c_mktsegment") == "BUILDING", "building").otherwise("ai").alias("topic"),
        F.lit("media").alias("source_type"),
    )
    return declarations.declaration_violations(customers)


def attempt_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lines of an attempt log, well and badly formed, one form per event type."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")

    def line(at: Column, reason: str, detail: Column) -> Column:
        return F.concat(
            F.lit('{"attempted_at": "'), at, F.lit(f'", "reason": "{reason}", "detail": '), detail, F.lit("}")
        )

    value = (
        F.when(kind == "signup", line(F.concat(second, F.lit("Z")), "docker_unavailable", F.concat(F.lit('"k '), k, F.lit('"'))))
        .when(kind == "view", line(F.concat(second, F.lit("+02:00")), "something_new", F.lit('""')))
        .when(kind == "purchase", line(F.concat(F.substring(second, 1, 13), F.lit("+0000")), "lock_held", k))
        .when(kind == "click", line(second, "lock_held", F.lit("null")))
        .when(F.col("value") < 20, F.col("props"))
        .otherwise(F.concat(F.lit("not json "), F.col("props")))
    )
    return roles.table(spark, folder, "events").select(value.alias("value"))


def attempt_log_query(spark: SparkSession, folder: str) -> DataFrame:
    parsed = attempt_log.parse_attempts(attempt_lines(spark, folder), roles.now())
    # Attempts of the first days are stored already.
    early = F.col("attempted_at") < F.lit("2024-01-05 00:00:00+00:00").cast("timestamp")
    stored = roles.attempts(spark, folder).filter(early).select(
        F.date_trunc("second", "attempted_at").alias("attempted_at"), "reason"
    )
    fresh = attempt_log.insert_or_ignore(stored, parsed)
    return fresh.select(micros("attempted_at"), "reason", "detail")


def _star_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Suppliers and users as feeds, parts as articles, lines as sightings, events as runs and attempts."""
    at = F.lit(roles.DOCUMENT_EPOCH_TEXT).cast("timestamp")
    events, lines = roles.table(spark, folder, "events"), roles.table(spark, folder, "lineitem")
    kind = F.col("event_type")
    user = F.concat(F.lit("u-"), F.col("user_id").cast("string"))
    supplier = F.concat(F.lit("p-"), F.col("s_suppkey").cast("string"))
    part = F.concat(F.lit("https://part.example/"), F.col("p_partkey").cast("string"))
    # Suppliers in debt and users of every fifth number are no feeds, every tenth part is no article.
    ids = (
        roles.table(spark, folder, "supplier").filter("s_acctbal >= 0").select(supplier.alias("feed_id"))
        .unionByName(events.filter("user_id % 5 <> 0").select(user.alias("feed_id")).distinct())
    )
    feeds = ids.select(
        "feed_id",
        F.col("feed_id").alias("slug"),
        F.col("feed_id").alias("name"),
        F.concat(F.lit("https://star.example/"), "feed_id").alias("url"),
        F.lit("fr").alias("lang"), F.lit("sec").alias("topic"), F.lit("vendor").alias("source_type"),
        F.lit(True).alias("is_active"), at.alias("created_at"), at.alias("updated_at"),
    )
    articles = roles.table(spark, folder, "part").filter("p_partkey % 10 <> 0").select(
        part.alias("url_canonical"),
        F.lit(None).cast("string").alias("first_feed_id"),
        F.col("p_name").alias("title"),
        F.sha2("p_name", 256).alias("content_hash"),
        at.alias("published_at"), F.lit("updated").alias("date_source"),
        at.alias("first_seen_at"), at.alias("last_seen_at"), at.alias("updated_at"),
    )
    sightings = lines.select(
        F.concat(F.lit("https://part.example/"), F.col("l_partkey").cast("string")).alias("url_canonical"),
        F.concat(F.lit("p-"), F.col("l_suppkey").cast("string")).alias("feed_id"),
        F.when(F.col("l_linenumber") < 7, F.col("l_orderkey").cast("string")).alias("url_original"),
        F.col("l_shipdate").alias("first_seen_at"),
        F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("last_seen_at"),
    )
    runs = events.filter(kind != "signup").select(
        user.alias("feed_id"),
        F.col("ts").alias("started_at"),
        F.when(kind == "view", "gone").when(kind == "error", "error").otherwise("ok").alias("status"),
        F.when(kind != "error", F.lit(0)).alias("n_new"),
        F.lit(0).alias("n_seen"),
        F.when(kind == "purchase", "maybe").otherwise("none").alias("gap_status"),
    )
    attempts = events.filter(kind == "signup").select(
        F.date_trunc("hour", "ts").alias("attempted_at"),
        F.when(F.col("value") < 10, "unheard").when(F.col("value") < 90, "lock_held").alias("reason"),
        F.when(F.col("value") >= 50, F.col("ts")).alias("drained_at"),
    )
    return {"feed": feeds, "article": articles, "article_feed": sightings, "feed_run": runs, "missed_run": attempts}


def constraint_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Documents stored as articles under rules that their raw form breaks in many ways."""
    documents = roles.table(spark, folder, "documents")
    started = F.lit(roles.DOCUMENT_EPOCH_TEXT).cast("timestamp")
    feeds = documents.select("source", "lang").distinct().select(
        F.concat(F.lit("s-"), F.col("source")).alias("feed_id"),
        F.col("source").alias("slug"),
        F.when(F.col("lang") != "es", F.col("source")).alias("name"),
        F.concat_ws("/", F.lit("https://x.example"), "source", "lang").alias("url"),
        "lang",
        F.lit("ai").alias("topic"),
        F.lit("media").alias("source_type"),
        F.lit(True).alias("is_active"),
        started.alias("created_at"),
        started.alias("updated_at"),
    )
    articles = documents.select(
        F.sha2("text", 256).alias("url_canonical"),
        F.when(F.col("n_chars") < 20_000, F.concat(F.lit("s-"), F.col("source"))).otherwise("s-none").alias("first_feed_id"),
        F.when(F.col("n_chars") > 100, "t").alias("title"),
        F.when(F.col("n_chars") > 15_000, F.md5("text")).otherwise(F.sha2("text", 256)).alias("content_hash"),
        started.alias("published_at"),
        F.when(F.col("lang") == "fr", "guess").otherwise("published").alias("date_source"),
        started.alias("first_seen_at"),
        started.alias("last_seen_at"),
        started.alias("updated_at"),
    )
    more = _star_tables(spark, folder)
    violations = quality.audit(
        {
            "feed": feeds.unionByName(more["feed"]),
            "article": articles.unionByName(more["article"]),
            "article_feed": more["article_feed"],
            "feed_run": more["feed_run"],
            "missed_run": more["missed_run"],
        }
    )
    return violations.groupBy("table_name", "rule", "row_key").agg(F.sum("n_rows").alias("n_rows"))


def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.fingerprints({name: roles.table(spark, folder, name) for name in FINGERPRINTED})


def snapshot_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Tables as they were restored after a change, a second and a third snapshot, and a rotation.

    With them, how many of their parts each snapshot that is left had to copy.
    """
    root = shared_folder(spark, "snapshots")
    names = ("customer", "nation", "orders", "supplier")
    tables = {name: roles.table(spark, folder, name) for name in names}
    snapshot.take_snapshot(tables, root, "20240101-000000")
    # the one customer with the largest key gets another name: one row leaves a part, one enters
    last = F.col("c_custkey") == tables["customer"].agg(F.max("c_custkey")).first()[0]
    name = F.when(last, "Renamed").otherwise(F.col("c_name"))
    changed = {**tables, "customer": tables["customer"].withColumn("c_name", name)}
    snapshot.take_snapshot(changed, root, "20240102-000000")
    snapshot.take_snapshot(changed, root, "20240103-000000")
    snapshot.rotate(spark, root, keep=2)
    listed = snapshot.list_snapshots(spark, root, keep=1)
    copied = listed.agg(
        F.count(F.lit(1)).alias("n_snapshots"),
        F.count_if((F.col("n_copied") >= 1) & (F.col("n_copied") <= 2)).alias("n_small_copies"),
        F.count_if(F.col("n_copied") == 0).alias("n_empty_copies"),
        F.count_if("expired").alias("n_expired"),
    )
    restored = snapshot.restore(spark, root, "20240103-000000")
    return snapshot.fingerprints(restored).join(F.broadcast(copied))


def embedding_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Components as millionths: whole numbers print alike in every engine."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1_000_000 + 0.5).cast("string"))
    vectors = roles.table(spark, folder, "embeddings").withColumn("embedding", F.array_join(scaled, ","))
    return snapshot.fingerprint(vectors, "embeddings")


def purge_preview(spark: SparkSession, folder: str) -> DataFrame:
    log = _stored_log(spark, folder)
    feeds = roles.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("feed_id"), "s_acctbal")
    remaining = quality.purge_feeds(
        feeds.filter(F.col("s_acctbal") < 0).select("feed_id"),
        feeds,
        log.select("feed_id", "run_id").distinct(),
        observe.fold_articles(log, roles.observation_segment(), texts=False).select("url_canonical", "first_feed_id"),
        log.select("url_canonical", "feed_id").distinct(),
    )
    counted = [
        part.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, part in vars(remaining).items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


# --- documents and streams --------------------------------------------------------------


def page_entries(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_documents(roles.document_log(spark, folder))
    entries = normalize_entries(explode_entries(parsed))
    return entries.select(
        "feed_id",
        "run_id",
        "entry_pos",
        "url_canonical",
        "guid",
        "title",
        "content_hash",
        micros("published_at"),
        "date_source",
    )


def page_dialects(spark: SparkSession, folder: str) -> DataFrame:
    """Atom, RSS 1.0 and 2.0 with relative links, error pages and cut documents: entries and errors."""
    parsed = ingest.stage(parse_documents(roles.dialect_pages(spark, folder)), shared_folder(spark, "dialects"))
    entries = normalize_entries(explode_entries(parsed.drop("warning")))
    return (
        parsed.select("doc_id", "parse_error")
        .join(entries.drop("fetched_at"), "doc_id", "left")
        .select(
            "doc_id", "parse_error", "entry_pos", "url_original", "url_canonical", "reject_reason", "guid", "title",
            "content_hash", micros("published_at"), "date_source",
        )
    )


def _attempt_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events in threes as the attempts of a run; every seventh run is of an unknown feed."""
    kind, number = F.col("event_type"), F.col("event_id")
    run = F.floor(number / 3)
    return roles.table(spark, folder, "events").select(
        F.when(run % 7 == 6, -1).otherwise(run % 10).alias("feed_id"),
        run.alias("run_id"),
        F.lit(0).alias("feed_pos"),
        F.col("ts").alias("started_at"),
        (number % 3 + 1).cast("int").alias("attempt"),
        F.when((kind == "click") & (F.col("value") < 10), None)
        .when(kind == "view", 304)
        .when(kind == "error", 503)
        .when(kind == "signup", 404)
        .otherwise(200)
        .alias("http_status"),
        F.when((kind == "error") & (F.col("value") < 20), "timed out").alias("transport_error"),
        F.when(kind == "click", "<rss/>").when(kind == "purchase", "").cast("binary").alias("body"),
        F.when(kind == "click", F.col("props")).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.col("ts").alias("fetched_at"),
    )


def run_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = fetchlog.classify_runs(_attempt_log(spark, folder), roles.event_feeds(spark, folder))
    return outcomes.select("feed_id", "run_id", "attempt", "http_status", "status", "error_message")


def unknown_feed_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = fetchlog.unknown_feed_runs(_attempt_log(spark, folder), roles.event_feeds(spark, folder))
    return found.select("feed_id", "run_id", "n_attempts", micros("started_at"))


def page_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as bytes of several encodings, declared far behind padding, and read back.

    Texts with characters that a code page lacks stay UTF-8.
    """
    text = F.concat(F.lit("€ œ ’ "), F.coalesce("text", F.lit("")))
    western = r"^[\x00-\x7F\xA0-\xA3\xA7\xA9-\xB3\xB5-\xB7\xBF-\xFF]*$"
    form = F.when(F.coalesce("text", F.lit("")).rlike(western), F.col("doc_id") % 5).otherwise(0)

    def page(name: str) -> Column:
        return F.concat(F.lit(f"<?xml version='1.0'{' ' * 300}encoding='{name}'?>"), text)

    def as_bytes(name: str, own: str, other: str) -> Column:
        return F.encode(F.translate(page(name), own, other), "ISO-8859-1")

    body = (
        F.when(form == 0, F.encode(page("UTF-8"), "UTF-8"))
        .when(form == 1, F.encode(page("ISO-8859-1"), "UTF-8"))
        .when(form == 2, as_bytes("latin-1", "€œ’", "???"))
        .when(form == 3, as_bytes("windows-1252", "€œ’", "\x80\x9c\x92"))
        .otherwise(as_bytes("iso-8859-15", "€œ’", "\xa4\xbd?"))
    )
    pages = roles.table(spark, folder, "documents").select("doc_id", body.alias("body"))
    read, warning = decode_body(F.col("body"))
    content = F.regexp_replace(read, r"^<\?xml[^>]*\?>", "")
    return pages.select("doc_id", F.md5(content).alias("text_md5"), warning.alias("warning"))


def validators(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    runs = roles.table(spark, folder, "events").select(
        F.col("user_id").alias("feed_id"),
        F.col("event_id").alias("run_id"),
        F.col("ts").alias("started_at"),
        F.when(kind.isin("click", "purchase"), "ok").otherwise("error").alias("status"),
        F.when(kind == "click", F.col("props")).alias("etag"),
        F.when(F.col("value") < 50, F.col("value").cast("string")).alias("last_modified"),
    )
    return fetchlog.current_validators(runs)


def ingest_documents(spark: SparkSession, folder: str) -> DataFrame:
    done = ingest.ingest(
        roles.document_log(spark, folder),
        roles.document_feeds(spark, folder),
        shared_folder(spark, "ingest"),
    )
    return _run_columns(done.runs)


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The same log, arriving in three batches, old versions swept away while the stream goes on."""
    base = shared_folder(spark, "stream-ingest")
    feeds = roles.document_feeds(spark, folder)
    # The log is made a batch at a time: what a run is filtered by is known before its page is made.
    log = roles.document_log(spark, folder)
    # Pages are numbered in the order of their time; the cuts are thirds of that range. Runs that
    # brought no page come a batch late.
    last = log.agg(F.max("run_id").alias("last")).first()["last"] or 0
    page = F.when(F.col("run_id") < 0, -F.col("run_id") - 1).otherwise(F.col("run_id"))
    arrival = F.least(F.lit(2), F.floor(page / (last // 3 + 1)) + (F.col("run_id") < 0).cast("long"))
    for batch in range(3):
        log.filter(arrival == batch).write.mode("append").parquet(f"{base}/landed")
        upsert.ingest_stream(
            fetchlog.stream_fetch_log(spark, f"{base}/landed"), feeds, f"{base}/state"
        ).awaitTermination()
        if batch == 1:
            upsert.sweep(spark, f"{base}/state", batch)
    return _run_columns(upsert.stored_runs(spark, f"{base}/state"))


def _run_columns(runs: DataFrame) -> DataFrame:
    return runs.select(
        "feed_id",
        "run_id",
        "status",
        "n_new",
        "n_seen",
        "gap_status",
        "gap_reason",
        micros("oldest_in_page"),
        micros("prev_max_published"),
    )


def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The observation log, arriving in three parts, folded batch by batch."""
    base = shared_folder(spark, "stream-upsert")
    log = roles.observations(spark, folder)
    seen = F.year("seen_at")
    for part in (seen < 1997, seen.between(1997, 1999), seen > 1999):
        log.filter(part).write.mode("append").parquet(f"{base}/landed")
        upsert.fold_available(spark, f"{base}/landed", log.schema, f"{base}/state", roles.observation_segment())
    return _article_columns(upsert.stored_articles(spark, f"{base}/state"))


def stream_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempt lines drained by a stream, twice; the second time adds nothing."""
    base = shared_folder(spark, "stream-attempts")
    attempt_lines(spark, folder).write.text(f"{base}/queue")
    for _ in range(2):
        drain.drain_available(spark, f"{base}/queue", f"{base}/state", roles.now())
    stored = drain.stored_attempts(spark, f"{base}/state")
    return stored.select(micros("attempted_at"), "reason")


QUERIES: dict[str, Query] = {
    "coverage_gaps": coverage_gaps,
    "feed_coverage": feed_coverage,
    "coverage_summary": coverage_summary,
    "coverage_table": coverage_table,
    "gap_table": gap_table,
    "feed_health": feed_health,
    "health_table": health_table,
    "article_listing": article_listing,
    "article_listing_deep": article_listing_deep,
    "listing_table": listing_table,
    "listing_page_info": listing_page_info,
    "newest_article": newest_article,
    "article_flags": article_flags,
    "run_summary": run_summary,
    "label_counts": label_counts,
    "article_fold": article_fold,
    "observation_fold": observation_fold,
    "run_new_seen": run_new_seen,
    "prev_max_by_run": prev_max_by_run,
    "feed_maxima": feed_maxima,
    "gap_verdicts": gap_verdicts,
    "degenerate_pages": degenerate_pages,
    "demoted_dates": demoted_dates,
    "canonical_urls": canonical_urls,
    "canonical_variants": canonical_variants,
    "canonical_duplicates": canonical_duplicates,
    "content_hashes": content_hashes,
    "duplicate_texts": duplicate_texts,
    "double_escapes": double_escapes,
    "strip_tags_native": strip_tags_native,
    "clean_titles": clean_titles,
    "excerpts": excerpts,
    "dates_resolved": dates_resolved,
    "report_times": report_times,
    "declaration_sync": declaration_sync,
    "sync_report": sync_report,
    "synced_feeds": synced_feeds,
    "declaration_audit": declaration_audit,
    "attempt_log": attempt_log_query,
    "constraint_audit": constraint_audit,
    "table_fingerprint": table_fingerprint,
    "embedding_fingerprint": embedding_fingerprint,
    "purge_preview": purge_preview,
    "page_entries": page_entries,
    "run_outcomes": run_outcomes,
    "unknown_feed_runs": unknown_feed_runs,
    "page_encodings": page_encodings,
    "validators": validators,
    "ingest_documents": ingest_documents,
    "stream_ingest": stream_ingest,
    "stream_upsert": stream_upsert,
    "stream_attempts": stream_attempts,
    "stream_feed_state": stream_feed_state,
    "resolved_links": resolved_links,
    "sql_functions": sql_functions,
    "page_dialects": page_dialects,
    "snapshot_roundtrip": snapshot_roundtrip,
}
