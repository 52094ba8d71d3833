"""Page documents, run outcomes and the ingestion job, with documents written for these tests."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from support import at, utc

from pagetide.model import FETCH_LOG
from pagetide.plans.ingest import ingest
from pagetide.operators import observe
from pagetide.session import shared_folder
from pagetide.sources import fetchlog, pages
from pagetide.streaming import upsert

NOW = at("2026-08-19T12:00:00")
HEAD = "<?xml version='1.0' encoding='UTF-8'?>"


def rss(*items, encoding="UTF-8"):
    return (
        f"<?xml version='1.0' encoding='{encoding}'?><rss version='2.0' xmlns:content='http://purl.org/rss/1.0/modules/content/' "
        "xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>Flux</title><link>https://f.test/</link>"
        + "".join(items) + "</channel></rss>"
    )


def item(slug, *, title=None, date=None, text="<p>Texte</p>", guid=None, link=None, extra=""):
    escaped = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return (
        f"<item><title>{title or slug}</title><link>{link or f'https://f.test/{slug}'}</link>"
        + (f"<guid isPermaLink='false'>{guid}</guid>" if guid else "")
        + (f"<pubDate>{date}</pubDate>" if date else "")
        + f"<description>{escaped}</description>{extra}</item>"
    )


def mail(when):
    return when.strftime("%a, %d %b %Y %H:%M:%S +0000")


SOUND = rss(
    item("un", title="Une faille", link="https://f.test/un?utm_source=rss&amp;id=1", date="Wed, 19 Aug 2026 08:30:00 +0200",
         guid="urn:1", extra="<dc:creator>Alice Durand</dc:creator>"),
    item("deux", title="Le mod&amp;egrave;le", link="https://f.test/deux/amp/", date="Tue, 18 Aug 2026 17:05:00 +0000",
         text="<p>Analyse compl&egrave;te.</p>"),
    item("trois", link="http://m.f.test.example/trois/#x", date="Mon, 17 Aug 2026 09:00:00 +0000", text="",
         extra="<content:encoded><![CDATA[<div><p>Le r&eacute;sum&eacute;.</p></div>]]></content:encoded>"),
)
ATOM = HEAD + (
    "<feed xmlns='http://www.w3.org/2005/Atom'><title>Atom</title><entry><title type='html'>Local &amp;amp; models</title>"
    "<link rel='self' href='https://a.test/self'/><link rel='alternate' href='https://a.test/local'/><id>tag:1</id>"
    "<published>2026-08-19T09:15:00+00:00</published><updated>2026-08-19T09:45:00Z</updated><author><name>Simon</name></author>"
    "<summary type='html'>&lt;p&gt;Teaser&lt;/p&gt;</summary></entry><entry><title>Only updated</title>"
    "<link href='https://a.test/updated'/><id>tag:2</id><updated>2026-08-18T22:00:00Z</updated>"
    "<content type='html'>&lt;p&gt;First&lt;/p&gt;</content><content>Second</content></entry></feed>"
)


def parse(spark, body):
    raw = body if isinstance(body, bytes) else body.encode()
    frame = spark.createDataFrame([(bytearray(raw), NOW)], "body binary, fetched_at timestamp")
    parsed = pages.parse_documents(frame)
    entries = pages.normalize_entries(pages.explode_entries(parsed)).orderBy("entry_pos").collect()
    return parsed.first(), entries


def test_rss(spark):
    page, entries = parse(spark, SOUND)
    assert (page["parse_error"], page["warning"]) == (None, None)
    assert [e["url_canonical"] for e in entries] == ["https://f.test/un?id=1", "https://f.test/deux", "https://f.test.example/trois"]
    assert "utm_source" in entries[0]["url_original"]
    assert (entries[0]["author"], entries[0]["guid"]) == ("Alice Durand", "urn:1")
    assert utc(entries[0]["published_at"]) == at("2026-08-19T06:30:00")
    assert entries[1]["title"] == "Le modèle" and "complète" in entries[1]["summary_clean"]
    assert entries[2]["summary_clean"] == "<p>Le résumé.</p>"


def test_atom(spark):
    page, (first, second) = parse(spark, ATOM)
    assert page["parse_error"] is None
    assert (first["url_canonical"], first["date_source"], first["author"]) == ("https://a.test/local", "published", "Simon")
    assert (first["title"], first["summary_clean"], first["guid"]) == ("Local & models", "<p>Teaser</p>", "tag:1")
    assert utc(second["published_at"]) == at("2026-08-18T22:00:00") and second["date_source"] == "updated"
    assert second["summary_clean"] == "<p>First</p>"


def test_broken_dates_fall_back(spark):
    dates = [None, "19/08/2026 08:30:00", "2026-08-18 07:00:00", "la semaine derniere",
             "Thu, 01 Jan 1970 00:00:00 +0000", "Fri, 19 Aug 2129 08:30:00 +0000"]
    _, entries = parse(spark, rss(*(item(str(i), date=d) for i, d in enumerate(dates))))
    assert [e["date_source"] for e in entries] == ["fetched", "published", "published", "fetched", "fetched", "fetched"]
    assert utc(entries[1]["published_at"]) == at("2026-08-19T08:30:00")
    assert utc(entries[0]["published_at"]) == NOW


def parse_errors(spark, bodies):
    frame = spark.createDataFrame([(i, bytearray(b.encode())) for i, b in enumerate(bodies)], "i int, body binary")
    return [(r["parse_error"], r["items"]) for r in pages.parse_documents(frame).orderBy("i").collect()]


def test_unusable_documents_fail_as_a_whole(spark):
    cases = {
        "": pages.ERROR_BLANK,
        "  \n ": pages.ERROR_BLANK,
        SOUND[:-40]: pages.ERROR_MALFORMED,
        "<!DOCTYPE html><html><body>404</body></html>": pages.ERROR_NOT_A_FEED,
        "<html><head><title>x</title></head></html>": pages.ERROR_NOT_A_FEED,
    }
    assert parse_errors(spark, cases) == [(error, None) for error in cases.values()]


def test_valid_empty_feeds_are_fine(spark):
    bodies = [rss(), "<feed xmlns='http://www.w3.org/2005/Atom'><title>t</title></feed>", "<rss version='2.0'><channel></channel></rss>"]
    assert parse_errors(spark, bodies) == [(None, [])] * 3


def test_wrong_and_latin_encodings(spark):
    page, entries = parse(spark, rss(item("a", title="été"), encoding="ISO-8859-1").encode("utf-8"))
    assert page["warning"] == pages.WARNING_ENCODING and entries[0]["title"] == "été"
    page, entries = parse(spark, rss(item("a", title="été"), encoding="ISO-8859-1").encode("latin-1"))
    assert page["warning"] is None and entries[0]["title"] == "été"
    page, entries = parse(spark, b"\xef\xbb\xbf" + rss(item("a", title="x")).encode())
    assert page["parse_error"] is None and len(entries) == 1
    page, entries = parse(spark, rss(item("a", title="bad byte")).encode().replace(b"bad", b"b\xffd"))
    assert page["warning"] and len(entries) == 1


def test_links_and_titles(spark):
    permalink = "<item><title></title><guid>https://f.test/by-guid</guid></item>"
    no_link = "<item><title>sans lien</title><guid isPermaLink='false'>x</guid></item>"
    bad = item("x", link="javascript:alert(1)")
    _, entries = parse(spark, rss(permalink, no_link, bad))
    assert [(e["url_canonical"], e["reject_reason"]) for e in entries] == [
        ("https://f.test/by-guid", None), (None, "missing"), (None, "scheme"),
    ]
    assert entries[0]["title"] == "https://f.test/by-guid"


def test_hostile_summaries(spark):
    _, entries = parse(spark, rss(
        item("a", text="<p>Texte l&eacute;gitime.</p><!-- c --><script>alert('x')</script><a href='javascript:alert(2)'>clic</a>"),
        item("b", text="<script>alert(3)</script>"),
    ))
    assert "légitime" in entries[0]["summary_clean"] and "alert" not in entries[0]["summary_clean"]
    assert "<script>alert('x')</script>" in entries[0]["raw_summary"]
    assert entries[1]["summary_clean"] is None and entries[1]["raw_summary"]


# --- runs -------------------------------------------------------------------------------

FEEDS = "feed_id long, slug string"


def response(feed, run, body=None, *, status=200, attempt=1, error=None, etag=None, when=None):
    when = when or NOW + timedelta(hours=6 * run)
    raw = None if body is None else bytearray(body if isinstance(body, bytes) else body.encode())
    return (feed, run, feed, when, attempt, None if error else status, error, raw, etag, None, when)


def log_of(spark, *rows):
    return spark.createDataFrame(list(rows), FETCH_LOG)


def feeds_of(spark, *slugs):
    return spark.createDataFrame(list(enumerate(slugs, start=1)), FEEDS)


OUTCOMES = [
    ([(200, None)], "ok", 200, None),
    ([(304, None)], "not_modified", 304, None),
    ([(404, None)], "error", 404, "FetchError: s : HTTP 404"),
    ([(503, None), (200, None)], "ok", 200, None),
    ([(503, None), (502, None)], "error", 502, "FetchError: s : HTTP 502"),
    ([(None, "timed out"), (200, None)], "ok", 200, None),
    ([(None, "timed out"), (None, "reset")], "error", None, "FetchError: s : reset"),
    ([(503, None), (None, "timed out")], "error", None, "FetchError: s : timed out"),
    ([(404, None), (200, None)], "error", 404, "FetchError: s : HTTP 404"),
    ([(503, None), (503, None), (200, None)], "ok", 200, None),
    ([(503, None), (429, None), (None, "reset"), (500, None)], "error", 500, "FetchError: s : HTTP 500"),
    ([(None, None)], "error", None, "FetchError: s : reponse sans statut"),
]


def test_run_outcomes(spark):
    rows = [
        response(1, run, "<rss/>", status=code, error=error, attempt=attempt)
        for run, (tries, *_) in enumerate(OUTCOMES)
        for attempt, (code, error) in enumerate(tries, start=1)
    ]
    got = fetchlog.classify_runs(log_of(spark, *rows), feeds_of(spark, "s")).orderBy("run_id").collect()
    assert [(r["status"], r["http_status"], r["error_message"]) for r in got] == [tuple(o[1:]) for o in OUTCOMES]


def test_empty_body_and_unknown_feed(spark):
    rows = [response(1, 1, ""), response(9, 1, SOUND)]
    (row,) = fetchlog.classify_runs(log_of(spark, *rows), feeds_of(spark, "s")).collect()
    assert row["error_message"] == "FetchError: s : HTTP 200 sans contenu"
    (unknown,) = fetchlog.unknown_feed_runs(log_of(spark, *rows), feeds_of(spark, "s")).collect()
    assert (unknown["feed_id"], unknown["run_id"], unknown["n_attempts"]) == (9, 1, 1)


@pytest.mark.parametrize(
    ("name", "codec", "warned"),
    [("utf-8", "utf-8", False), ("iso-8859-1", "utf-8", True), ("windows-1252", "cp1252", False), ("ISO-8859-15", "iso-8859-15", False)],
)
def test_encodings_are_read_behind_padding(spark, name, codec, warned):
    text = "dîner à 5 € – l’œuvre ž" if codec in ("utf-8", "cp1252") else "dîner à 5 € œuvre ž"
    body = f"<?xml version='1.0' {' ' * 500} encoding='{name}' ?><rss/>{text}".encode(codec)
    frame = spark.createDataFrame([(body,)], "body binary")
    read, warning = pages.decode_body(F.col("body"))
    row = frame.select(read.alias("t"), warning.alias("w")).first()
    assert row["t"].endswith(f"<rss/>{text}") and (row["w"] is not None) == warned


def test_rss_1_has_its_items_beside_the_channel(spark):
    body = (
        "<?xml version='1.0'?><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' "
        "xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>c</title></channel>"
        "<item><title>Premier</title><link>https://un.test/a</link><dc:date>2024-05-01T10:00:00Z</dc:date></item>"
        "<item><title>Second</title><link>https://un.test/b</link></item></rdf:RDF>"
    )
    frame = spark.createDataFrame([(1, bytearray(body.encode()))], "page long, body binary")
    rows = pages.explode_entries(pages.parse_documents(frame)).orderBy("entry_pos").collect()
    assert [(r["title"], r["url_original"], r["updated"]) for r in rows] == [
        ("Premier", "https://un.test/a", "2024-05-01T10:00:00Z"), ("Second", "https://un.test/b", None)
    ]


def test_feeds_after_runs(spark):
    feeds = spark.createDataFrame(
        [(1, "a", "e0", "l0", NOW), (2, "b", "e0", None, NOW), (3, "c", "e0", "l0", NOW)],
        "feed_id long, slug string, etag string, last_modified string, updated_at timestamp",
    )
    later = NOW + timedelta(1)
    runs = spark.createDataFrame(
        [(1, 1, NOW, NOW, "ok", "old", None), (1, 2, later, later, "ok", None, "l1"), (2, 1, later, later, "error", "x", "x")],
        "feed_id long, run_id long, started_at timestamp, finished_at timestamp, status string, etag string, last_modified string",
    )
    rows = {r["feed_id"]: r for r in fetchlog.updated_feeds(feeds, runs).collect()}
    assert (rows[1]["etag"], rows[1]["last_modified"], utc(rows[1]["updated_at"])) == (None, "l1", later)
    assert [(rows[k]["etag"], utc(rows[k]["updated_at"])) for k in (2, 3)] == [("e0", NOW), ("e0", NOW)]


def test_validators_move_only_with_success(spark):
    rows = [
        (1, 1, NOW, "ok", "v1"), (1, 2, NOW + timedelta(1), "error", "v2"), (1, 3, NOW + timedelta(2), "not_modified", None),
        (2, 1, NOW, "ok", "w1"), (2, 2, NOW + timedelta(1), "ok", None),
    ]
    frame = spark.createDataFrame(rows, "feed_id long, run_id long, started_at timestamp, status string, etag string")
    got = fetchlog.current_validators(frame.withColumn("last_modified", F.lit("lm"))).collect()
    assert {(r["feed_id"], r["etag"]) for r in got} == {(1, "v1"), (2, None)}


def dated(days, *slugs):
    return rss(*(item(f"d{days}/{s}", date=mail(NOW + timedelta(days=days, hours=i))) for i, s in enumerate(slugs)))


RELAY = rss(
    item("r", title="Une faille", link="https://f.test/un?fbclid=1&amp;id=1#c", date=mail(NOW), guid="relay-guid"),
    item("r2", link="https://relay.test/own", date=mail(NOW)),
)


def stories(spark):
    """Sound, broken and relaying feeds; pages that overlap, move on, stand still or fail."""
    return [
        response(1, 1, SOUND, etag='"v1"'), response(2, 1, SOUND[:-40]), response(3, 1, RELAY, when=NOW + timedelta(hours=7)),
        response(1, 2, SOUND, etag='"v2"'), response(2, 2, status=304), response(3, 2, status=503),
        response(1, 3, dated(3, "a", "b", "c", "d"), when=NOW + timedelta(days=4)),
        response(2, 3, rss(*(item(f"f{i}", date=mail(NOW + timedelta(seconds=i))) for i in range(6))), when=NOW + timedelta(days=4)),
        response(1, 4, dated(3, "a", "b", "c") .replace("<title>d3/a", "<title>Revised"), when=NOW + timedelta(days=5)),
        response(3, 4, rss(item("x", link="javascript:x"), item("y")), when=NOW + timedelta(days=5)),
    ]


def run_rows(frame):
    return {(r["feed_id"], r["run_id"]): r for r in frame.collect()}


def check_stories(runs, articles, sightings):
    told = {k: (r["status"], r["n_new"], r["n_seen"], r["gap_status"], r["gap_reason"]) for k, r in runs.items()}
    assert told == {
        (1, 1): ("ok", 3, 3, "unknown", "first_run"),
        (2, 1): ("error", 0, 0, "unknown", "not_fetched"),
        (3, 1): ("ok", 1, 2, "unknown", "few_reliable_dates"),
        (1, 2): ("ok", 0, 3, "none", "overlap"),
        (2, 2): ("not_modified", 0, 0, "unknown", "not_fetched"),
        (3, 2): ("error", 0, 0, "unknown", "not_fetched"),
        (1, 3): ("ok", 4, 4, "suspected", "overlap_lost"),
        (2, 3): ("ok", 6, 6, "unknown", "few_reliable_dates"),
        (1, 4): ("ok", 0, 3, "none", "overlap"),
        (3, 4): ("ok", 1, 1, "unknown", "few_reliable_dates"),
    }
    assert runs[2, 1]["error_message"] == pages.ERROR_MALFORMED
    assert runs[3, 2]["error_message"] == "FetchError: relais : HTTP 503" and runs[3, 2]["http_status"] == 503
    assert runs[3, 4]["error_message"] == "1 lien(s) inutilisable(s)"
    # The bound is what was known before the run, and its own page never enters it.
    assert utc(runs[1, 3]["prev_max_published"]) == at("2026-08-19T06:30:00")
    assert utc(runs[1, 3]["oldest_in_page"]) == NOW + timedelta(days=3)
    assert runs[2, 2]["prev_max_published"] is None and runs[2, 2]["oldest_in_page"] is None
    # The relayed article counts with the date its first feed gave it.
    assert utc(runs[3, 4]["prev_max_published"]) == NOW
    by_url = {a["url_canonical"]: a for a in articles}
    assert len(by_url) == 15
    assert by_url["https://f.test/un?id=1"]["first_feed_id"] == 1
    assert by_url["https://f.test/d3/a"]["title"] == "Revised"
    assert utc(by_url["https://f.test/d3/a"]["updated_at"]) == NOW + timedelta(days=5)
    assert by_url["https://f.test/f0"]["date_source"] == "fetched"
    pair = {(s["url_canonical"], s["feed_id"]): s for s in sightings}
    assert len(pair) == 16
    assert pair["https://f.test/un?id=1", 1]["guid"] == "urn:1"
    assert pair["https://f.test/un?id=1", 3]["guid"] == "relay-guid"


def test_ingestion(spark):
    feeds = feeds_of(spark, "sain", "casse", "relais")
    done = ingest(log_of(spark, *stories(spark)), feeds, shared_folder(spark, "t"))
    check_stories(
        run_rows(done.runs),
        observe.with_texts(observe.merge_articles(done.segments), done.contents).collect(),
        observe.sighting_rows(done.sightings).collect(),
    )


@pytest.mark.parametrize("swept", [(), (0, 2)])
def test_streamed_ingestion_tells_the_same_story(spark, swept):
    """In four batches, also with old versions removed while the same stream goes on."""
    cuts = (3, 6, 8)
    rows, feeds = stories(spark), feeds_of(spark, "sain", "casse", "relais")
    base = shared_folder(spark, "t")
    state = f"{base}/state"
    for batch, (low, high) in enumerate(zip((0, *cuts), (*cuts, len(rows)), strict=True)):
        log_of(spark, *rows[low:high]).coalesce(1).write.mode("append").parquet(f"{base}/log")
        upsert.ingest_stream(fetchlog.stream_fetch_log(spark, f"{base}/log"), feeds, state).awaitTermination()
        if batch in swept:
            before = sorted(map(str, upsert.stored_articles(spark, state).collect()))
            upsert.sweep(spark, state, batch)
            assert sorted(map(str, upsert.stored_articles(spark, state).collect())) == before
    check_stories(
        run_rows(upsert.stored_runs(spark, state)),
        upsert.stored_articles(spark, state).collect(),
        upsert.stored_sightings(spark, state).collect(),
    )
    assert upsert.stored_sightings(spark, state).count() == 16


def test_texts_stay_where_they_were_parsed(spark):
    """Texts are read from the one pass over the log; no join or shuffle lies between."""
    done = ingest(log_of(spark, *stories(spark)[:3]), feeds_of(spark, "sain", "casse", "relais"), shared_folder(spark, "t"))
    plan = done.contents._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r["title"] for r in done.contents.collect()} >= {"Une faille"}
